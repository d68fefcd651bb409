"""Pages out of decoded words: bit streams with batches of 16, and frames of 88 words.

The lock on batches (a match hides what it covers) is a walk; it sees the few positions that match. Everything
after it is joins, windows and expressions. Frames are read in Arrow batches: as expressions, each word was made
again for every mention of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import fec

# Fixed values of the protocols.
SYNC, IDLE, BATCH, WIDTH = 0x7CD215D8, 0x7A89C197, 16, 32
FRAME_WORDS, EMPTY = 88, (0, 0x1FFFFF)
KINDS = ("ENC", "UNK", "TON", "NUM", "SPN", "ALN", "BIN", "NNM")


def _lock(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    carrier, free = None, 0
    for frame in frames:
        kept = []
        for c, n in frame.itertuples(index=False):
            if c != carrier:
                carrier, free = c, n
            if n >= free:
                kept.append((c, n))
                free = n + (BATCH + 1) * WIDTH
        yield pd.DataFrame(kept, columns=["carrier", "start"], dtype="int64")


def batches(words: DataFrame, errors: int = 2) -> DataFrame:
    """(carrier, start) of the batches in words(carrier, n, word), word starting at bit n: the first sync word
    with at most `errors` wrong bits, then the first past each batch."""
    hits = words.where(F.bit_count(F.col("word").bitwiseXOR(F.lit(SYNC))) <= errors).select(F.col("carrier").cast("long").alias("carrier"), F.col("n").cast("long").alias("n"))
    return hits.repartition("carrier").sortWithinPartitions("carrier", "n").mapInPandas(_lock, "carrier long, start long")


def codewords(words: DataFrame) -> DataFrame:
    """(carrier, n, slot, word) of the batches; words cut off by the end are absent."""
    places = batches(words).select("carrier", F.posexplode(F.sequence(F.col("start") + WIDTH, F.col("start") + BATCH * WIDTH, F.lit(WIDTH))).alias("slot", "n"))
    return places.join(words.select("carrier", "n", "word"), ["carrier", "n"]).select("carrier", "n", "slot", "word")


def batch_pages(decoded: DataFrame) -> DataFrame:
    """(carrier, n, capcode, func, body) of codewords(carrier, n, slot, fixed): an address opens a page, messages
    add 20 bits, an idle word or another address closes it; words not decoded (null) are passed over, messages
    without an address and pages without text go. n: position of the address."""
    w = Window.partitionBy("carrier").orderBy("n")
    message = (F.col("fixed") != IDLE) & (F.shiftright("fixed", 31).bitwiseAND(F.lit(1)) == 1)
    good = decoded.where("fixed IS NOT NULL").withColumn("message", message)
    island = good.withColumn("page", F.sum(F.when(F.col("message"), 0).otherwise(1)).over(w))
    head = lambda c: F.max(F.when(~F.col("message") & (F.col("fixed") != IDLE), c))
    piece = F.when(F.col("message"), F.struct("n", F.transform(F.sequence(F.lit(30), F.lit(11), F.lit(-1)), lambda b: F.bit_get(F.col("fixed"), b).cast("int")).alias("bits")))
    pages = island.groupBy("carrier", "page").agg(
        head(F.col("n")).alias("n"),
        head(F.shiftright("fixed", 13).bitwiseAND(F.lit(0x3FFFF)) * 8 + F.floor(F.col("slot") / 2)).alias("capcode"),
        head(F.shiftright("fixed", 11).bitwiseAND(F.lit(3))).cast("int").alias("func"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),  # the words of one page
    )
    body = fec.text_of(fec.seven_bit(F.flatten(F.transform("pieces", lambda p: p["bits"]))))
    return pages.where("n IS NOT NULL").select("carrier", "n", "capcode", "func", body.alias("body")).where("body != ''")


def frame_pages(frames: DataFrame) -> DataFrame:
    """(frame_id, slot, capcode, typ, body, conf) of frames(frame_id, words array<bigint>, conf array<struct<status
    int, margin double>>). Frames not of 88 words or without a block word give nothing; a body that would reach
    past the frame is <oob>. conf counts the words a page reads, and their least margin (NaN left out)."""
    key = frames.schema["frame_id"].dataType.simpleString()
    shape = f"frame_id {key}, slot int, capcode long, typ string, body string, conf struct<words:int,verified:int,corrected:int,chase:int,failed:int,margin:double>"
    return frames.select("frame_id", "words", "conf").mapInArrow(_read, shape)


#: Reversed hexadecimal to the digit alphabet; 12 is the filler and goes.
DIGITS = str.maketrans({"a": " ", "b": "U", "c": None, "d": "-", "e": "]", "f": "["})
CONF = ("words", "verified", "corrected", "chase", "failed", "margin")


def _long(word: np.ndarray) -> np.ndarray:
    return (word < 0x8001) | (word > 0x1E0000)


def address_slots(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and indexes of their address words; the second word of a long address is no address."""
    first, vectors = (words[:, 0] >> 8 & 3) + 1, words[:, 0] >> 10 & 63
    first = np.where(known[:, 0] & ~np.isin(words[:, 0], EMPTY), first, FRAME_WORDS)
    at, skip = np.zeros(words.shape, bool), np.zeros(len(words), bool)
    for i in range(1, vectors.max(initial=0)):
        free = (first <= i) & (i < vectors) & ~skip & known[:, i] & ~np.isin(words[:, i], EMPTY)
        at[:, i], skip = free, free & _long(words[:, i])
    return np.nonzero(at)


def _dealt(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first FRAME_WORDS values of each list among all values, and which of them there are."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = (np.cumsum(sizes) - sizes)[:, None] + np.arange(FRAME_WORDS)
    there = np.arange(FRAME_WORDS) < sizes[:, None]
    return np.where(there, at, 0), there


def _values(column: pa.Array, at: np.ndarray, there: np.ndarray, none: float) -> tuple[np.ndarray, np.ndarray]:
    """Values at indexes, and whether they are known."""
    if not len(column):
        return np.full(at.shape, none), there & False
    known = there & column.is_valid().to_numpy(zero_copy_only=False)[at]
    return np.where(known, pc.fill_null(column, none).to_numpy(zero_copy_only=False)[at], none), known


def _digits(run: list[int], known: list[bool], skip: int) -> str:
    """4-bit digits through 21-bit words, low bits first, after `skip` bits; digits with a bit of an unknown word go."""
    bits, n = 0, (21 * len(run) - skip) // 4
    for k, w in enumerate(run):
        bits |= (w & 0x1FFFFF) << 21 * k
    out = f"{bits >> skip & (1 << 4 * n) - 1:0{n}x}"[::-1]
    if not all(known):
        out = "".join(c for g, c in enumerate(out) if all(known[(skip + 4 * g) // 21 : (skip + 4 * g + 3) // 21 + 1]))
    return out.translate(DIGITS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), FRAME_WORDS), False))
        if batch.num_rows:
            yield _read_batch(batch)


def _read_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, known = _values(batch.column(1).flatten(), *_dealt(batch.column(1)), 0)
    words = words.astype(np.int64)
    row, slot = address_slots(words, known)
    address, after = words[row, slot], words[row, slot + 1]
    long = _long(address)
    capcode = np.where(long, address + (after ^ 0x1FFFFF) * (1 << 15) + 0x1F9000, address - 0x8000)
    j = (words[row, 0] >> 10 & 63) + slot - (words[row, 0] >> 8 & 3) - 1
    keep = (capcode >= 0) & (j < FRAME_WORDS) & (known[row, slot + 1] | ~long)
    row, slot, capcode, long, j = (x[keep] for x in (row, slot, capcode, long, j))
    v = words[row, j]
    kind, start, size = v >> 4 & 7, v >> 7 & 127, v >> 14 & 127
    number, letters, tone = np.isin(kind, (3, 7)), np.isin(kind, (4, 5)), kind == 2
    size = np.where(number, size & 7, size)
    keep = (start + size > 0) & (tone | (start + size < FRAME_WORDS)) & known[row, j]
    row, slot, capcode, long, j, kind, start, size, number, letters, tone = (x[keep] for x in (row, slot, capcode, long, j, kind, start, size, number, letters, tone))
    header = np.where(long, j + 1, start)
    past = (number | letters) & np.where(long, header >= FRAME_WORDS, number & (start + size + 1 >= FRAME_WORDS))

    codes = np.where(known[:, :, None], words[:, :, None] >> np.array([0, 7, 14]) & 127, 3).astype(np.uint8).tobytes()
    body, lists, sure = [b""] * len(row), words.tolist(), known.all()
    text = np.flatnonzero((number | letters) & ~past)
    for i, r, k, head, first, n in zip(text.tolist(), *(x[text].tolist() for x in (row, kind, header, start + ~long, size))):
        w = lists[r]
        if k in (4, 5):
            last = min(first + max(n - 1, 0), FRAME_WORDS)
            opening = known[r, head] and w[head] >> 11 & 3 == 3
            body[i] = codes[3 * (r * FRAME_WORDS + first) + opening : 3 * (r * FRAME_WORDS + last)].replace(b"\x03", b"")
        else:
            run = [head, *range(first, min(first + n, FRAME_WORDS))]
            body[i] = _digits([w[p] for p in run], [True] if sure else known[r, run].tolist(), 10 if k == 7 else 2).encode()
    for i in np.flatnonzero(past).tolist():
        body[i] = b"<oob>"

    kinds = pa.array(KINDS).take(pa.array(kind))
    columns = [batch.column(0).take(pa.array(row)), pa.array(slot, pa.int32()), pa.array(capcode), kinds, pa.array(body, pa.binary()).cast(pa.string()), _confidence(batch.column(2), row, j, start, np.where(tone, start, start + size + 1), tone)]
    return pa.RecordBatch.from_arrays(columns, ["frame_id", "slot", "capcode", "typ", "body", "conf"])


def _confidence(conf: pa.Array, row: np.ndarray, j: np.ndarray, start: np.ndarray, stop: np.ndarray, tone: np.ndarray) -> pa.Array:
    """Counts by status and the least margin of the words read, j and those from start to stop (tones: j only); null for none."""
    values, (at, there) = conf.flatten(), _dealt(conf)
    there = _values(values.is_valid(), at, there, False)[0].astype(bool) if len(values) else there & False
    status, rated = _values(pc.struct_field(values, "status"), at, there, 0)
    margin, scored = _values(pc.struct_field(values, "margin"), at, there, np.nan)
    scored = scored & ~np.isnan(margin)
    begin, end = np.where(tone, 0, start), np.where(tone, 0, stop)  # a tone's start may lie past the frame

    def count(what: np.ndarray) -> np.ndarray:
        upto = np.zeros((len(what), FRAME_WORDS + 1), np.int32)
        np.cumsum(what, axis=1, out=upto[:, 1:])
        return upto[row, end] - upto[row, begin] + what[row, j]

    n, n_scored = count(there), count(scored)
    least = np.where(scored, margin, np.inf)
    lowest = least[row, j]
    some = np.flatnonzero(~tone)
    if len(some):
        cuts = np.stack([row[some] * FRAME_WORDS + begin[some], row[some] * FRAME_WORDS + end[some]], 1).ravel()
        lowest[some] = np.minimum(lowest[some], np.minimum.reduceat(np.append(least.ravel(), np.inf), cuts)[::2])
    lowest = np.where(n_scored > 0, lowest, np.nan)
    counts = [n, count(rated & (status == 0)), count(rated & np.isin(status, (1, 2))), count(rated & (status == 3)), count(rated & (status < 0))]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in counts), pa.array(lowest, pa.float64())], CONF, mask=pa.array(n == 0))
