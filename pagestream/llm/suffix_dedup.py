"""Removal of long byte strings that occur more than once anywhere in a corpus.

Method: prefix doubling over content-defined positions. Ranking each byte position would shuffle many times the
input, so ranks are carried by anchors: positions whose 16-byte gram is the least within RADIUS bytes either way.
Which positions are anchors depends on the bytes near them only, so two equal windows of `width` bytes hold the
same inner anchors. A phrase is what stands from one anchor to the next, with the context of both.

1. Round 0 ranks each phrase by its bytes. Round j pairs the rank of each position with the rank 2**(j-1)
   phrases further on, groups equal pairs and ranks them anew. A rank is the first position that has it, so
   ranks stand for equal bytes exactly. Only positions whose rank is not unique go on, and rounds end when
   2**j phrases are past what a window can hold.
2. A stretch is a run of window starts with the same inner anchors; its core is the phrases between them. The
   core of m phrases has as rank the pair of the ranks of its first and its last 2**j phrases (the two overlap).
   If a core is unique, no window of the stretch occurs twice. If the bytes that all windows of a stretch cover
   occur twice, each window does.
3. Only stretches still undecided (at the ends of matches, or between few anchors) rank each window start by the
   whole window, each text's equal windows once. One stretch of each kind that is decided and has the same core
   ranks its starts too, as a partner for them.

Bytes are compared by 128 bits of BLAKE2b. Groups of equal ranks are only counted, with counts combined before the
shuffle, and the table of counts is written before it is joined, so that Spark can split a rank that is hot.

Edge cases: null text is empty; texts shorter than `width` lose nothing; a string that repeats inside one
document counts, overlaps too; ties do not arise; repeated rows of one doc_id are treated as separate
texts that share what they have; rows of null doc_id are searched and cleaned like others; an empty table
gives an empty result. Other columns pass through `clean` and are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestream.llm.bytehash import prefix, spans
from pagestream.llm.common import bounded_batches, cut, discard, numbered, release

GRAM, RADIUS = 16, 40
CONTEXT = GRAM + 2 * RADIUS


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours, by doubling."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def anchors(text: bytes) -> np.ndarray:
    """Positions a with the first least gram of [a - RADIUS, a + RADIUS], whole within the text."""
    n = len(text)
    if n < CONTEXT:
        return np.zeros(0, np.int64)
    start = np.arange(n - GRAM + 1)
    gram = spans(prefix(np.frombuffer(text, np.uint8)), start, start + GRAM)
    near = _least(gram, RADIUS)
    own = gram[RADIUS : len(gram) - RADIUS]
    before, after = near[: len(own)], near[RADIUS + 1 : RADIUS + 1 + len(own)]
    return np.flatnonzero((own < before) & (own <= after)) + RADIUS


def stretches(a: np.ndarray, n: int, width: int) -> tuple[np.ndarray, ...]:
    """First and last window start of each stretch, and the first and last of its inner anchors (first > last: none)."""
    last = n - width
    first = np.unique(np.concatenate([[0], a - RADIUS + 1, a + RADIUS + GRAM - width]))
    first = first[(first >= 0) & (first <= last)]
    end = np.append(first[1:] - 1, last)
    return first, end, np.searchsorted(a, first + RADIUS), np.searchsorted(a, first + width - RADIUS - GRAM, "right") - 1


def fingerprints(pieces: Iterator[bytes]) -> np.ndarray:
    """128 bits of each piece, as two columns of 64."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in pieces]), np.int64).reshape(-1, 2)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]


def _batch(parts: list[list[np.ndarray]], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else [], t) for p, t in zip(parts, types)], names)


def _phrase_rows(width: int):
    """(h1, h2, row, i) of each phrase. i = -1 marks a text with windows over less than two anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                if len(text) < width:
                    continue
                a = anchors(text)
                f, z = stretches(a, len(text), width)[2:]
                got = fingerprints(text[s:e] for s, e in zip((a[:-1] - RADIUS).tolist(), (a[1:] + RADIUS + GRAM).tolist()))
                i = np.arange(len(got), dtype=np.int32)
                if (f >= z).any():
                    got, i = np.append(got, np.zeros((1, 2), np.int64), 0), np.append(i, np.int32(-1))
                for k, x in enumerate((got[:, 0], got[:, 1], np.full(len(i), row), i)):
                    parts[k].append(x)
            yield _batch(parts, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), ["h1", "h2", "row", "i"])

    return run


def _twice(df: DataFrame, *key: str) -> DataFrame:
    """The keys on more than one row. Written, so that a join with it deals both sides and hot keys can be split."""
    return cut(df.groupBy(*key).count().where("count > 1").select(*key))


def _ranked(pairs: DataFrame, *key: str) -> DataFrame:
    """(row, i, a, b): positions whose key is not unique, (a, b) the first position that has the key."""
    names = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("row", "i")).alias("first")).where("n > 1").select(*key, "first")
    names = cut(names)
    out = cut(pairs.join(names, list(key)).select("row", "i", F.col("first.row").alias("a"), F.col("first.i").alias("b")))
    discard(names)
    release(pairs.sparkSession)
    return out


def doubled(phrases: DataFrame, width: int) -> list[DataFrame]:
    """The rounds of ranks: table j has (row, i, a, b) for positions whose 2**j phrases from i on occur twice."""
    rounds = [_ranked(phrases, "h1", "h2")]
    while 2 ** len(rounds) <= max(1, (width - CONTEXT) // (RADIUS + 1)):
        step = 2 ** (len(rounds) - 1)
        further = rounds[-1].select("row", (F.col("i") - step).alias("i"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        pairs = cut(rounds[-1].join(further, ["row", "i"]))
        rounds.append(_ranked(pairs, "a", "b", "a2", "b2"))
        discard(pairs)
    return rounds


def _stretch_rows(width: int):
    """(c1, c2, v1, v2, row, u, v): stretches whose core may occur twice, with the rank of the core (0, 0: without
    anchors) and of what the windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in range(7)]
            for row, text, live in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist()):
                rank = {(x["j"], x["i"]): (x["a"], x["b"]) for x in live}
                a = anchors(text)
                cores, keep = [], []
                for k, (u, v, f, z) in enumerate(zip(*map(np.ndarray.tolist, stretches(a, len(text), width)))):
                    m = z - f
                    if m < 1:
                        core = text[a[f] - RADIUS : a[f] + RADIUS + GRAM] if m == 0 else b""
                    else:
                        j = m.bit_length() - 1
                        one, two = rank.get((j, f)), rank.get((j, z - (1 << j)))
                        if one is None or two is None:
                            continue
                        core = struct.pack("<qqqqq", m, *one, *two)
                    keep.append((u, v))
                    cores.append(core)
                if not keep:
                    continue
                core = fingerprints(cores) * np.array([[len(c) > 0] for c in cores], np.int64)
                cover = fingerprints(text[u : v + width] for u, v in keep)
                place = np.array(keep, np.int32)
                for k, x in enumerate((core[:, 0], core[:, 1], cover[:, 0], cover[:, 1], np.full(len(keep), row), place[:, 0], place[:, 1])):
                    parts[k].append(x)
            yield _batch(parts, (pa.int64(),) * 5 + (pa.int32(),) * 2, ["c1", "c2", "v1", "v2", "row", "u", "v"])

    return run


def _position_rows(width: int):
    """(h1, h2, row, u, v, n): the window starts of the undecided stretches. Windows that occur twice in their own text
    leave as runs u..v of starts (n = 0), and once with n = 2 for others to meet; the rest have n = 1 and u = v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in range(6)]
            for row, text, open_ in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist()):
                p = np.unique(np.concatenate([np.arange(x["u"], x["v"] + 1, dtype=np.int32) for x in open_]))
                rank = fingerprints(text[u : u + width] for u in p.tolist())
                order = np.lexsort((rank[:, 1], rank[:, 0]))
                new = np.append(True, (np.diff(rank[order], axis=0) != 0).any(axis=1))
                first = np.flatnonzero(new)
                often = np.diff(np.append(first, len(p))) > 1
                start, rank = p[order[first]], rank[order[first]]
                twice = np.sort(p[order[np.repeat(often, np.diff(np.append(first, len(p))))]])
                ends = np.flatnonzero(np.diff(twice, prepend=-9) > 1)
                u, v = twice[ends], twice[np.append(ends[1:], len(twice)) - 1] if len(twice) else twice
                none = np.zeros(len(u), np.int64)
                columns = ((rank[:, 0], none), (rank[:, 1], none), (np.full(len(start), row), np.full(len(u), row)), (start, u), (start, v), (1 + often, none))
                for k, x in enumerate(columns):
                    parts[k] += x
            yield _batch(parts, (pa.int64(),) * 3 + (pa.int32(),) * 3, ["h1", "h2", "row", "u", "v", "n"])

    return run


def merged(pairs: list, width: int) -> list[tuple[int, int]]:
    """Byte runs [start, end) that the windows starting in the given [u, v] cover."""
    out: list[tuple[int, int]] = []
    for u, v in sorted((x["u"], x["v"]) for x in pairs or ()):
        if out and u <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], v + width))
        else:
            out.append((u, v + width))
    return out


def repeated_windows(rows: DataFrame, width: int) -> DataFrame:
    """rows(row, text) to (row, pairs: array of [u, v]): all window starts that occur more than once."""
    spark = rows.sparkSession
    phrases = cut(rows.select("row", "text").mapInArrow(_phrase_rows(width), "h1 long, h2 long, row long, i int"))
    rounds = doubled(phrases.where("i >= 0"), width)
    live = phrases.where("i < 0").select("row", F.lit(-1).alias("j"), "i", F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"))
    for j, table in enumerate(rounds):
        live = live.unionByName(table.select("row", F.lit(j).alias("j"), "i", "a", "b"))
    lists = live.groupBy("row").agg(F.collect_list(F.struct("j", "i", "a", "b")).alias("live"))  # the phrases of one text
    marks = cut(rows.join(lists, "row").select("row", "text", "live").mapInArrow(_stretch_rows(width), "c1 long, c2 long, v1 long, v2 long, row long, u int, v int"))
    discard(phrases, *rounds)
    release(spark)
    covers, cores = _twice(marks, "v1", "v2"), _twice(marks, "c1", "c2")
    some = marks.join(cores.withColumn("often", F.lit(True)), ["c1", "c2"], "left").where("often OR (c1 = 0 AND c2 = 0)").drop("often")
    decided = cut(some.join(covers.withColumn("whole", F.lit(True)), ["v1", "v2"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))))
    discard(marks, covers, cores)
    release(spark)
    undecided = decided.where("NOT whole")
    # an undecided window may equal one in a decided stretch of the same core: one of each cover stands for all
    open_cores = cut(undecided.select("c1", "c2").distinct())
    partner = decided.where("whole").join(open_cores, ["c1", "c2"], "left_semi").groupBy("v1", "v2").agg(F.min(F.struct("row", "u", "v")).alias("s"))
    open_ = undecided.select("row", "u", "v").unionByName(partner.select("s.*")).groupBy("row").agg(F.collect_list(F.struct("u", "v")).alias("open"))
    places = cut(rows.join(open_, "row").select("row", "text", "open").mapInArrow(_position_rows(width), "h1 long, h2 long, row long, u int, v int, n int"))
    release(spark)
    ranks = cut(places.where("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("c")).where("c > 1").select("h1", "h2"))
    hits = places.where("n = 1").join(ranks, ["h1", "h2"], "left_semi").select("row", "u", "v")
    # a row's starts meet with its stretches: first runs of neighbours, so that lists stay short
    run = hits.withColumn("g", F.col("u") - F.row_number().over(Window.partitionBy("row").orderBy("u")))
    runs = run.groupBy("row", "g").agg(F.min("u").alias("u"), F.max("v").alias("v")).unionByName(places.where("n = 0").select("row", "u", "v"), allowMissingColumns=True)
    found = decided.where("whole").select("row", "u", "v").unionByName(runs.select("row", "u", "v"))
    out = cut(found.groupBy("row").agg(F.collect_list(F.struct("u", "v")).alias("pairs")))
    discard(decided, open_cores, places, ranks)
    return out


def _removed(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, pairs in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist()):
                runs = merged(pairs, width)
                kept, at = [], 0
                for s, e in runs:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                rows.append((row, len(text), sum(e - s for s, e in runs), len(runs), kept.decode("utf-8", "ignore") if with_text else hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def _judged(docs: DataFrame, width: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number, and what is left of each row."""
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    rows = docs.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    found = repeated_windows(rows, width)
    release(spark)
    return rows.join(found, "row", "left").select("row", "text", "pairs").mapInArrow(
        _removed(width, with_text), "row long, n_bytes long, n_removed long, n_spans long, kept string"
    )


def suffix_dedup(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs, own = numbered(docs)
    out = _judged(docs, width, False).withColumnRenamed("kept", "kept_sha256")
    if own:
        return out.withColumnRenamed("row", "doc_id")
    names = docs.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return names.join(out, "row").drop("row")


def clean(docs: DataFrame, width: int = 400) -> DataFrame:
    """docs with the repeated strings cut out of text; bytes of a character cut in two go with it."""
    numbered_docs, _ = numbered(docs)
    out = _judged(numbered_docs, width, True).where("n_removed > 0").select(F.col("row").alias("__row"), F.col("kept").alias("__kept"))
    joined = numbered_docs.join(out, "__row", "left")
    text = F.when(F.col("__kept").isNotNull(), F.col("__kept")).otherwise(F.col("text"))
    return joined.select(*[(text.alias(c) if c == "text" else F.when(F.col("__kept").isNotNull(), F.length("__kept").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])
