"""Byte-level BPE encoding and decoding by a table of distinct words.

Method: documents are split to words in blocks of about BLOCK_BYTES. A block keeps the order of its words as numbers
into its distinct words, and each distinct word leaves as a row (block, place, word). Spark deals these rows by word and
sorts them, so that equal words of all blocks stand together: each distinct word of the corpus is encoded once, and its
ids go back to every (block, place) that has it. There they are joined with the numbers by position. Decoding joins each
id with the id-to-piece table, which is as large as the vocabulary (bounded) and held by every worker.

A frequent word has one row a block, not one an occurrence, so no word makes a large group.

Edge cases: null text is empty and has no ids; added tokens in a text count as the library counts them;
rows of one doc_id, or null doc_id, are encoded as rows; a text longer than a block is one block; an empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import batches_of, cut, discard, release
from pagestream.llm.tokens import Splitter, piece_bytes, vocabulary_path

BLOCK_BYTES = 32 << 20
#: Word rows in a batch, and ids that a worker holds before it sends them on.
WORD_ROWS, HELD_BYTES = 20_000, 32 << 20


def _squeeze(numbers: np.ndarray, tail: bytes = b"") -> bytes:
    """32-bit numbers as byte planes, then tail, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(numbers)], "<u8").tobytes() + planes + tail)


def _spread(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n).T).view("<u4").ravel()
    return numbers, raw[8 + 4 * n :]


def _numbers_out(numbers: np.ndarray) -> bytes:
    """Numbers in order of appearance: a first appearance is 0, its number follows from those before."""
    seen = np.maximum.accumulate(numbers.astype(np.int64)) if len(numbers) else numbers
    return _squeeze(np.where(np.diff(seen, prepend=-1) > 0, 0, numbers.astype(np.int64) + 1))


def _numbers_in(data: bytes) -> np.ndarray:
    code = _spread(data)[0].astype(np.int64)
    return np.where(code == 0, np.cumsum(code == 0) - 1, code - 1)


SPLIT = "block long, place int, word string, doc_ids array<long>, lengths binary, numbers binary, kind int"
_SPLIT_TYPES = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("numbers", pa.binary()), ("kind", pa.int32())])


def _split(path: str):
    """For each block a row of kind 0 with its documents, their lengths in words, and the words as numbers into the
    block's distinct words in order of appearance; and a row of kind 1 for each distinct word, place its number. These
    come in the order of the words, in which they take less room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, task = Splitter(path), TaskContext.get().partitionId() << 32
        ids, numbers, known, held, n = [], [], {}, 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            words = sorted(known)
            for at in range(0, len(words), WORD_ROWS):
                some = words[at : at + WORD_ROWS]
                none = [pa.nulls(len(some), _SPLIT_TYPES.field(c).type) for c in ("doc_ids", "lengths", "numbers")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), task + n)), pa.array([known[w] for w in some], pa.int32()), pa.array(some, pa.string()), *none, pa.array(np.ones(len(some), np.int32))], schema=_SPLIT_TYPES)
            row = {"block": task + n, "doc_ids": ids, "lengths": _squeeze(np.array([len(x) for x in numbers])), "numbers": _numbers_out(np.concatenate(numbers)), "kind": 0}
            yield pa.RecordBatch.from_pylist([row], schema=_SPLIT_TYPES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = splitter.words(text or "")
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                ids.append(doc_id)
                numbers.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                held += len(text or "") + 64
                if held >= BLOCK_BYTES:
                    yield from block()
                    ids, numbers, known, held, n = [], [], {}, 0, n + 1
        if ids:
            yield from block()

    return run


def _encode(path: str):
    """(block, place, word), sorted by word, to (block, ids): packed places and ids of some words of a block. Equal
    words follow each other, so each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last, code = Splitter(path), None, b""
        held: dict[int, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            packed = [_squeeze(np.concatenate([np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])]), b"".join(x[2] for x in parts)) for parts in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["block", "ids"])

        for batch in batches:
            codes = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, code = word, np.array(splitter.encode([word])[0], "<u4").tobytes()
                codes.append(code)
            block, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                some = order[a:b]
                mine = [codes[i] for i in some]
                held.setdefault(int(block[some[0]]), []).append((place[some], np.array([len(x) // 4 for x in mine]), b"".join(mine)))
            size += sum(map(len, codes)) + 16 * len(codes)
            if size >= HELD_BYTES:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    return run


def _assembled(path: str, digest: bool):
    """(doc_ids, lengths, numbers, ids) of a block to its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(path)
        digits = [str(i) for i in range(len(pieces))]
        for batch in batches:
            for doc_ids, sizes, numbers, back in zip(*(batch.column(i).to_pylist() for i in range(4))):
                place, length, ids = [], [], []
                for x in back or ():
                    both, tail = _spread(x)
                    place.append(both[: len(both) // 2])
                    length.append(both[len(both) // 2 :])
                    ids += np.frombuffer(tail, "<u4").tolist()
                place = np.concatenate(place).astype(np.int64) if place else np.zeros(0, np.int64)
                length = np.concatenate(length).astype(np.int64) if length else np.zeros(0, np.int64)
                end = np.cumsum(length).tolist()
                n_ids = np.empty(len(place), np.int64)
                n_ids[place] = length
                decimal, decoded = [""] * len(place), [b""] * len(place)
                for p, a, b in zip(place.tolist(), [0, *end], end):
                    decimal[p], decoded[p] = ",".join([digits[i] for i in ids[a:b]]), b"".join([pieces[i] for i in ids[a:b]])
                all_numbers, begin, out = _numbers_in(numbers), 0, []
                for doc_id, size in zip(doc_ids, _spread(sizes)[0].tolist()):
                    at = all_numbers[begin : begin + size]
                    begin += size
                    n, at = int(n_ids[at].sum()), at.tolist()
                    text = b"".join([decoded[i] for i in at]).decode("utf-8", "replace")
                    listed = ",".join([decimal[i] for i in at])
                    if digest:
                        out.append((doc_id, n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        out.append((doc_id, n, [int(i) for i in listed.split(",")] if listed else [], text))
                last = [pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), *last))],
                    ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))],
                )

    return run


def _run(docs: DataFrame, path: str | None, digest: bool) -> DataFrame:
    spark, path = docs.sparkSession, path or vocabulary_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of(spark, 500):
        split = cut(texts.mapInArrow(_split(path), SPLIT), "zstd", by="kind")
    words = split.where("kind = 1").select("block", "place", "word")
    with batches_of(spark, WORD_ROWS):
        ids = cut(words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode(path), "block long, ids binary"), "zstd")
    discard(split, part="kind=1")
    release(spark, wait=2.0)
    back = ids.groupBy("block").agg(F.collect_list("ids").alias("ids"))  # a block's own words
    joined = split.where("kind = 0").select("block", "doc_ids", "lengths", "numbers").join(back, "block", "left").select("doc_ids", "lengths", "numbers", "ids")
    names = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    with batches_of(spark, 1):  # blocks are large rows
        out = cut(joined.mapInArrow(_assembled(path, digest), f"doc_id long, n_tokens long, {names}"))
    discard(split, ids)
    return out


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (text) of every document."""
    return _run(docs, path, False)


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return _run(docs, path, True)
