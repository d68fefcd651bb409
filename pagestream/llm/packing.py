"""Packing of tokenized documents into sequences of at most `window` tokens.

Method: order-preserving dynamic programming. A task's documents, in the order they come, are one stream
of tokens. Candidate cuts are the ends of documents (free), the ends of sentences, and within long
sentences every STEP tokens, each with a penalty for the truncation; a window costs its padding besides.
cost[j] = penalty[j] + window - place[j] + min(cost[i] + place[i]) over i with place[j] - place[i] <= window;
the minimum comes from a monotone queue, so the time is linear. Streams are cut in pieces of at most STREAM
tokens at document ends, so memory is bounded; the last window of a piece starts the next one.
A sequence whose length is a power of two has no padding: the last of a task is split into such parts.

Sequences never span tasks, so nothing is shuffled and a lost task is redone alone. sequence_id holds the
number of the input partition and of the sequence in it.

Edge cases: null text is empty; an empty text is its separator alone; a very long text spans sequences;
rows of one doc_id, or null doc_id, are packed as rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import bounded_batches
from pagestream.llm.tokens import CachedEncoder, piece_bytes, vocabulary_path

SENTENCE, INNER, STEP, STREAM = 2, 10, 32, 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_BYTES = (b".", b"!", b"?")


def candidates(ends: np.ndarray, documents: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of the allowed cuts, in order, and their penalties. ends: of sentences; documents: of
    documents; both sorted, the last of documents is the end of the stream."""
    place = np.union1d(ends, documents)
    before = np.concatenate([[0], place[:-1]])
    inner = (place - before - 1) // STEP
    if inner.any():
        k = np.repeat(np.arange(len(place)), inner)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        more = before[k] + nth * STEP
    else:
        more = np.zeros(0, np.int64)
    everything = np.concatenate([place, more])
    penalty = np.concatenate([np.where(np.isin(place, documents), 0, SENTENCE), np.full(len(more), INNER)])
    order = np.argsort(everything, kind="stable")
    return everything[order].tolist(), penalty[order].tolist()


def best_cuts(place: list[int], penalty: list[int], window: int) -> list[int]:
    """The cheapest cuts of [0, place[-1]) into windows; neighbouring places are at most a window apart."""
    came = [0] * len(place)
    queue = deque([(0, 0, -1)])  # (cost + place, place, index), both rising: the first is the least in reach
    front, pop, push, drop = queue[0], queue.pop, queue.append, queue.popleft
    for j, (p, extra) in enumerate(zip(place, penalty)):
        while queue[0][1] < p - window:
            drop()
        front = queue[0]
        came[j] = front[2]
        value = front[0] + extra + window  # cost[j] + place[j]
        while queue and queue[-1][0] >= value:
            pop()
        push((value, p, j))
    cuts, j = [], len(place) - 1
    while j >= 0:
        cuts.append(place[j])
        j = came[j]
    return cuts[::-1]


def binary_parts(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs documents as they come; `flush` gives rows of pieces."""

    def __init__(self, window: int, task: int, sentence_end: np.ndarray):
        self.window, self.next, self.sentence_end = window, task << 33, sentence_end
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):  # a text larger than a stream is cut to streams
            part = ids[at : at + STREAM]
            self.waiting.append((doc_id, at, part, len(ids)))
            at += len(part)
            self.held += len(part)
            if self.held >= STREAM:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        lengths = np.array([len(w[2]) for w in self.waiting])
        documents = np.cumsum(lengths)
        ids = np.concatenate([w[2] for w in self.waiting])
        place, penalty = candidates(np.flatnonzero(self.sentence_end[ids]) + 1, documents)
        cuts = best_cuts(place, penalty, self.window)
        done = 0
        if last:
            done, rest = len(cuts), cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
            bounds = cuts[:-1] + (cuts[-1] - rest + np.cumsum(binary_parts(rest))).tolist()
        else:
            bounds = cuts[:-1] if len(cuts) > 1 else cuts  # the last window may grow yet
        begin, d, into = 0, 0, 0
        left: list[tuple] = []
        for end in bounds:
            offset = 0
            while begin < end:
                doc_id, start, part, total = self.waiting[d]
                n = min(end - begin, len(part) - into)
                yield doc_id, start + into, n, zlib.crc32(part[into : into + n].astype("<u4").tobytes()), total, self.next, offset
                begin, offset, into = begin + n, offset + n, into + n
                if into == len(part):
                    d, into = d + 1, 0
            self.next += 1
        for k, (doc_id, start, part, total) in enumerate(self.waiting[d:]):
            cut = into if k == 0 else 0
            left.append((doc_id, start + cut, part[cut:], total))
        self.waiting, self.held = left, sum(len(w[2]) for w in left)


@cache
def _tools(path: str) -> tuple[CachedEncoder, np.ndarray]:
    """The encoder and which ids end a sentence, made once a worker."""
    return CachedEncoder(path), np.array([(t := p.rstrip(b"\"')]")).endswith(END_BYTES) or b"\n" in p for p in piece_bytes(path)])


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _tools(path)
        packer = Packer(window, TaskContext.get().partitionId(), ends)
        kinds = [pa.int64()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(encoder.ids(text or ""), "<u4"), np.uint32(0))
                rows += packer.add(doc_id, ids)
            yield table(rows)
        yield table(list(packer.flush(True)))

    return run


def pack(docs: DataFrame, window: int = 1024, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession, 500)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pack(path or vocabulary_path(), window), SCHEMA)
