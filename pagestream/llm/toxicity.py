"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are lower-cased and folded: homoglyphs of Latin letters to the letters, and digits or signs inside
words to the letters they stand for. The automaton holds whole words and word beginnings with weights, and
exception phrases, inside which words do not count. The sum of the weights found, per words of the text and
as such, goes through a logistic function.

The lexicon is a fixed list of words with a prior weight, joined with words and beginnings whose labelled
documents are mostly toxic (smoothed log odds). It and the logistic function are learned from at most
SAMPLE labelled documents of each label, taken by hash of doc_id, outside the held-out third
(crc32(doc_id as text) mod 3 = 1). Documents of the sample with equal whole texts count as one, toxic if any
is. Labels are used for nothing else; the score reads only the text.

Edge cases: null and empty texts score like texts without words; long texts are read whole; repeated rows
and null doc_id (never held out) are scored as rows; several labels of one doc_id count as toxic if any is;
without labels of both kinds the fixed list and fixed coefficients remain; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import bounded_batches, cut

#: Bound of the labelled sample, for each label, and of the lexicon learned from it.
SAMPLE, LEXICON = 4000, 8000
BEGINNINGS, MIN_TEXTS, MIN_WEIGHT, PRIOR_WEIGHT = (4, 5, 6), 3, 2.5, 4.0
# Common insults, phrases in which such words are harmless, look-alike letters, stand-in signs.
INSULTS = "idiot idiots moron morons stupid loser losers scum pathetic worthless trash clown disgusting dumb imbecile jerk garbage filthy vermin retard bastard".split()
EXCEPTIONS = ["clown fish", "circus clown", "trash can", "trash bin", "trash bag", "trash collection", "garbage collection", "garbage collector", "garbage truck", "garbage can"]
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαεορτυικνɑıоⅼ", "aeopcyxijsdhkmtbhaeoptuiknaiol"))
STAND_INS = str.maketrans("013457@$", "oieastas")
COEFFICIENTS = (-4.0, 2.0, 1.0)

_fold = str.maketrans(HOMOGLYPHS | {chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)} | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)})
# a whole word is tried from its start only, so that the time is linear in long words
_mixed = re.compile(r"(?<![\w@$])[\w@$]*?(?:[^\W\d_][0-9@$]|[0-9@$][^\W\d_])[\w@$]*")
_word = re.compile(r"[^\W_]+")
_foldable = re.compile("[" + "".join(map(chr, _fold)) + "]")


def fold(text: str | None) -> str:
    """Lower-cased text with look-alikes and stand-ins replaced."""
    text = (text or "").lower()
    if not text.isascii() and _foldable.search(text):
        text = text.translate(_fold)
    return _mixed.sub(lambda m: m[0].translate(STAND_INS) if sum(c.isdigit() for c in m[0]) * 2 <= len(m[0]) else m[0], text)


class Lexicon:
    """weights: of words, and of beginnings (ending in *)."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for w, x in weights.items():
            key = w.rstrip("*")
            known = self.automaton.get(key, ())
            self.automaton.add_word(key, (*known, (len(key), x, w.endswith("*"), False)))
        for w in EXCEPTIONS:
            self.automaton.add_word(w, (*self.automaton.get(w, ()), (len(w), 0.0, False, True)))
        self.automaton.make_automaton()

    def found(self, folded: str) -> float:
        """Sum of the weights in a folded text: of each word its greatest."""
        spans, harmless = {}, []
        n = len(folded)
        for end, entries in self.automaton.iter(folded):
            after = end + 1 < n and folded[end + 1].isalnum()
            for length, weight, beginning, exception in entries:
                start = end - length + 1
                if (start and folded[start - 1].isalnum()) or (after and not beginning):
                    continue
                if exception:
                    harmless.append((start, end))
                else:
                    spans[start] = max(spans.get(start, 0.0), weight)
        return sum(x for s, x in spans.items() if not any(a <= s <= b for a, b in harmless))


def measures(lexicon: Lexicon, text: str | None) -> tuple[float, float]:
    """The logarithms of the weight found and of the weight per 100 words."""
    folded = fold(text)
    total = lexicon.found(folded)
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / (1 + folded.count(" ") + folded.count("\n")))


def _probability(c, total: float, dense: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * total + c[2] * dense))))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small penalty, by Newton steps; no negative slope."""
    if len(y) < 20 or y.min() == y.max():
        return COEFFICIENTS
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    c = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([0.01, 0.3, 0.3]), a.T @ (weight * (y - p)) - np.array([0.01, 0.3, 0.3]) * c)
        c = c + step
    return (float(c[0]), max(0.0, float(c[1])), max(0.0, float(c[2])))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, toxic, half): distinct words and beginnings of each text."""
    for batch in batches:
        words, toxic, half = [], [], []
        for text, label, side in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = {w for w in _word.findall(fold(text)) if not w[0].isdigit() and len(w) > 2}
            own |= {w[:n] + "*" for w in own for n in BEGINNINGS if len(w) >= n}
            words += own
            toxic += [label] * len(own)
            half += [side] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(half, pa.int32())], ["word", "toxic", "half"])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple[float, float, float]]:
    """The lexicon's weights and the logistic coefficients."""
    fixed = dict.fromkeys(INSULTS, PRIOR_WEIGHT)
    seen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = [seen.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for t in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # at most 2 * SAMPLE rows: small enough to send everywhere
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id")).select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("half")))
    size = {(r.toxic, r.half): r["count"] for r in texts.groupBy("toxic", "half").count().collect()}
    counts = texts.mapInArrow(_words_of, "word string, toxic int, half int").groupBy("word").agg(*[F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), 1).otherwise(0)).alias(f"n{t}{h}") for t in (0, 1) for h in (0, 1)])
    rows = counts.where((F.col("n10") + F.col("n11") >= MIN_TEXTS) & (F.col("n10") + F.col("n11") > F.col("n00") + F.col("n01"))).orderBy(F.desc(F.col("n10") + F.col("n11") - F.col("n00") - F.col("n01")), "word").limit(LEXICON).collect()

    def weights(halves) -> dict[str, float]:
        toxic, other = (sum(size.get((t, h), 0) for h in halves) for t in (1, 0))
        out = dict(fixed)
        for r in rows:
            a, b = sum(r[f"n1{h}"] for h in halves), sum(r[f"n0{h}"] for h in halves)
            if a >= (MIN_TEXTS if len(halves) == 2 else 2):
                w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
                if w >= MIN_WEIGHT or (b == 0 and w >= 1.0):
                    out[r.word] = max(out.get(r.word, 0.0), w)
        return out

    points, y = [], []
    for h in (0, 1):  # each half is scored by the words of the other
        scored = texts.where(F.col("half") == h).select("text", "toxic").mapInArrow(_measured(weights([1 - h])), "total double, dense double, toxic int").collect()
        points += [(r.total, r.dense) for r in scored]
        y += [r.toxic for r in scored]
    return weights([0, 1]), fit(np.array(points).reshape(-1, 2), np.array(y))


def _measured(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            found = [measures(lexicon, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column(1)], ["total", "dense", "toxic"])

    return run


def _scored(weights: dict[str, float], coefficients, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            score = [_probability(coefficients, *measures(lexicon, t)) for t in batch.column(1).to_pylist()]
            out = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    bounded_batches(docs.sparkSession)
    weights, coefficients = learn(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scored(weights, coefficients, threshold), "doc_id long, held_out boolean, score double, predicted int")
