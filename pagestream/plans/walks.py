"""Queries of the operators that replay an order: near-equal messages, peaks, batches and frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.operators import pages, signal
from pagestream.operators.coalesce import coalesce
from pagestream.plans.base import SAMPLES, samples, spread, table

TAPS = signal.low_pass(9, 2000.0, 16000.0)


def near_equal(s, d):
    """Events as messages of their user, some letters garbled by the hour."""
    e = table(s, d, "events")
    body = F.concat(F.lit("unit responding to "), F.translate("event_type", "aeiou", "a#iou"), F.lit(" call at station "), F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_000_000), F.lit(7)).cast("string"))
    m = e.select(F.pmod("user_id", F.lit(64)).cast("string").alias("carrier"), "ts", body.alias("body"), "event_id")
    return coalesce(m, "event_id").groupBy("carrier").agg(F.count("*").alias("n"), F.max("t").alias("last"))


def spaced(s, d):
    return signal.spaced_peaks(samples(s, d), "x", 45.0, 2000)


def low_passed(s, d):
    return signal.fir(samples(s, d), "x", TAPS).select("carrier", "n", F.round("filtered", 6).alias("filtered"))


def bit_words(s, d) -> DataFrame:
    """(carrier, n, word) at every bit of streams made of orders: 16 orders to a batch after its sync word."""
    o = table(s, d, "orders").select(F.pmod("o_orderkey", F.lit(16)).alias("carrier"), F.floor(F.col("o_orderkey") / 16).alias("k"), "o_custkey", "o_orderkey")
    data = F.when(F.pmod("k", F.lit(4)) == 0, F.pmod(F.col("o_custkey") * 7919, F.lit(1 << 20))).otherwise((1 << 20) + F.pmod(F.col("o_orderkey") * 104729, F.lit(1 << 20)))
    data = F.coalesce(data, F.lit(0)).cast("long")
    # an unprotected word here: the parity bits are zero, as the walk doesn't decode
    word = F.when(F.pmod("k", F.lit(16)) == 15, F.lit(pages.IDLE)).otherwise(data * (1 << 11))
    at = (F.col("k") + F.floor(F.col("k") / 16) + 1) * 32
    sync = o.groupBy("carrier", F.floor(F.col("k") / 16).alias("b")).agg(F.lit(pages.SYNC).alias("word")).select("carrier", (F.col("b") * 17 * 32).alias("at"), "word")
    words = o.select("carrier", at.alias("at"), word.alias("word")).unionByName(sync)
    return words.select("carrier", F.col("at").cast("long").alias("n"), F.col("word").cast("long").alias("word"))


def batch_pages(s, d):
    return pages.batch_pages(pages.codewords(bit_words(s, d)).withColumnRenamed("word", "fixed"))


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64(k: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a bigint and an int that is not negative."""
    h = (np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(k.astype(np.uint64) * _P2, 31) * _P1)
    h = _mixed(_turned(h, 27) * _P1 + _P4)
    h = (h + _P5 + np.uint64(4)) ^ (i.astype(np.uint64) * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3).astype(np.int64)


def _framed(batches):
    i = np.arange(pages.FRAME_WORDS)
    for batch in batches:
        keys = batch.column(0).drop_null()
        k = keys.to_numpy()[:, None]
        words = np.abs(xxhash64(k, i)) % (1 << 21)
        words[(i > 3) & (i < 12) & ((k + i) % 5 == 0)] = 0
        words[:, :1] = 2 * 256 + k % 3 * 256 + (20 + k % 11) * 1024
        ends = pa.array(np.arange(len(k) + 1) * pages.FRAME_WORDS, pa.int32())
        conf = pa.StructArray.from_arrays([pa.array(((k + i) % 6 - 1).ravel(), pa.int32()), pa.array(((k * 7 + i) % 50 / 25).ravel())], ["status", "margin"])
        yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(words.ravel())), pa.ListArray.from_arrays(ends, conf)], ["frame_id", "words", "conf"])


def frames(s, d) -> DataFrame:
    """88 words of 21 bits and their confidence from the key of an order; an order without a key makes no frame."""
    orders = spread(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("frame_id")), "frame_id")
    return orders.mapInArrow(_framed, "frame_id long, words array<bigint>, conf array<struct<status:int,margin:double>>")


def frame_pages(s, d):
    return pages.frame_pages(frames(s, d)).select("frame_id", "slot", "capcode", "typ", F.md5("body").alias("body"), "conf.words", "conf.verified", "conf.corrected", "conf.chase", "conf.failed", "conf.margin")


_sum = " + ".join(f"coalesce({t!r}::DOUBLE * lag(x, {k}) OVER w, 0)" if k else f"{t!r}::DOUBLE * x" for k, t in enumerate(TAPS))

QUERIES = {
    "str9_jn9_txt6_coalesce": (near_equal, None),
    "acq3_spaced_peaks": (spaced, None),
    "dsp2_low_pass": (low_passed, f"SELECT carrier, n, round({_sum}, 6) AS filtered FROM ({SAMPLES}) WINDOW w AS (PARTITION BY carrier ORDER BY n)"),
    "prs1_batch_pages": (batch_pages, None),
    "prs7_8_frame_pages": (frame_pages, None),
}
