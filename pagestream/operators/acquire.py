"""Acquisition: sync templates, sliding correlation in chunks, and frames on the slots of a grid.

Samples (carrier, n, x) are dealt to chunks of CHUNK samples; each chunk also gets the first samples of the next one
(a halo as long as the template and a neighbour), so that a busy carrier spreads over many tasks and a chunk is all that
a task holds. Samples of a carrier are numbered without gaps.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions.specs import MODES
from pagestream.operators.signal import grid_phase, thinned

# The sync marker, samples a frame, from a template's start to the data, data symbols a 1000 baud.
MARKER, PERIOD, TO_DATA, SYMBOLS = 0xA6C6AAAA, 30_000, 1517.0, 1760
SPB = 10
CHUNK = 1 << 17


def template(code: int, spb: int = SPB) -> np.ndarray:
    """The sync of 64 bits as samples: the upper half of the code, the marker, the lower half; 1 is -1, 0 is +1."""
    value = code >> 16 << 48 | MARKER << 16 | code & 0xFFFF
    bits = np.array([value >> (63 - i) & 1 for i in range(64)])
    return np.repeat(1.0 - 2.0 * bits, spb)


@cache
def _templates(spb: int) -> dict[int, np.ndarray]:
    return {mode: template(code, spb) for mode, code, *_ in MODES}


def correlation(x: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Of each place where the whole pattern lies on x: their product over the norms of both, -1 to 1."""
    n, size = len(x) - len(pattern) + 1, len(pattern)
    if n <= 0:
        return np.zeros(0)
    length = 1 << (len(x) + size).bit_length()
    product = np.fft.irfft(np.fft.rfft(x, length) * np.conj(np.fft.rfft(pattern, length)), length)[:n]
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    return product / np.sqrt(np.maximum(sums[size:] - sums[:n], 1e-12) * size)


def chunks(samples: DataFrame, halo: int, size: int) -> DataFrame:
    """(carrier, chunk, n, x): each sample in its chunk, and in the one before if it is in its halo."""
    own = F.floor(F.col("n") / size)
    both = F.when((F.col("n") % size < halo) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    return samples.select("carrier", F.explode(both).alias("chunk"), "n", F.col("x").cast("double").alias("x"))


def sync_peaks(samples: DataFrame, height: float = 0.45, spb: int = SPB, period: int = PERIOD, chunk: int = CHUNK) -> DataFrame:
    """(carrier, mode, n, score): where each mode's sync stands out, at most one a frame less the sync's length."""
    size = 64 * spb

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        at, x = part["n"].to_numpy(), part["x"].to_numpy()
        first, out = int(part["chunk"].iloc[0]) * chunk, []
        for mode, pattern in _templates(spb).items():
            c = correlation(x, pattern)
            if len(c) > 2:
                k = np.flatnonzero((c[1:-1] > c[:-2]) & (c[1:-1] > c[2:]) & (c[1:-1] >= height)) + 1
                k = k[(at[k] > first) & (at[k] <= first + chunk)]  # the neighbours of a chunk's edge lie in the next
                out += [(part["carrier"].iloc[0], mode, int(at[i]), float(c[i])) for i in k]
        return pd.DataFrame(out, columns=["carrier", "mode", "n", "score"])

    kind = samples.schema["carrier"].dataType.simpleString()
    found = chunks(samples, size + 2, chunk).groupBy("carrier", "chunk").applyInPandas(run, f"carrier {kind}, mode int, n long, score double")
    return thinned(found, "score", max(1, period - size), "mode")


def dominant_mode(confident: DataFrame) -> DataFrame:
    """(carrier, mode): the commonest, ties to that of the first peak."""
    counted = confident.groupBy("carrier", "mode").agg(F.count("*").alias("c"), F.min(F.struct("n", "mode")).alias("first"))
    best = F.row_number().over(Window.partitionBy("carrier").orderBy(F.desc("c"), "first"))
    return counted.withColumn("r", best).where("r = 1").select("carrier", "mode")


def frames(samples: DataFrame, least: float = 0.35, confident: float = 0.6, spb: int = SPB, period: int = PERIOD, to_data: float = TO_DATA, symbols: int = SYMBOLS, chunk: int = CHUNK) -> DataFrame:
    """(carrier, k, mode, baud, levels, p0, nsyms, spb, score): the slots of each carrier's grid where the sync of its
    dominant mode correlates above `least`, with the first data sample; frames that end after the samples go."""
    size = 64 * spb
    peaks = sync_peaks(samples, spb=spb, period=period, chunk=chunk).where(F.col("score") > confident)
    spark = samples.sparkSession
    modes = spark.createDataFrame([(m, b, levels) for m, _, b, levels in MODES], "mode int, baud int, levels int")
    ends = samples.groupBy("carrier").agg((F.max("n") + 1).alias("total"))
    grid = grid_phase(peaks, "n", period).join(dominant_mode(peaks), "carrier").join(ends, "carrier").join(F.broadcast(modes), "mode")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("total") - 1 - F.col("phase")) / period)).cast("int")))
    slots = grid.select("*", k.alias("k")).withColumn("a", F.col("phase") + F.col("k") * period).withColumn("at", F.bround("a").cast("long"))
    slots = slots.where((F.col("at") >= 0) & (F.col("at") + size <= F.col("total")))
    asked = slots.select("carrier", F.floor(F.col("at") / chunk).alias("chunk"), "k", "mode", "at")

    def admit(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        x, out = part["x"].to_numpy(), []
        for carrier, k, mode, at in wanted[["carrier", "k", "mode", "at"]].itertuples(index=False) if len(part) else ():
            start = at - int(part["n"].iloc[0])
            score = correlation(x[start : start + size], _templates(spb)[mode])
            if len(score) and score[0] > least:
                out.append((carrier, k, float(score[0])))
        return pd.DataFrame(out, columns=["carrier", "k", "score"])

    kind = samples.schema["carrier"].dataType.simpleString()
    admitted = chunks(samples, size + 2, chunk).groupBy("carrier", "chunk").cogroup(asked.groupBy("carrier", "chunk")).applyInPandas(admit, f"carrier {kind}, k int, score double")
    step, n = (16_000 / F.col("baud") / 10 * spb).cast("int"), F.floor(F.col("baud") * symbols / 1000).cast("int") + 2
    p0 = F.bround(F.col("a") + to_data).cast("long")
    out = slots.join(admitted, ["carrier", "k"]).select("carrier", "k", "mode", "baud", "levels", p0.alias("p0"), n.alias("nsyms"), step.alias("spb"), "score", "total")
    return out.where("p0 >= 0 AND p0 + nsyms * spb < total - 1").drop("total")
