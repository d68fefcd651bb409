"""Sample-level operators as window functions; a carrier's samples are ordered by n."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the sync word of POCSAG.
SYNC = 0x7CD215D8


def by_carrier(carrier: str = "carrier", n: str = "n") -> Window:
    return Window.partitionBy(carrier).orderBy(n)


def derotate(df: DataFrame, offset: float, rate: float) -> DataFrame:
    """(re, im) turned back by the offset, by absolute sample number, so that chunks agree."""
    a = F.col("n") * F.lit(-2 * math.pi * offset / rate)
    return df.withColumns({"re": F.col("re") * F.cos(a) - F.col("im") * F.sin(a), "im": F.col("re") * F.sin(a) + F.col("im") * F.cos(a)})


def lag_product(df: DataFrame) -> DataFrame:
    """cross and dot of each sample with the one before; the first sample of a carrier goes."""
    w = by_carrier()
    re1, im1 = F.lag("re").over(w), F.lag("im").over(w)
    return df.withColumns({"cross": F.col("im") * re1 - F.col("re") * im1, "dot": F.col("re") * re1 + F.col("im") * im1}).where("cross IS NOT NULL")


def fm_demod(df: DataFrame) -> DataFrame:
    return lag_product(df).withColumn("phase", F.atan2("cross", "dot"))


def estimate_offset(df: DataFrame, rate: float) -> DataFrame:
    """Residual offset of each carrier: the angle of the summed lag products."""
    return lag_product(df).groupBy("carrier").agg((F.atan2(F.sum("cross"), F.sum("dot")) * F.lit(rate / (2 * math.pi))).alias("offset_hz"))


def boxcar(df: DataFrame, column: str, m: int) -> DataFrame:
    """Centred moving sum over m samples by m, zeros beyond the ends (even m: one more before)."""
    w = by_carrier().rowsBetween(-(m // 2), m - m // 2 - 1)
    return df.withColumn(f"{column}_box", F.sum(column).over(w) / m)


def dc_block(df: DataFrame, column: str, m: int) -> DataFrame:
    """Less the centred moving average; a carrier shorter than m loses its mean."""
    w = by_carrier().rowsBetween(-(m // 2), m - m // 2 - 1)
    whole = Window.partitionBy("carrier")
    level = F.when(F.count("*").over(whole) < m, F.avg(column).over(whole)).otherwise(F.sum(column).over(w) / m)
    return df.withColumn(f"{column}_ac", F.col(column) - level)


def soft_bits(m: list[Column]) -> tuple[Column, Column, Column, Column]:
    """High and low bit of a 4-tone symbol from its magnitudes, and their reliabilities."""
    high = F.greatest(m[2], m[3]) - F.greatest(m[0], m[1])
    low = F.greatest(m[1], m[2]) - F.greatest(m[0], m[3])
    return (high > 0).cast("int"), F.abs(high), (low > 0).cast("int"), F.abs(low)


def grid_phase(df: DataFrame, position: str, period: float) -> DataFrame:
    """Circular mean of the positions within the period, for each carrier."""
    a = F.col(position) * F.lit(2 * math.pi / period)
    angle = F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))
    return df.groupBy("carrier").agg((F.pmod(angle * F.lit(period / (2 * math.pi)), F.lit(period))).alias("phase"))


def comb_fit(df: DataFrame, position: str, period: float) -> DataFrame:
    """Least-squares line of the positions over their slot numbers; a period off by more than 5 is set back."""
    k = F.bround(F.col(position) / period)
    fit = df.withColumn("k", k).groupBy("carrier").agg(F.regr_slope(position, "k").alias("slope"), F.avg(position).alias("mp"), F.avg("k").alias("mk"), F.count("*").alias("n"))
    slope = F.when(F.abs(F.col("slope") - period) > 5, F.lit(period)).otherwise(F.col("slope"))
    return fit.where("n >= 2 AND slope IS NOT NULL").select("carrier", slope.alias("slope"), (F.col("mp") - slope * F.col("mk")).alias("intercept"))


def comb_slots(anchors: DataFrame, position: str, ends: DataFrame, span: float, period: float) -> DataFrame:
    """carrier, k, pred: the slots without an anchor, k slots from a carrier's first one, on the comb fitted to its
    anchors and carried on both ways over the whole capture. ends: carrier, total (samples of the capture); a slot
    lasts `span` samples and lies within it. Carriers with one anchor get none."""
    first = anchors.groupBy("carrier").agg(F.min(position).alias("first"))
    at = anchors.join(first, "carrier").select("carrier", F.col(position).cast("double").alias("p"), F.bround((F.col(position) - F.col("first")) / period).cast("long").alias("k"))
    fit = at.groupBy("carrier").agg(F.regr_slope("p", "k").alias("s"), F.avg("p").alias("mp"), F.avg("k").alias("mk"), F.count("p").alias("n")).where("n >= 2")
    b = F.when(F.abs(F.col("s") - period) <= 5, F.col("s")).otherwise(F.lit(period))
    comb = fit.withColumn("b", b).withColumn("a", F.col("mp") - F.col("b") * F.col("mk")).join(ends, "carrier")
    low = F.floor(-F.col("a") / F.col("b"))
    high = F.bround((F.col("total") - F.col("a") - span) / F.col("b")).cast("long")
    slots = comb.where(low <= high).select("carrier", "a", "b", "total", F.explode(F.sequence(low, high)).alias("k")).withColumn("pred", F.col("a") + F.col("b") * F.col("k"))
    inside = slots.where((F.col("pred") >= 0) & (F.col("pred") + span < F.col("total") - 1))
    return inside.select("carrier", "k", "pred").join(at.select("carrier", "k"), ["carrier", "k"], "left_anti")


def local_peaks(df: DataFrame, column: str, height: float) -> DataFrame:
    w = by_carrier()
    return df.withColumns({"__b": F.lag(column).over(w), "__a": F.lead(column).over(w)}).where((F.col(column) > F.col("__b")) & (F.col(column) > F.col("__a")) & (F.col(column) >= height)).drop("__a", "__b")


def rolling_word(df: DataFrame, bit: str, width: int = 32, keys: tuple[str, ...] = ("carrier",)) -> DataFrame:
    """The last `width` bits as a number, from the width-th bit of a carrier (or of other keys) on."""
    w = Window.partitionBy(*keys).orderBy("n")
    word = None
    for k in range(width):
        term = F.lag(bit, k).over(w).cast("long") * F.lit(1 << k)
        word = term if word is None else word + term
    return df.withColumn("word", word).where("word IS NOT NULL")


def sync_phase(df: DataFrame, soft: str, sync: int = SYNC, osr: int = 8) -> DataFrame:
    """carrier, hits, candidate: the sampling phase (n mod osr) and polarity, as phase * 2 + (1 if inverted), whose
    every osr-th sample gives most 32-bit words within 2 bits of the sync word; ties to the earlier candidate. A
    carrier without such a word has no row."""
    x = F.col(soft)
    signs = F.array(*[F.struct(F.lit(i).alias("inverted"), F.coalesce(b & ~F.isnan(x), F.lit(False)).cast("int").alias("bit")) for i, b in ((0, x > 0), (1, x < 0))])
    dealt = df.select("carrier", "n", F.pmod("n", F.lit(osr)).alias("phase"), F.explode(signs).alias("s")).select("carrier", "n", (F.col("phase") * 2 + F.col("s.inverted")).cast("int").alias("c"), "s.bit")
    words = rolling_word(dealt, "bit", 32, ("carrier", "c"))
    hits = words.where(F.bit_count(F.col("word").bitwiseXOR(F.lit(sync))) <= 2).groupBy("carrier", "c").agg(F.count("*").alias("p"))
    return hits.groupBy("carrier").agg(F.max(F.struct("p", (-F.col("c")).alias("c"))).alias("m")).select("carrier", F.col("m.p").alias("hits"), (-F.col("m.c")).alias("candidate"))


def _thin(distance: int):
    """Of the peaks of an island, the highest first, each that has no kept one within the distance."""

    def run(frames):
        held, at = [], None

        def settle():
            taken: list[int] = []
            for n, _ in sorted(held, key=lambda p: (-p[1], -p[0])):
                i = bisect.bisect(taken, n)
                if all(abs(n - m) >= distance for m in taken[max(0, i - 1) : i + 1]):
                    taken.insert(i, n)
            return [(at[0], n) for n in taken]

        for frame in frames:
            out = []
            for key, island, n, height in frame.itertuples(index=False):
                if (key, island) != at:
                    out += settle() if held else []
                    held, at = [], (key, island)
                held.append((n, height))
            yield pd.DataFrame(out, columns=["id", "n"], dtype="int64")
        if held:
            yield pd.DataFrame(settle(), columns=["id", "n"], dtype="int64")

    return run


def spaced_peaks(df: DataFrame, column: str, height: float, distance: int) -> DataFrame:
    """(carrier, n) of local peaks at least `distance` apart, higher ones first, ties to the later."""
    return thinned(local_peaks(df, column, height), column, distance).select("carrier", "n")


def thinned(peaks: DataFrame, column: str, distance: int, *keys: str) -> DataFrame:
    """(carrier, keys, n, column) of the peaks (carrier, n) that stay when the higher goes first and none may lie within
    the distance of one that stays. Peaks farther apart than that don't meet, so carriers are cut at such gaps and the
    islands thinned apart."""
    p = peaks.select(F.struct("carrier", *keys).alias("key"), "n", F.col(column).alias("h"))
    w = Window.partitionBy("key").orderBy("n")
    island = p.withColumn("island", F.sum(F.when(F.col("n") - F.lag("n").over(w) >= distance, 1).otherwise(0)).over(w)).withColumn("id", F.xxhash64("key"))
    dealt = island.repartition("id", "island").sortWithinPartitions("id", "island", "n")
    stay = dealt.select("id", "island", "n", "h").mapInPandas(_thin(distance), "id long, n long")
    return p.withColumn("id", F.xxhash64("key")).join(stay, ["id", "n"]).select("key.*", "n", F.col("h").alias(column))


def fir(df: DataFrame, column: str, taps: list[float]) -> DataFrame:
    """Adds filtered: the causal convolution with the taps; samples before the first are zero. One window serves
    all taps: the last len(taps) samples as an array, folded with the taps."""
    m = len(taps)
    last = F.reverse(F.collect_list(column).over(by_carrier().rowsBetween(1 - m, 0)))
    weights = F.array(*[F.lit(float(t)) for t in taps])
    terms = F.zip_with(last, F.slice(weights, F.lit(1), F.size(last)), lambda x, t: x * t)
    return df.withColumn("filtered", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def low_pass(taps: int, cutoff: float, rate: float) -> list[float]:
    """Hamming-windowed sinc of gain 1 at zero frequency."""
    middle = (taps - 1) / 2
    sinc = [1.0 if k == middle else math.sin(x := 2 * math.pi * cutoff / rate * (k - middle)) / x for k in range(taps)]
    shaped = [s * (0.54 - 0.46 * math.cos(2 * math.pi * k / (taps - 1))) for k, s in enumerate(sinc)]
    return [s / sum(shaped) for s in shaped]
