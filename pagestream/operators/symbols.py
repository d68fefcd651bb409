"""Resampling, channels, filter banks and slicers. Convolutions deal each sample to the outputs it reaches and add
up there, so that sums combine before the shuffle and no carrier is ordered in one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tones of the four levels in Hz, and the margin of a bit that no symbol carries.
TONES = (-4800.0, -1600.0, 1600.0, 4800.0)
UNUSED_MARGIN = 1000.0


def convolve(df: DataFrame, columns: list[str], taps: list[float], up: int = 1, down: int = 1, ahead: int = 0, keys: tuple[str, ...] = ("carrier",)) -> DataFrame:
    """keys, n and the columns: output n sums column * taps[n * down - i * up + ahead] over samples i (from 0).
    Outputs from 0 to the last sample's time; one that no sample reaches is zero and left out."""
    i = F.col("n").cast("long")
    first = F.greatest(F.ceil((i * up - ahead) / down), F.lit(0))
    last = F.floor((i * up - ahead + len(taps) - 1) / down)
    reached = df.where(last >= first).select(*keys, *columns, i.alias("i"), F.explode(F.sequence(first, last)).alias("n"))
    tap = F.element_at(F.lit(np.asarray(taps, float)), (F.col("n") * down - F.col("i") * up + ahead + 1).cast("int"))
    out = reached.groupBy(*keys, "n").agg(*[F.sum(F.col(c) * tap).alias(c) for c in columns])
    ends = df.groupBy(*keys).agg(F.ceil((F.max("n") + 1) * up / down).alias("__end"))
    return out.join(ends, list(keys)).where("n < __end").drop("__end")


def resampling_taps(up: int, down: int) -> list[float]:
    """Kaiser-windowed (beta 5) sinc, ten periods of the slower rate to each side, of gain `up` at zero frequency."""
    slow = max(up, down)
    k = np.arange(-10 * slow, 10 * slow + 1)
    shape = np.sinc(k / slow) * np.kaiser(len(k), 5.0)
    return (shape * (up / shape.sum())).tolist()


def resample(df: DataFrame, columns: list[str], in_rate: int, out_rate: int) -> DataFrame:
    """carrier, n and the columns at out_rate; equal rates give the rows back."""
    g = math.gcd(in_rate, out_rate)
    up, down = out_rate // g, in_rate // g
    if up == down:
        return df.select("carrier", "n", *columns)
    return convolve(df, columns, resampling_taps(up, down), up, down, 10 * max(up, down))


def channels(df: DataFrame, offsets: dict[str, float], rate: float, channel_rate: float, taps: list[float]) -> DataFrame:
    """(carrier, n, re, im) of every named channel of a wide capture (n, re, im): turned to the channel's offset,
    low-passed and decimated by the rounded ratio of the rates."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("carrier"), F.lit(float(v)).alias("offset")) for k, v in offsets.items()])).alias("c")
    a = F.col("n") * F.col("c.offset") * F.lit(-2 * math.pi / rate)
    turned = df.select("n", "re", "im", named).select("c.carrier", "n", (F.col("re") * F.cos(a) - F.col("im") * F.sin(a)).alias("re"), (F.col("re") * F.sin(a) + F.col("im") * F.cos(a)).alias("im"))
    return convolve(turned, ["re", "im"], taps, 1, round(rate / channel_rate))


def filter_bank(samples: DataFrame, symbols: DataFrame, baud: int, offset: Column | None = None, inverted: bool = False, rate: int = 250_000, base: int = 16_000) -> DataFrame:
    """Adds m0..m3: how strongly each tone sounds during a symbol. symbols has distinct rows with carrier and pos (the
    centre, at `base` samples a second); `offset` is the carrier's offset in Hz. A symbol's samples are found by
    number; those before the first or after the last are the first or the last."""
    length = round(rate / baud)
    ends = samples.groupBy("carrier").agg(F.max("n").alias("__last"))
    centre = F.col("pos") * (rate / base)
    steps = F.explode(F.sequence(F.lit(-(length // 2)), F.lit(length - length // 2 - 1)))
    spread = symbols.join(ends, "carrier").withColumn("__step", steps)
    numbered = spread.withColumn("n", F.greatest(F.lit(0), F.least("__last", F.rint(centre) + F.col("__step"))).cast("long"))
    met = numbered.join(samples.select("carrier", "n", "re", "im"), ["carrier", "n"])
    sums = []
    for k, tone in enumerate(TONES[::-1] if inverted else TONES):
        a = (F.lit(tone) + (F.lit(0.0) if offset is None else offset)) * (2 * math.pi / rate) * (F.col("n") - centre)
        sums += [F.sum(F.col("re") * F.cos(a) + F.col("im") * F.sin(a)).alias(f"__r{k}"), F.sum(F.col("im") * F.cos(a) - F.col("re") * F.sin(a)).alias(f"__i{k}")]
    return met.groupBy(*symbols.columns).agg(*sums).select(*symbols.columns, *[F.hypot(f"__r{k}", f"__i{k}").alias(f"m{k}") for k in range(4)])


def slice_fixed(value: Column, threshold: Column, dc: Column, levels: int) -> tuple[Column, Column, Column, Column]:
    """High bit (below dc), its margin, low bit (beyond the threshold to either side) and its margin."""
    v = value - dc
    if levels == 2:
        return (v < 0).cast("int"), F.abs(v), F.lit(0), F.lit(UNUSED_MARGIN)
    return (v < 0).cast("int"), F.abs(v), (F.abs(v) > threshold).cast("int"), F.abs(F.abs(v) - threshold)


def slice_nearest(value: Column, centres: Column, levels: int) -> tuple[Column, Column]:
    """High and low bit by the nearest of four ascending centres, ties to the lower one."""
    if levels == 2:
        middle = F.when(F.size(centres) == 4, (F.get(centres, F.lit(1)) + F.get(centres, F.lit(2))) / 2).otherwise(0.0)
        return (value < middle).cast("int"), F.lit(0)
    away = F.transform(centres, lambda c: F.abs(value - c))
    at = F.array_position(away, F.array_min(away))
    return (at <= 2).cast("int"), at.isin(1, 4).cast("int")


def _settle(values: np.ndarray, k: int, rounds: int) -> list[float]:
    centres = np.percentile(values, (np.arange(k) + 0.5) * (100 / k))
    for _ in range(rounds):
        side = np.searchsorted((centres[1:] + centres[:-1]) / 2, values)
        count = np.bincount(side, minlength=k)
        if k == 2 and not count.all():
            break
        mean = np.bincount(side, values, k) / np.maximum(count, 1)
        moved = np.sort(np.where(count > 0, mean, centres))
        done = np.abs(moved - centres).max() < 1e-4
        centres = moved
        if done:
            break
    return centres.tolist()


def level_centres(symbols: DataFrame, keys: list[str], column: str, k: int) -> DataFrame:
    """keys and centres (ascending): 1-D k-means of each frame's symbols (keys name a frame: a few thousand rows)
    from even percentiles, 20 rounds for two levels and 30 for four. Null values take no part."""
    fields = [symbols.schema[c] for c in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", centres array<double>"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _settle(frame[column].to_numpy(float), k, 20 if k == 2 else 30))], columns=[*keys, "centres"])

    return symbols.where(F.col(column).isNotNull()).select(*keys, column).groupBy(*keys).applyInPandas(run, schema)


def phases(bits: DataFrame, keys: list[str], baud: int) -> DataFrame:
    """(keys, phase, idx, bit, margin) of symbols (keys, symbol from 0, high, high_margin, low, low_margin). At 1600
    baud a symbol holds A and B, and C and D are zero; at 3200 even symbols hold A and B, odd ones C and D, and a
    last symbol without its partner goes."""
    named = lambda p, bit, margin: F.struct(F.lit(p).alias("phase"), bit.cast("int").alias("bit"), margin.cast("double").alias("margin"))
    if baud == 1600:
        none = F.lit(0), F.lit(UNUSED_MARGIN)
        parts = [named("A", F.col("high"), F.col("high_margin")), named("B", F.col("low"), F.col("low_margin")), named("C", *none), named("D", *none)]
        return bits.select(*keys, F.col("symbol").alias("idx"), F.explode(F.array(*parts)).alias("p")).select(*keys, "p.phase", "idx", "p.bit", "p.margin")
    odd = F.col("symbol") % 2
    one = lambda c, side: F.max(F.when(odd == side, F.col(c)))
    names = [(p, b, side) for side, pair in enumerate(("AB", "CD")) for p, b in zip(pair, ("high", "low"))]
    paired = bits.groupBy(*keys, F.floor(F.col("symbol") / 2).alias("idx")).agg(F.count("*").alias("n"), *[one(b, s).alias(f"{p}b") for p, b, s in names], *[one(f"{b}_margin", s).alias(f"{p}m") for p, b, s in names])
    parts = F.explode(F.array(*[named(p, F.col(f"{p}b"), F.col(f"{p}m")) for p, _, _ in names])).alias("p")
    return paired.where("n = 2").select(*keys, "idx", parts).select(*keys, "p.phase", "idx", "p.bit", "p.margin")


def bit_candidates(df: DataFrame, column: str, width: int = 8) -> DataFrame:
    """(carrier, phase, inverted, idx, bit): every start within a symbol of `width` samples, in both polarities."""
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("inverted")
    signed = F.when(F.col("inverted"), -F.col(column)).otherwise(F.col(column))
    return df.select("carrier", "n", column, both).select("carrier", F.pmod("n", F.lit(width)).alias("phase"), "inverted", F.floor(F.col("n") / width).alias("idx"), (signed > 0).cast("int").alias("bit"))


def timing_candidates(frames: DataFrame, half: int | None = None) -> DataFrame:
    """Rows of frames (p0, nsyms, baud, spb, total: samples there are) for every offset and parity that stays inside:
    adds offset, parity, start and count. half bounds the offsets; None takes half a symbol to each side."""
    low, high = (-(F.col("spb") / 2).cast("int"), F.col("spb") - (F.col("spb") / 2).cast("int") - 1) if half is None else (F.lit(-half), F.lit(half))
    tried = frames.withColumn("offset", F.explode(F.sequence(low, high))).withColumn("parity", F.explode(F.when(F.col("baud") == 3200, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = tried.withColumns({"start": F.col("p0") + F.col("offset") + F.col("parity") * F.col("spb"), "count": F.col("nsyms") - F.col("parity")})
    return placed.where((F.col("start") >= 0) & (F.col("start") + (F.col("count") - 1) * F.col("spb") < F.col("total") - 1))


def fewest_failures(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, failures, parity, offset) of each frame's best candidate: ties to parity 0, then the lower offset."""
    return scored.groupBy(*keys).agg(F.min(F.struct("failures", "parity", "offset")).alias("m")).select(*keys, "m.*")
