"""Resampling, filter banks, level centres, the chase decoder and quoting against plain forms of the same rules."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagestream.functions import fec
from pagestream.operators import reports, signal
from pagestream.operators import symbols as S


def rows_of(spark, x, carrier="a"):
    return spark.createDataFrame([(carrier, i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "carrier string, n long, re double, im double")


@pytest.mark.parametrize("rates", [(25, 16), (16, 24), (9, 9)])
def test_resample(spark, rates):
    x = np.random.default_rng(1).normal(size=90)
    g = np.gcd(*rates)
    up, down = rates[1] // g, rates[0] // g
    got = [r.re for r in S.resample(rows_of(spark, x), ["re"], *rates).orderBy("n").collect()]
    if up == down:
        want = x
    else:
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        half = 10 * max(up, down)
        full = np.convolve(stuffed, S.resampling_taps(up, down))[half:]
        want = full[: len(x) * up : down]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_resample_keeps_a_slow_tone(spark):
    t = np.arange(2500) / 250_000
    got = np.array([r.re for r in S.resample(rows_of(spark, np.cos(2 * np.pi * 500 * t)), ["re"], 250_000, 16_000).orderBy("n").collect()])
    assert len(got) == 160
    np.testing.assert_allclose(got[25:-25], np.cos(2 * np.pi * 500 * np.arange(160) / 16_000)[25:-25], atol=5e-3)


def test_channels_find_their_carriers(spark):
    n = np.arange(4000)
    wide = np.exp(2j * np.pi * 40_000 / 250_000 * n)
    taps = signal.low_pass(101, 9_000, 250_000)
    got = S.channels(rows_of(spark, wide).drop("carrier"), {"there": 40_000.0, "silent": -60_000.0}, 250_000, 25_000, taps)
    power = {r.carrier: r.p for r in got.where("n > 20").groupBy("carrier").agg(F.avg(F.hypot("re", "im")).alias("p")).collect()}
    assert power["there"] == pytest.approx(1, abs=1e-3) and power["silent"] < 0.01


def test_filter_bank(spark):
    levels = [0, 3, 1, 2, 2, 0]
    tones, baud = np.array(S.TONES), 1600
    x = np.concatenate([np.exp(2j * np.pi * (tones[v] + 90) / 250_000 * np.arange(156)) for v in levels])
    at = spark.createDataFrame([("a", k, (k + 0.5) * 156 * 16_000 / 250_000) for k in range(len(levels))], "carrier string, symbol long, pos double")
    for inverted in (False, True):
        got = S.filter_bank(rows_of(spark, x), at, baud, F.lit(90.0), inverted).orderBy("symbol").collect()
        found = [int(np.argmax([r[f"m{k}"] for k in range(4)])) for r in got]
        assert found == [3 - v if inverted else v for v in levels]
        for r, v in zip(got, levels):
            assert max(r[f"m{k}"] for k in range(4)) == pytest.approx(156, rel=1e-6)
    edge = spark.createDataFrame([("a", 0, 0.0)], "carrier string, symbol long, pos double")
    i = np.clip(np.arange(-78, 78), 0, len(x) - 1)
    want = [abs(np.sum(x[i] * np.exp(-2j * np.pi * t / 250_000 * i))) for t in tones]
    np.testing.assert_allclose([S.filter_bank(rows_of(spark, x), edge, baud).first()[f"m{k}"] for k in range(4)], want, rtol=1e-6)


def test_level_centres(spark):
    r = random.Random(3)
    values = [(f, c + r.gauss(0, 0.1)) for f in (1, 2) for c in (-3, -1, 1.2, 3.5) for _ in range(60)] + [(3, 7.0), (4, None)]
    df = spark.createDataFrame(values, "frame long, v double")
    got = {x.frame: x.centres for x in S.level_centres(df, ["frame"], "v", 4).collect()}
    assert sorted(got) == [1, 2, 3] and got[3] == [7.0] * 4
    np.testing.assert_allclose(got[1], [-3, -1, 1.2, 3.5], atol=0.1)
    two = {x.frame: x.centres for x in S.level_centres(df.where("frame < 4 AND v > 0"), ["frame"], "v", 2).collect()}
    np.testing.assert_allclose(two[1], [1.2, 3.5], atol=0.1)
    assert two[3] == [7.0, 7.0]


def test_phases_of_slow_frames(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 0, 0.7), (1, 0, 0.2, 1, 0.1)], "symbol long, high int, high_margin double, low int, low_margin double")
    got = sorted(tuple(r) for r in S.phases(df, [], 1600).select("phase", "idx", "bit", "margin").collect())
    assert got == [("A", 0, 1, 0.5), ("A", 1, 0, 0.2), ("B", 0, 0, 0.7), ("B", 1, 1, 0.1), ("C", 0, 0, 1000.0), ("C", 1, 0, 1000.0), ("D", 0, 0, 1000.0), ("D", 1, 0, 1000.0)]


def test_chase(spark):
    """Of the words that flipping weak bits leads to, the one whose changed bits weigh least."""
    r = random.Random(5)
    table = fec.error_table()

    def plain(word, weight):
        weak = sorted(range(32), key=lambda b: (weight[b], b))[:4]
        best = None
        for pattern in range(16):
            tried = word
            for k, b in enumerate(weak):
                if pattern >> k & 1:
                    tried ^= 1 << b
            left = fec.syndrome_of(tried)
            if left and left not in table:
                continue
            word_out = tried ^ table.get(left, 0) if left else tried
            cost = sum(weight[b] for b in range(32) if (word_out ^ word) >> b & 1)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, word_out)
        return None if best is None else best[1]

    cases = []
    for n in itertools.chain([0, 1, 2], [3] * 6, [4] * 4):
        word = fec.encode(r.randrange(1 << 21))
        weight = [r.uniform(1, 2) for _ in range(32)]
        for b in r.sample(range(32), n):
            word ^= 1 << b
            weight[b] = r.uniform(0, 0.5)
        cases.append((word, weight))
    df = spark.createDataFrame([(i, w, m[::-1]) for i, (w, m) in enumerate(cases)], "i long, w long, m array<double>")
    got = {x.i: x.c for x in df.select("i", fec.chase_decode(F.col("w"), F.col("m")).alias("c")).collect()}
    for i, (word, weight) in enumerate(cases):
        assert got[i] == plain(word, weight)


def test_quoted(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "tab\tnew\nline\r\x00\x1f\x7f", "back\\slash", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.q for r in df.select("i", reports.quoted(F.col("t")).alias("q")).orderBy("i").collect()] == [repr(t) for t in texts]


def test_sync_phase_reads_every_eighth_sample(spark):
    """Planted sync words, two wrong bits at most, at one phase of eight samples a symbol; noise at the others."""
    r = np.random.default_rng(7)

    def capture(phase, inverted, flips):
        bits = r.integers(0, 2, 600)
        for start in (0, 200, 500):
            bits[start : start + 32] = [signal.SYNC >> (31 - k) & 1 for k in range(32)]
            bits[start + r.choice(32, flips, replace=False)] ^= 1
        y = r.normal(size=4800)
        y[phase::8] = (bits * 2 - 1) * (-1 if inverted else 1)
        return y

    captures = {"a": capture(5, False, 0), "b": capture(0, True, 2), "c": capture(3, False, 3), "short": np.ones(200)}
    df = spark.createDataFrame([(c, i, float(v)) for c, y in captures.items() for i, v in enumerate(y)], "carrier string, n long, y double")
    got = {x.carrier: (x.hits, x.candidate) for x in signal.sync_phase(df, "y").collect()}
    assert got == {"a": (3, 10), "b": (3, 1)}


def test_comb_slots_go_on_to_both_ends(spark):
    """Anchors late in a capture of ten slots; the slots before and after them are found too."""
    anchors = spark.createDataFrame([("a", 30_001.0 * k + 700) for k in (6, 7)] + [("off", 100.0), ("off", 30_200.0)] + [("one", 5.0)], "carrier string, p double")
    ends = spark.createDataFrame([("a", 300_800), ("off", 95_000), ("one", 300_800)], "carrier string, total long")
    got = {(r.carrier, r.k): r.pred for r in signal.comb_slots(anchors, "p", ends, 28_160.0, 30_000.0).collect()}
    want = {("a", k): 30_001.0 * (k + 6) + 700 for k in (-6, -5, -4, -3, -2, -1, 2, 3)}
    want[("off", 2)] = 60_150.0  # a period of 30,100 is set back to 30,000
    assert got == pytest.approx(want)


def test_plan_lines_far_from_the_centre(spark):
    """Offsets of more than 8 characters: the query's fixed field loses the last ones, as lpad in its SQL; the operator's doesn't."""
    import duckdb

    from pagestream.plans import symbols

    spark.range(1, 900_001, 8_191).withColumnRenamed("id", "c_custkey").createOrReplaceTempView("far_customers")
    customers = spark.table("far_customers")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer(c_custkey BIGINT)")
    duck.executemany("INSERT INTO customer VALUES (?)", [(r.c_custkey,) for r in customers.collect()])
    want = sorted(duck.execute(symbols.QUERIES["snk12_plan"][1]).fetchall())
    carriers = customers.select((F.col("c_custkey") * 12_500.0 + 929_000_000).alias("carrier"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("flex"), F.lit("pocsag"))).otherwise(F.array(F.lit("flex"))).alias("protocols"))
    got = sorted(tuple(r) for r in reports.plan_lines(carriers, 930_000_000.0, 2_500_000.0, field=8).collect())
    assert got == want
    shown = [r.line for r in reports.plan_lines(carriers, 930_000_000.0, 2_500_000.0).orderBy("carrier").collect()]
    assert all(f"offset {(w[0] - 930e6) / 1e3:+8.1f} kHz" in line for w, line in zip(want, shown))
