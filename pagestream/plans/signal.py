"""Queries of sample-level operators over stand-in samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestream.operators import signal as S
from pagestream.operators.messages import micros
from pagestream.plans.base import SAMPLES, samples, table

_LAG = f"SELECT *, im * lag(re) OVER w - re * lag(im) OVER w AS cross_, re * lag(re) OVER w + im * lag(im) OVER w AS dot FROM ({SAMPLES}) WINDOW w AS (PARTITION BY carrier ORDER BY n)"
_E = "epoch_us(ts)::DOUBLE / 1000 % 480000000"


def derotated(s, d):
    return S.derotate(samples(s, d), 300.0, 250_000.0).select("carrier", "n", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


def demodulated(s, d):
    return S.fm_demod(samples(s, d)).select("carrier", "n", F.round("phase", 6).alias("phase"))


def offsets(s, d):
    return S.estimate_offset(samples(s, d), 16_000.0).select("carrier", F.round("offset_hz", 3).alias("offset_hz"))


def filtered(s, d):
    return S.dc_block(S.boxcar(samples(s, d), "x", 10), "x", 16).select("carrier", "n", F.round("x_box", 6).alias("box"), F.round("x_ac", 6).alias("ac"))


def median_removed(s, d):
    x = samples(s, d)
    level = x.groupBy("carrier").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return x.join(level, "carrier").select("carrier", "n", F.round(F.col("x") - F.col("m"), 6).alias("x"))


def soft(s, d):
    """Soft bits of 4-tone symbols, dealt to phases by symbol parity."""
    e = table(s, d, "embeddings").where("embedding IS NOT NULL")
    q = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(i.alias("symbol"), F.transform(F.slice("embedding", i * 4 + 1, 4), lambda v: F.abs(v.cast("double"))).alias("m"))))
    x = e.select("vec_id", q.alias("q")).select("vec_id", "q.symbol", *[F.get("q.m", F.lit(k)).alias(f"m{k}") for k in range(4)])
    hi, hr, lo, lr = S.soft_bits([F.col(f"m{k}") for k in range(4)])
    return x.select("vec_id", "symbol", F.when(F.col("symbol") % 2 == 0, "AB").otherwise("CD").alias("phases"), hi.alias("high"), F.round(hr, 6).alias("high_margin"), lo.alias("low"), F.round(lr, 6).alias("low_margin"))


def correlation(s, d):
    """Normalised correlation of each 64-long vector with a +-1 template."""
    e = table(s, d, "embeddings").where("embedding IS NOT NULL")
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.transform(v, lambda x, i: F.when(i % 3 == 0, x).otherwise(-x)), F.lit(0.0), lambda a, b: a + b)
    energy = F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
    return e.select("vec_id", F.round(dot / F.sqrt(F.greatest(F.lit(1e-12), energy) * 64), 5).alias("score"))


def peaks(s, d):
    return S.local_peaks(samples(s, d), "x", 45.0).select("carrier", "n")


def phases(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("carrier"), (micros("ts") / 1000 % 480000000).alias("p"))
    return S.grid_phase(e, "p", 30_000.0).select("carrier", F.round("phase", 2).alias("phase"))


def comb(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("carrier"), (micros("ts") / 1000 % 480000000).alias("p"))
    return S.comb_fit(e, "p", 30_000.0).select("carrier", F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"))


def missing_slots(s, d):
    """Slots of the grid without an event, between each carrier's first and last; comb_slots goes on beyond them."""
    e = table(s, d, "events").select(F.col("event_type").alias("carrier"), F.floor(micros("ts") / 600_000_000).alias("slot"))
    ends = e.groupBy("carrier").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    return ends.select("carrier", F.explode(F.sequence("a", "b")).alias("slot")).join(e, ["carrier", "slot"], "left_anti")


def comb_slots(s, d):
    """Missed slots of stand-in captures of 100 slots, with anchors in slots 40 to 60 only."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("carrier"))
    k = n.select("carrier", F.explode(F.sequence(F.lit(40), F.lit(60))).alias("k")).where("k * (carrier + 1) % 3 != 0")
    anchors = k.select("carrier", (F.col("k") * 30001 + 500 + F.col("carrier") * 10 + F.pmod("k", F.lit(3))).alias("p"))
    return S.comb_slots(anchors, "p", n.withColumn("total", F.lit(3_007_000)), 28_160.0, 30_000.0).select("carrier", "k", F.round("pred", 2).alias("pred"))


def best_phase(s, d):
    """The phase and polarity with the most words near half a sync word, over 16 consecutive samples; ties to the
    earlier candidate. sync_phase reads every eighth sample and the whole sync word."""
    e = samples(s, d).select("carrier", "n", (F.col("x") > 50).cast("int").alias("bit"))
    w = S.rolling_word(e, "bit", 16).withColumn("phase", F.pmod("n", F.lit(8)))
    near = lambda inverse: F.count_if(F.bit_count(F.col("word").bitwiseXOR(F.lit(0x7CD2 ^ (0xFFFF if inverse else 0)))) <= 5)
    hits = w.groupBy("carrier", "phase").agg(near(False).alias("p"), near(True).alias("q"))
    both = hits.select("carrier", F.explode(F.array(F.struct("p", (F.col("phase") * 2).alias("c")), F.struct(F.col("q").alias("p"), (F.col("phase") * 2 + 1).alias("c")))).alias("x")).select("carrier", "x.p", "x.c").where("p > 0")
    return both.groupBy("carrier").agg(F.max(F.struct("p", (-F.col("c")).alias("c"))).alias("m")).select("carrier", F.col("m.p").alias("hits"), (-F.col("m.c")).alias("candidate"))


def sync_phase(s, d):
    """Best phase and polarity of stand-in captures of eight samples a symbol: batches of 544 symbols, the first 32 of
    them the sync word with up to 2 flipped bits (3 on each fifth carrier), read right at one phase only."""
    n, c = F.col("n"), F.col("carrier")
    x = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("carrier"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13055).cast("long"))).alias("n"))
    at = F.pmod(F.floor(n / 8), F.lit(544))
    sync = F.expr(f"shiftright({S.SYNC}L, cast(greatest(0, 31 - pmod(floor(n / 8), 544)) AS int)) & 1")
    flips = F.when(c % 5 == 4, 3).otherwise(c % 3)
    bit = F.when(at < 32, F.when(at < flips, 1 - sync).otherwise(sync)).otherwise((F.pmod(at * at * 31 + c, F.lit(7)) < 3).cast("long"))
    clean = (bit * 2 - 1) * (1 - (c % 2) * 2)
    noise = F.pmod(n * n * 7919 + n * 31 + c * 104729, F.lit(1009)) - 504
    return S.sync_phase(x.select("carrier", "n", F.when(n % 8 == c % 8, clean).otherwise(noise).cast("double").alias("y")), "y")


_word32 = " + ".join(f"lag(bit, {k}) OVER w * {1 << k}" for k in range(32))
_word = " + ".join(f"lag(bit, {k}) OVER w * {1 << k}" for k in range(16))

QUERIES = {
    "dsp1_derotate": (derotated, f"SELECT carrier, n, round(re * cos(a) - im * sin(a), 6) AS re, round(re * sin(a) + im * cos(a), 6) AS im FROM (SELECT *, n * (-2 * pi() * 300.0 / 250000.0) AS a FROM ({SAMPLES}))"),
    "dsp4_fm_demod": (demodulated, f"SELECT carrier, n, round(atan2(cross_, dot), 6) AS phase FROM ({_LAG}) WHERE cross_ IS NOT NULL"),
    "dsp9_offset": (offsets, f"SELECT carrier, round(atan2(sum(cross_), sum(dot)) * 16000.0 / (2 * pi()), 3) AS offset_hz FROM ({_LAG}) WHERE cross_ IS NOT NULL GROUP BY carrier"),
    "dsp6_7_filters": (filtered, f"SELECT carrier, n, round(sum(x) OVER (PARTITION BY carrier ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS box, round(x - CASE WHEN count(*) OVER (PARTITION BY carrier) < 16 THEN avg(x) OVER (PARTITION BY carrier) ELSE sum(x) OVER (PARTITION BY carrier ORDER BY n ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) / 16 END, 6) AS ac FROM ({SAMPLES})"),
    "dsp8_median": (median_removed, f"SELECT carrier, n, round(x - quantile_cont(x, 0.5) OVER (PARTITION BY carrier), 6) AS x FROM ({SAMPLES})"),
    "dsp11_12_soft_bits": (soft, """SELECT vec_id, symbol, CASE WHEN symbol % 2 = 0 THEN 'AB' ELSE 'CD' END AS phases, (greatest(c, d) - greatest(a, b) > 0)::INT AS high, round(abs(greatest(c, d) - greatest(a, b)), 6) AS high_margin, (greatest(b, c) - greatest(a, d) > 0)::INT AS low, round(abs(greatest(b, c) - greatest(a, d)), 6) AS low_margin FROM (
 SELECT vec_id, symbol, abs(embedding[symbol * 4 + 1]::DOUBLE) AS a, abs(embedding[symbol * 4 + 2]::DOUBLE) AS b, abs(embedding[symbol * 4 + 3]::DOUBLE) AS c, abs(embedding[symbol * 4 + 4]::DOUBLE) AS d FROM (SELECT *, unnest(range(0, 16))::INT AS symbol FROM embeddings WHERE embedding IS NOT NULL))"""),
    "acq2_correlation": (correlation, "SELECT vec_id, round(sum(CASE WHEN i % 3 = 0 THEN v ELSE -v END) / sqrt(greatest(1e-12, sum(v * v)) * 64), 5) AS score FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL) GROUP BY vec_id"),
    "acq3_local_peaks": (peaks, f"SELECT carrier, n FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM ({SAMPLES}) WINDOW w AS (PARTITION BY carrier ORDER BY n)) WHERE x > a AND x > b AND x >= 45"),
    "acq7_grid_phase": (phases, f"SELECT carrier, round((((f * 30000.0 / (2 * pi())) % 30000.0) + 30000.0) % 30000.0, 2) AS phase FROM (SELECT user_id AS carrier, atan2(avg(sin(2 * pi() / 30000.0 * ({_E}))), avg(cos(2 * pi() / 30000.0 * ({_E})))) AS f FROM events GROUP BY user_id)"),
    "acq11_comb_fit": (comb, f"SELECT carrier, round(s, 4) AS slope, round(mp - s * mk, 1) AS intercept FROM (SELECT *, CASE WHEN abs(slope - 30000) > 5 THEN 30000 ELSE slope END AS s FROM (SELECT user_id AS carrier, regr_slope(p, k) AS slope, avg(p) AS mp, avg(k) AS mk, count(*) AS n FROM (SELECT user_id, {_E} AS p, round_even(({_E}) / 30000, 0) AS k FROM events) GROUP BY user_id) WHERE n >= 2 AND slope IS NOT NULL AND NOT isnan(slope))"),
    "acq8_missing_slots": (missing_slots, "WITH e AS (SELECT event_type AS carrier, epoch_us(ts) // 600000000 AS slot FROM events) SELECT carrier, slot FROM (SELECT carrier, unnest(range(min(slot), max(slot) + 1)) AS slot FROM e GROUP BY carrier) EXCEPT SELECT carrier, slot FROM e"),
    "acq13_14_best_phase": (best_phase, f"""WITH b AS (SELECT carrier, n, (x > 50)::BIGINT AS bit FROM ({SAMPLES})), w AS (SELECT carrier, n % 8 AS phase, {_word} AS word FROM b WINDOW w AS (PARTITION BY carrier ORDER BY n)),
 h AS (SELECT carrier, phase * 2 AS c, count(*) FILTER (bit_count(xor(word, {0x7CD2}::BIGINT)) <= 5) AS p FROM w WHERE word IS NOT NULL GROUP BY carrier, phase UNION ALL SELECT carrier, phase * 2 + 1, count(*) FILTER (bit_count(xor(word, {0x7CD2 ^ 0xFFFF}::BIGINT)) <= 5) FROM w WHERE word IS NOT NULL GROUP BY carrier, phase)
 SELECT carrier, p AS hits, c AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY p DESC, c) AS r FROM h WHERE p > 0) WHERE r = 1"""),
    "acq13_14_sync_phase": (sync_phase, f"""WITH x AS (SELECT n_nationkey::BIGINT AS carrier, unnest(range(0, 13056)) AS n FROM nation), t AS (SELECT *, n // 8 % 544 AS k, CASE WHEN carrier % 5 = 4 THEN 3 ELSE carrier % 3 END AS flips FROM x),
 b AS (SELECT *, CASE WHEN k < 32 THEN CASE WHEN k < flips THEN 1 - sync ELSE sync END ELSE ((k * k * 31 + carrier) % 7 < 3)::BIGINT END AS sent FROM (SELECT *, ({S.SYNC}::BIGINT >> greatest(0, 31 - k)::INT) & 1 AS sync FROM t)),
 y AS (SELECT carrier, n, CASE WHEN n % 8 = carrier % 8 THEN (sent * 2 - 1) * (1 - carrier % 2 * 2) ELSE (n * n * 7919 + n * 31 + carrier * 104729) % 1009 - 504 END AS y FROM b),
 p AS (SELECT carrier, n, n % 8 * 2 AS c, (y > 0)::BIGINT AS bit FROM y UNION ALL SELECT carrier, n, n % 8 * 2 + 1, (y < 0)::BIGINT FROM y), w AS (SELECT carrier, c, {_word32} AS word FROM p WINDOW w AS (PARTITION BY carrier, c ORDER BY n)),
 h AS (SELECT carrier, c, count(*) AS p FROM w WHERE bit_count(xor(word, {S.SYNC}::BIGINT)) <= 2 GROUP BY carrier, c)
 SELECT carrier, p AS hits, c AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY p DESC, c) AS r FROM h) WHERE r = 1"""),
    "acq11_comb_slots": (comb_slots, """WITH a AS (SELECT *, k * 30001 + 500 + carrier * 10 + k % 3 AS p FROM (SELECT n_nationkey::BIGINT AS carrier, unnest(range(40, 61)) AS k FROM nation) WHERE k * (carrier + 1) % 3 <> 0),
 g AS (SELECT carrier, p, round_even((p - min(p) OVER (PARTITION BY carrier)) / 30000.0, 0)::BIGINT AS slot FROM a),
 f AS (SELECT *, mp - b * mk AS a FROM (SELECT carrier, CASE WHEN abs(regr_slope(p, slot) - 30000) <= 5 THEN regr_slope(p, slot) ELSE 30000 END AS b, avg(p) AS mp, avg(slot) AS mk FROM g GROUP BY carrier HAVING count(*) >= 2)),
 t AS (SELECT carrier, a, b, unnest(range(floor(-a / b)::BIGINT, round_even((3007000 - a - 28160) / b, 0)::BIGINT + 1)) AS k FROM f)
 SELECT carrier, k, round(a + b * k, 2) AS pred FROM t WHERE a + b * k >= 0 AND a + b * k + 28160 < 3007000 - 1 AND (carrier, k) NOT IN (SELECT carrier, slot FROM g)"""),
}
