"""Queries over message logs; events stand in for messages of a carrier (event_type)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestream.operators import messages as M
from pagestream.operators.messages import micros
from pagestream.plans.base import table

_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


def _lines(s, d):
    e = table(s, d, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit("|a\\nb  "), F.col("event_type"))
    m = F.pmod("event_id", F.lit(4))
    line = F.when(m == 0, F.concat(ts, F.lit(" FLEX|"), F.col("user_id").cast("string"), F.lit("|120|A|0|ALN|"), body)).when(m == 1, F.concat(ts, F.lit(" FLEX_NEXT|f1|f2|"), F.col("user_id").cast("string"), F.lit("|f4|f5|ALN|1.0.F|"), body)).when(m == 2, F.concat(ts, F.lit(" FLEX|1|2|A|0|NUM|"), body)).otherwise(F.concat(ts, F.lit(" other")))
    return e.select("event_id", line.alias("value"))


_LINES = f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_TS} || ' FLEX|' || user_id || '|120|A|0|ALN|' || body WHEN 1 THEN {_TS} || ' FLEX_NEXT|f1|f2|' || user_id || '|f4|f5|ALN|1.0.F|' || body WHEN 2 THEN {_TS} || ' FLEX|1|2|A|0|NUM|' || body ELSE {_TS} || ' other' END AS value
 FROM (SELECT *, 'user ' || user_id || '|a\\nb  ' || event_type AS body FROM events)"""


def log_parse(s, d):
    return M.parse_lines(_lines(s, d)).groupBy("carrier", "capcode", "flag", "body").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def log_write(s, d):
    e = table(s, d, "events")
    body = F.concat(F.col("event_type"), F.lit("\\x\ty\nz"))
    return e.select("event_id", M.flex_line(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("user_id"), F.floor(micros("ts") / 1875000), F.lit("A"), body).alias("line"))


def exact_dedup(s, d):
    e = table(s, d, "events").select("event_id", "ts", "event_type", F.pmod("user_id", F.lit(5)).alias("body"))
    return M.first_within(e, ["event_type", "body"], "ts", 900, "event_id").select("event_id", "event_type", "body")


def stitched(s, d):
    c = table(s, d, "conversations")
    flag = F.when(F.col("role") == "user", "F").when(F.col("role") == "assistant", "C").otherwise("K")
    ts = F.timestamp_seconds(F.col("turn") * F.when(F.pmod("conv_id", F.lit(3)) == 0, 5).otherwise(2) + F.when(F.pmod("turn", F.lit(7)) == 6, 6).otherwise(0))
    m = c.select("conv_id", "turn", ts.alias("ts"), flag.alias("flag"), F.coalesce("text", F.lit("")).alias("body"))
    return M.stitch(m, "conv_id", "ts", "flag", "body", "turn").select("conv_id", F.unix_seconds("ts").alias("start"), "n_parts", F.md5("body").alias("body"))


def windows(s, d):
    """FLEX (60 s every 52.5 s) and POCSAG (30 s every 25 s) windows of events."""
    e = table(s, d, "events")
    flex = M.sliding_windows(e, "ts", 60_000_000, 52_500_000).select(F.lit("flex").alias("kind"), "window_id", "value")
    pocsag = M.sliding_windows(e, "ts", 30_000_000, 25_000_000).select(F.lit("pocsag").alias("kind"), "window_id", "value")
    return flex.unionByName(pocsag).groupBy("kind", "window_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _windows(kind, size, step):
    return f"SELECT '{kind}' AS kind, unnest(range(floor((t - {size}) / {step})::BIGINT + 1, floor(t / {step})::BIGINT + 1)) AS window_id, value FROM (SELECT epoch_us(ts)::DOUBLE AS t, value FROM events)"


def emit_region(s, d):
    """Each event once: of the windows it is in, that whose first 25 s hold it."""
    w = M.sliding_windows(table(s, d, "events"), "ts", 30_000_000, 25_000_000)
    return w.where(micros("ts") - F.col("window_id") * 25_000_000 < 25_000_000).select("event_id", "window_id")


def slot_dedup(s, d):
    e = table(s, d, "events").withColumn("slot", F.floor(micros("ts") / 1875000))
    w = Window.partitionBy("slot", "event_type").orderBy("ts", "event_id")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("slot", "event_type", "event_id")


def newest(s, d):
    return table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "event_type")  # the ring holds 300


def retention(s, d):
    """The last 24 hours with the opacity of their age."""
    e = table(s, d, "events").select("event_id", micros("ts").alias("t"))
    last = e.agg(F.max("t").alias("hi"))
    kept = e.join(F.broadcast(last), F.col("t") >= F.col("hi") - 86_400_000_000)  # one row
    span = kept.agg(F.min("t").alias("lo"))
    age = (F.col("t") - F.col("lo")) / F.greatest(F.lit(1_000_000), F.col("hi") - F.col("lo"))
    return kept.crossJoin(F.broadcast(span)).select("event_id", F.round(0.1 + 0.8 * age * age, 6).alias("opacity"))


def counters(s, d):
    """Outcomes of dedup by type: shown, and held back as repeats."""
    e = table(s, d, "events").select("event_id", "ts", "event_type", F.pmod("user_id", F.lit(5)).alias("body"))
    shown = M.first_within(e, ["event_type", "body"], "ts", 900, "event_id").groupBy("event_type").agg(F.count("*").alias("emitted"))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).join(shown, "event_type").select("event_type", "n", "emitted", (F.col("n") - F.col("emitted")).alias("deduped"))


def per_half_minute(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.floor(micros("ts") / 30_000_000).alias("slot"), "event_type").agg(F.count("*").alias("n"))


def drop_oldest(s, d):
    """The newest 1024 arrivals of each carrier, and how many were shed."""
    e = table(s, d, "events")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    r = e.withColumn("r", F.row_number().over(w))
    return r.groupBy("event_type").agg(F.count_if(F.col("r") <= 1024).alias("kept"), F.count_if(F.col("r") > 1024).alias("dropped"), F.min(F.when(F.col("r") <= 1024, F.col("event_id"))).alias("first_kept"))


_DEDUP = "SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, body ORDER BY ts, event_id) AS gap FROM (SELECT event_id, ts, event_type, user_id % 5 AS body FROM events)"

QUERIES = {
    "src8_log_parse": (log_parse, f"""SELECT carrier, capcode, flag, body, count(*) AS n, max(ts) AS last FROM (SELECT split_part(value, ' ', 1) AS ts, p[2] AS carrier, CASE WHEN p[1] = 'FLEX' THEN p[5] ELSE p[4] END AS capcode, CASE WHEN p[1] = 'FLEX' THEN 'K' ELSE right(p[8], 1) END AS flag,
 trim(regexp_replace(replace(array_to_string(CASE WHEN p[1] = 'FLEX' THEN p[7:] ELSE p[9:] END, '|'), '\\n', ' '), '\\s+', ' ', 'g')) AS body FROM (SELECT value, string_split(substr(value, strpos(value, ' ') + 1), '|') AS p FROM ({_LINES}))
 WHERE (p[1] = 'FLEX' AND len(p) >= 7 AND p[6] = 'ALN') OR (p[1] = 'FLEX_NEXT' AND len(p) >= 9 AND p[7] = 'ALN')) GROUP BY ALL"""),
    "snk1_3_log_write": (log_write, f"SELECT event_id, {_TS} || ' FLEX|' || user_id || '|' || (epoch_us(ts) // 1875000) || '|A|0|ALN|' || event_type || '\\\\x\\ty\\nz' AS line FROM events"),
    "str6_exact_dedup": (exact_dedup, f"SELECT event_id, event_type, body FROM ({_DEDUP}) WHERE gap IS NULL OR gap >= 900000000"),
    "str8_stitch": (stitched, """WITH m AS (SELECT conv_id, turn, turn * CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 2 END + CASE WHEN turn % 7 = 6 THEN 6 ELSE 0 END AS t, CASE role WHEN 'user' THEN 'F' WHEN 'assistant' THEN 'C' ELSE 'K' END AS flag, coalesce(text, '') AS body FROM conversations),
 b AS (SELECT *, CASE WHEN flag IN ('F', 'K') OR coalesce(t - lag(t) OVER (PARTITION BY conv_id ORDER BY t, turn) >= 8, true) THEN 1 ELSE 0 END AS boundary FROM m),
 i AS (SELECT *, sum(boundary) OVER (PARTITION BY conv_id ORDER BY t, turn) AS island FROM b),
 p AS (SELECT *, CASE WHEN first_value(flag) OVER (PARTITION BY conv_id, island ORDER BY t, turn) = 'F' THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, island ORDER BY t, turn) END AS part FROM i)
 SELECT conv_id, min(t)::BIGINT AS start, count(*) AS n_parts, md5(string_agg(body, '' ORDER BY t, turn)) AS body FROM p GROUP BY conv_id, island, part"""),
    "str1_2_windows": (windows, f"SELECT kind, window_id, count(*) AS n, round(sum(value), 4) AS total FROM ({_windows('flex', 60000000, 52500000)} UNION ALL {_windows('pocsag', 30000000, 25000000)}) GROUP BY kind, window_id"),
    "str4_emit_region": (emit_region, "SELECT event_id, epoch_us(ts) // 25000000 AS window_id FROM events"),
    "str5_slot_dedup": (slot_dedup, "SELECT slot, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY slot, event_type ORDER BY ts, event_id) AS r FROM (SELECT *, epoch_us(ts) // 1875000 AS slot FROM events)) WHERE r = 1"),
    "top1_newest": (newest, "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300"),
    "str12_dat2_retention": (retention, "WITH k AS (SELECT event_id, epoch_us(ts) AS t, max(epoch_us(ts)) OVER () AS hi FROM events), r AS (SELECT *, min(t) OVER () AS lo FROM k WHERE t >= hi - 86400000000) SELECT event_id, round(0.1::DOUBLE + 0.8::DOUBLE * ((t - lo)::DOUBLE / greatest(1000000, hi - lo)) * ((t - lo)::DOUBLE / greatest(1000000, hi - lo)), 6) AS opacity FROM r"),
    "agg11_counters": (counters, f"SELECT event_type, count(*) AS n, count(*) FILTER (gap IS NULL OR gap >= 900000000) AS emitted, count(*) FILTER (gap < 900000000) AS deduped FROM ({_DEDUP}) GROUP BY event_type"),
    "agg10_half_minutes": (per_half_minute, "SELECT epoch_us(ts) // 30000000 AS slot, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "str13_drop_oldest": (drop_oldest, "SELECT event_type, count(*) FILTER (r <= 1024) AS kept, count(*) FILTER (r > 1024) AS dropped, min(event_id) FILTER (r <= 1024) AS first_kept FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY event_type"),
}
