"""Queries of specifications, log filters, peaks by mode and small reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestream.functions import specs
from pagestream.functions import text as T
from pagestream.operators import messages as M
from pagestream.plans.base import table
from pagestream.plans.texts import _clean


def mhz(s, d):
    spec = F.concat((F.col("c_custkey") / 8 + 900).cast("string"), F.lit(", ,"), (F.col("c_nationkey") * 2 + 0.0125).cast("string"))
    return table(s, d, "customer").select("c_custkey", F.array_join(specs.carriers(spec).cast("array<string>"), ",").alias("hz"))


def gains(s, d):
    m = F.pmod(F.col("c_custkey"), F.lit(4))
    spec = F.when(m == 1, " AGC ").when(m == 2, F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))).when(m == 3, F.concat(F.lit("LNA="), F.col("c_nationkey").cast("string"), F.lit(", VGA=11,")))
    g = specs.gain(spec)
    return table(s, d, "customer").select("c_custkey", g["kind"].alias("kind"), g["overall"].alias("overall"), g["elements"]["LNA"].alias("lna"), g["elements"]["VGA"].alias("vga"))


def map_lines(s, d):
    k = F.col("o_orderkey")
    ts = F.when(F.pmod(k, F.lit(7)) == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.concat(ts, F.lit(" FLEX|1|0|A|"), k.cast("string"), F.when(F.pmod(k, F.lit(5)) == 0, "|NUM|").otherwise("|ALN| "), F.lit("a|ALN|b "), k.cast("string"), F.lit("  "))
    return specs.map_lines(table(s, d, "orders").select(line.alias("value"))).select(F.unix_seconds("ts").alias("t"), "body")


def body_dedup(s, d):
    """Texts of one body on any carrier within five minutes of the last, and places of rows kept."""
    e = table(s, d, "events").select("event_id", "ts", F.pmod(F.col("user_id"), F.lit(50)).cast("string").alias("body"))
    return M.first_within(e, ["body"], "ts", 300, "event_id").select("event_id", "body")


def pocsag_lines(s, d):
    """Log lines of the clean texts."""
    docs = table(s, d, "documents").where(T.is_clean_alpha(F.col("text")))
    line = F.concat(F.lit("2026-01-01T00:00:00Z FLEX|929612500|0|A|"), F.col("doc_id").cast("string"), F.lit("|ALN|"), M.escape(F.col("text")))
    return docs.select("doc_id", F.md5(line).alias("line"))


def shown(s, d):
    """Messages that a viewer shows: no test pages, no skipped carriers, readable, of the last day with data."""
    e = table(s, d, "events").select("event_id", "ts", F.pmod(F.col("user_id"), F.lit(40)).alias("carrier"), F.when(F.pmod("event_id", F.lit(9)) == 0, "This is a TEST Page 12").when(F.pmod("event_id", F.lit(4)) == 0, "~~ 12").otherwise("Engine 4 respond to alarm").alias("body"))
    skipped = s.createDataFrame([(3,), (17,)], "carrier long")
    kept = e.where(~F.contains(F.lower("body"), F.lit("test page"))).join(F.broadcast(skipped), "carrier", "left_anti").where(T.is_readable(F.col("body")))
    last = e.agg(F.max("ts").alias("last"))  # one row
    return kept.crossJoin(F.broadcast(last)).where(M.micros("ts") >= M.micros("last") - 86_400_000_000).select("event_id", "carrier")


def dual(s, d):
    """Carriers in both lists."""
    a, b = (table(s, d, t).select(F.col(c).alias("carrier")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey")))
    return a.intersect(b)


def peaks(s, d):
    """Peaks of all modes (stand-ins: events by kind) above 0.6 in order, and the commonest mode, ties to the first seen."""
    p = table(s, d, "events").select(F.col("user_id").alias("carrier"), F.col("event_id").alias("position"), F.pmod(F.col("event_id") * 7, F.lit(5)).cast("int").alias("mode"), (F.pmod(F.col("event_id") * 13, F.lit(100)) / 100).alias("score"))
    by_mode = [p.where(F.col("mode") == m) for m, *_ in specs.MODES]
    every = by_mode[0]
    for one in by_mode[1:]:
        every = every.unionByName(one)
    return dominant(every.where("score > 0.6")).join(F.broadcast(specs.modes(s)), "mode").select("carrier", "mode", "baud", "levels", "n_peaks")


def dominant(confident):
    """(carrier, mode, n_peaks): the commonest mode, ties to that of the first peak by position and score."""
    counted = confident.groupBy("carrier", "mode").agg(F.count("*").alias("n_peaks"), F.min(F.struct("position", "mode", "score")).alias("first"))
    best = F.row_number().over(Window.partitionBy("carrier").orderBy(F.desc("n_peaks"), "first"))
    return counted.withColumn("r", best).where("r = 1").select("carrier", "mode", "n_peaks")


def sweep(s, d):
    """How often each pair of offset and parity won."""
    li = table(s, d, "lineitem").select(F.col("l_linenumber").alias("offset"), F.pmod("l_orderkey", F.lit(2)).alias("parity"))
    return li.groupBy("offset", "parity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "offset", "parity")


def margins(s, d):
    """Margins of words by the median of their phase; NaN stays out of the median."""
    w = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod("l_suppkey", F.lit(4)).alias("phase"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity").cast("double")).alias("margin"))
    middle = w.where(~F.isnan("margin")).groupBy("phase").agg(F.percentile("margin", 0.5).alias("median"))
    return w.join(F.broadcast(middle), "phase", "left").select("l_orderkey", "l_linenumber", F.when(F.coalesce("median", F.lit(0.0)) > 0, F.col("margin") / F.col("median")).otherwise(F.col("margin")).alias("margin"))


def box(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") % 90).alias("lat"), (F.col("c_nationkey") * -3).alias("lon"))
    return c.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def shown_text(s, d):
    """Bytes read as ASCII, and texts escaped for a page with their local time."""
    c = table(s, d, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex(F.col("o_orderkey") * 7919), 8, "0")).alias("raw"), F.concat(F.lit("a<b & "), F.col("o_orderkey").cast("string"), F.lit(">")).alias("body"), "o_orderdate")
    return c.select("o_orderkey", F.md5(specs.ascii_text(F.col("raw"))).alias("ascii"), specs.html_escaped(F.col("body")).alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"))


def scaled(s, d):
    """Demodulated samples so that the outer tone is 3."""
    factor = 250_000.0 / (2 * 3.141592653589793) * 3.0 / 4800.0
    return table(s, d, "events").select("event_id", F.round(F.col("value") * factor, 6).alias("x"))


_EVENT_BODY = "CASE WHEN event_id % 9 = 0 THEN 'This is a TEST Page 12' WHEN event_id % 4 = 0 THEN '~~ 12' ELSE 'Engine 4 respond to alarm' END"

QUERIES = {
    "src10_mhz_list": (mhz, "SELECT c_custkey, (round_even((c_custkey::DOUBLE / 8 + 900) * 1e6, 0)::BIGINT)::VARCHAR || ',' || (round_even((c_nationkey * 2 + 0.0125::DOUBLE) * 1e6, 0)::BIGINT)::VARCHAR AS hz FROM customer"),
    "src11_gain_spec": (gains, "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'agc' WHEN 2 THEN 'dB' WHEN 3 THEN 'elements' END AS kind, CASE WHEN c_custkey % 4 = 2 THEN c_nationkey + 0.5::DOUBLE END AS overall, CASE WHEN c_custkey % 4 = 3 THEN c_nationkey::DOUBLE END AS lna, CASE WHEN c_custkey % 4 = 3 THEN 11::DOUBLE END AS vga FROM customer"),
    "src9_map_lines": (map_lines, "SELECT epoch(o_orderdate::TIMESTAMP)::BIGINT AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'b ' || o_orderkey ELSE 'a|ALN|b ' || o_orderkey END AS body FROM orders WHERE o_orderkey % 7 <> 0"),
    "str7_body_dedup": (body_dedup, "SELECT event_id, body FROM (SELECT event_id, (user_id % 50)::VARCHAR AS body, epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= 300000000"),
    "snk2_pocsag_lines": (pocsag_lines, rf"SELECT doc_id, md5('2026-01-01T00:00:00Z FLEX|929612500|0|A|' || doc_id || '|ALN|' || replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS line FROM documents WHERE {_clean}"),
    "flt8_9_13_shown": (shown, f"SELECT event_id, user_id % 40 AS carrier FROM events WHERE {_EVENT_BODY} = 'Engine 4 respond to alarm' AND user_id % 40 NOT IN (3, 17) AND epoch_us(ts::TIMESTAMP) >= (SELECT max(epoch_us(ts::TIMESTAMP)) FROM events) - 86400000000"),
    "set2_dual_carriers": (dual, "SELECT s_nationkey AS carrier FROM supplier INTERSECT SELECT c_nationkey FROM customer"),
    "acq4_5_6_dominant_mode": (peaks, f"""WITH p AS (SELECT user_id AS carrier, event_id AS position, (event_id * 7) % 5 AS mode, ((event_id * 13) % 100)::DOUBLE / 100 AS score FROM events),
 c AS (SELECT carrier, mode, count(*) AS n_peaks, min(position) AS f FROM p WHERE score > 0.6::DOUBLE GROUP BY ALL), t(mode, baud, levels) AS (VALUES {", ".join(f"({m}, {b}, {n})" for m, _, b, n in specs.MODES)})
 SELECT carrier, mode::INT AS mode, baud::INT AS baud, levels::INT AS levels, n_peaks FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY carrier ORDER BY n_peaks DESC, f) = 1) JOIN t USING (mode)"""),
    "agg3_sweep_histogram": (sweep, 'SELECT l_linenumber AS "offset", l_orderkey % 2 AS parity, count(*) AS n FROM lineitem GROUP BY ALL'),
    "agg5_median_margin": (margins, """WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS phase, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_quantity::DOUBLE END AS margin FROM lineitem), m AS (SELECT phase, quantile_cont(margin, 0.5) AS md FROM w WHERE NOT isnan(margin) GROUP BY phase)
 SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(md, 0) > 0 THEN margin / md ELSE margin END AS margin FROM w LEFT JOIN m USING (phase)"""),
    "agg13_bounding_box": (box, "SELECT min(c_custkey % 90) AS south, min(c_nationkey * -3) AS west, max(c_custkey % 90) AS north, max(c_nationkey * -3) AS east FROM customer"),
    "txt11_12_shown_text": (shown_text, """WITH b AS (SELECT *, lpad(to_hex(o_orderkey * 7919), 8, '0') AS h FROM orders)
 SELECT o_orderkey, md5(array_to_string(list_transform([h[1:2], h[3:4], h[5:6], h[7:8]], lambda x: CASE WHEN ('0x' || x)::INT < 128 THEN chr(('0x' || x)::INT) ELSE '�' END), '')) AS ascii, 'a&lt;b &amp; ' || o_orderkey || '&gt;' AS body, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS shown FROM b"""),
    "dsp5_scaled": (scaled, "SELECT event_id, round(value * (250000.0::DOUBLE / (2 * 3.141592653589793::DOUBLE) * 3.0::DOUBLE / 4800.0::DOUBLE), 6) AS x FROM events"),
}
