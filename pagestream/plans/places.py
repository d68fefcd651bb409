"""Queries of joins, plans, places and kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestream.functions import geo as G
from pagestream.plans.base import table


def carrier_names(s, d):
    """Names of carriers, with the key itself where there is none."""
    c = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") + F.pmod("c_custkey", F.lit(2)) * 100).alias("carrier"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("carrier"), "n_name")
    return c.join(n, "carrier", "left").groupBy(F.coalesce("n_name", F.col("carrier").cast("string")).alias("net")).agg(F.count("*").alias("n"))


def plan(s, d):
    """Carriers of either list with their protocols."""
    a = table(s, d, "supplier").select(F.col("s_nationkey").alias("carrier")).where("carrier % 3 != 0").distinct().withColumn("a", F.lit("flex"))
    b = table(s, d, "customer").select(F.col("c_nationkey").alias("carrier")).where("carrier % 2 = 0").distinct().withColumn("b", F.lit("pocsag"))
    return a.join(b, "carrier", "full_outer").select("carrier", F.array_join(F.array_compact(F.array("a", "b")), ",").alias("protos"))


def in_band(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.lit(929_000_000) + F.col("c_custkey") * 2000).alias("carrier"))
    return c.select("c_custkey", (F.abs(F.col("carrier") - 930_000_000) <= 1_250_000).alias("inside"))


def _body():
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    lat, lon = (F.pmod(k, F.lit(90000)) / 1000).cast("decimal(8,3)").cast("string"), (F.pmod(p, F.lit(180000)) / -1000).cast("decimal(8,3)").cast("string")
    m = F.pmod(k + F.col("l_linenumber"), F.lit(4))
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES]), (F.pmod(p, F.lit(len(_CODES))) + 1).cast("int"))
    return F.when(m == 0, F.concat(F.lit("x >>"), code, F.lit("12 - at "), lat, F.lit(" ; "), lon)).when(m == 1, F.concat(code, F.lit(" - call; "), k.cast("string"), F.lit(" Main St,; north"))).when((m == 2) & (F.pmod(p, F.lit(2)) == 0), F.concat(F.lit(">>"), code, F.lit("1 - <<FIRE TAC 03 "), k.cast("string"), F.lit(" Elm Ln, / 7 Oak Ave;"))).when(m == 2, F.concat(F.lit("no place "), lat, F.lit(" "), code)).otherwise(F.concat(lat, F.lit(";"), lon, F.lit("; 12 Oak Ave")))


_CODES = ["AFA", "MVA", "HZ", "MED", "FIRE", "F", "XY", "GAS LEAK"]
_lat = "((l_orderkey % 90000)::DECIMAL(12,3) / 1000)::DECIMAL(8,3)"
_lon = "((l_partkey % 180000)::DECIMAL(12,3) / -1000)::DECIMAL(8,3)"
_code = f"({_CODES!r})[(l_partkey % {len(_CODES)})::INT + 1]"
BODY = f"""SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'x >>' || {_code} || '12 - at ' || {_lat} || ' ; ' || {_lon} WHEN 1 THEN {_code} || ' - call; ' || l_orderkey || ' Main St,; north' WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN '>>' || {_code} || '1 - <<FIRE TAC 03 ' || l_orderkey || ' Elm Ln, / 7 Oak Ave;' ELSE 'no place ' || {_lat} || ' ' || {_code} END ELSE {_lat} || ';' || {_lon} || '; 12 Oak Ave' END AS body FROM lineitem"""
_box = (10.0, 60.0, -100.0, -1.0)


def places(s, d):
    b = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", _body().alias("body"))
    point = G.coordinates(F.col("body"), _box)
    return b.select("l_orderkey", "l_linenumber", point["lat"].alias("lat"), point["lon"].alias("lon"), F.when(point.isNull(), G.address(F.col("body"))).alias("street"))


def kinds(s, d):
    return table(s, d, "lineitem").select(G.incident_kind(_body()).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def geocoded(s, d):
    """Streets looked up in a table of places; unknown ones stay without a point. The table is what is hashed, so that no
    side is sorted: a street of very many rows would else be sorted in one task."""
    b = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.address(_body()).alias("addr")).where("addr IS NOT NULL")
    g = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(" Main St")).alias("addr"), (F.col("o_custkey") % 90).alias("lat"))
    return b.join(g.hint("shuffle_hash"), "addr", "left").select("l_orderkey", "l_linenumber", "addr", "lat")


_street = r"rtrim(list_filter(list_transform(string_split(body, ';'), lambda f: trim(f)), lambda f: regexp_matches(f, '^\d+\s+\S') AND regexp_matches(f, '(?i)\b(AVE|ST|PL|WAY|DR|BLVD|RD|LN|CT|HWY|PKWY|TER)\b'))[1], ',')"
_tactical = r"rtrim(trim(regexp_extract(body, 'FIRE TAC\s+\d+\s+(.+?)\s+/', 1)), ',')"
_address = f"CASE WHEN regexp_matches({_tactical}, '[0-9]') THEN {_tactical} ELSE {_street} END"
_pair = G.PAIR
_points = f"list_filter(list_transform(list_zip(regexp_extract_all(body, '{_pair}', 1), regexp_extract_all(body, '{_pair}', 2)), lambda p: [p[1]::DOUBLE, p[2]::DOUBLE]), lambda p: p[1] BETWEEN 10 AND 60 AND p[2] BETWEEN -100 AND -1)[1]"

QUERIES = {
    "jn1_carrier_names": (carrier_names, "SELECT coalesce(n_name, carrier::VARCHAR) AS net, count(*) AS n FROM (SELECT c_nationkey + (c_custkey % 2) * 100 AS carrier FROM customer) LEFT JOIN nation ON carrier = n_nationkey GROUP BY 1"),
    "jn2_carrier_plan": (plan, "SELECT coalesce(a.carrier, b.carrier) AS carrier, concat_ws(',', a.p, b.p) AS protos FROM (SELECT DISTINCT s_nationkey AS carrier, 'flex' AS p FROM supplier WHERE s_nationkey % 3 <> 0) a FULL JOIN (SELECT DISTINCT c_nationkey AS carrier, 'pocsag' AS p FROM customer WHERE c_nationkey % 2 = 0) b ON a.carrier = b.carrier"),
    "jn11_in_band": (in_band, "SELECT c_custkey, abs(929000000 + c_custkey * 2000 - 930000000) <= 1250000 AS inside FROM customer"),
    "txt7_9_places": (places, f"SELECT l_orderkey, l_linenumber, p[1] AS lat, p[2] AS lon, CASE WHEN p IS NULL THEN street END AS street FROM (SELECT *, {_points} AS p, {_address} AS street FROM ({BODY}))"),
    "txt10_kinds": (kinds, f"""SELECT CASE WHEN regexp_matches(code, 'AFA|ALARM') THEN 'alarm' WHEN code LIKE 'MV%' THEN 'vehicle' WHEN regexp_matches(code, 'HAZ|^HZ$|GAS') THEN 'hazmat' WHEN regexp_matches(code, 'AID|MED|BLS|MEDIC|CARDIAC|RESC|STROKE|SICK') THEN 'medical' WHEN regexp_matches(code, 'FIRE|SMOKE|STRUCT|WORKING|BRUSH|BARK|APPLI|FOS|COA|^F[A-Z]{{0,2}}$') THEN 'fire' ELSE 'other' END AS kind, count(*) AS n
 FROM (SELECT upper(trim(CASE WHEN regexp_extract(body, '>>\\s*([A-Za-z]+)\\d*\\s*-', 1) <> '' THEN regexp_extract(body, '>>\\s*([A-Za-z]+)\\d*\\s*-', 1) ELSE regexp_extract(body, '^\\s*([A-Za-z][A-Za-z ]*?)\\s*[-;]', 1) END)) AS code FROM ({BODY})) GROUP BY 1"""),
    "jn3_geocode": (geocoded, f"SELECT l_orderkey, l_linenumber, addr, o_custkey % 90 AS lat FROM (SELECT *, {_address} AS addr FROM ({BODY})) LEFT JOIN orders ON o_orderkey % 2 = 0 AND addr = o_orderkey || ' Main St' WHERE addr IS NOT NULL"),
}
