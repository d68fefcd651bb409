"""Addresses in message texts."""

from pyspark.sql import functions as F

from pagestream.functions import geo as G


def test_tactical_channel_comes_before_streets(spark):
    cases = {
        ">>BLS1 - <<FIRE TAC 03 110 RASPBERRY LN, Sultan /": "110 RASPBERRY LN, Sultan",
        "FIRE TAC 3  12 ELM CT, /; 325 120TH AVE NE, City ;": "12 ELM CT",
        "FIRE TAC 12 the old harbour / ; 325 120TH AVE NE, ;": "325 120TH AVE NE",  # no digit
        "FIRE TAC 12 4 ELM CT; 7 Oak Ave": "7 Oak Ave",  # no slash
        "FIRE TAC 5 1 A ST / FIRE TAC 6 2 B ST /": "1 A ST",
        "fire tac 5 1 A ST /": None,
        "FIRE TAC 5 1 A\nST /": None,
        "call; 9 Main St,; north": "9 Main St",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.a for r in df.select("i", G.address(F.col("t")).alias("a")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_geocoding_sorts_no_street_in_one_task(spark, tmp_path):
    """A quarter of the rows has one street; both a sort of them and a sort of the table are left out."""
    from pagestream.plans import places

    spark.range(4_000).selectExpr("id AS l_orderkey", "id % 50 AS l_partkey", "int(id % 7) AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1_000).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = places.geocoded(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert sum(r.addr == "12 Oak Ave" for r in rows) == sum((k + k % 7) % 4 == 3 for k in range(4_000)) and len({(r.l_orderkey, r.l_linenumber) for r in rows}) == len(rows)
    known = {f"{k} Main St": k % 90 for k in range(0, 1_000, 2)}
    assert all(r.lat == known.get(r.addr) for r in rows) and sum(r.lat is not None for r in rows) > 50
