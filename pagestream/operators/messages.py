"""Message-log operators: parsing, writing, dedup, stitching, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds from the epoch, UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """ts, carrier, capcode, flag, body of the lines of either grammar; others go."""
    ts = F.substring_index(value, " ", 1)
    rest = F.expr(f"substring({value}, instr({value}, ' ') + 1)")
    p = F.split(rest, r"\|")
    plain = (F.get(p, F.lit(0)) == "FLEX") & (F.size(p) >= 7) & (F.get(p, F.lit(5)) == "ALN")
    parts = (F.get(p, F.lit(0)) == "FLEX_NEXT") & (F.size(p) >= 9) & (F.get(p, F.lit(6)) == "ALN")
    body = F.when(plain, F.array_join(F.slice(p, 7, F.size(p)), "|")).when(parts, F.array_join(F.slice(p, 9, F.size(p)), "|"))
    from pagestream.functions.text import collapsed, unescaped

    out = lines.where(plain | parts).select(
        ts.alias("ts"),
        F.get(p, F.lit(1)).alias("carrier"),
        F.when(plain, F.get(p, F.lit(4))).otherwise(F.get(p, F.lit(3))).alias("capcode"),
        F.when(plain, F.lit("K")).otherwise(F.right(F.get(p, F.lit(7)), F.lit(1))).alias("flag"),
        collapsed(unescaped(body)).alias("body"),
    )
    return out.where("body != ''")


def escape(text: Column) -> Column:
    """Backslash first, then line ends and tabs."""
    for raw, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def flex_line(ts: Column, carrier: Column, slot: Column, tier: Column, body: Column) -> Column:
    return F.concat(ts, F.lit(" FLEX|"), carrier.cast("string"), F.lit("|"), slot.cast("string"), F.lit("|"), tier, F.lit("|0|ALN|"), escape(body))


def first_within(df: DataFrame, keys: list[str], ts: str, seconds: float, *tie: str) -> DataFrame:
    """The rows whose last equal row is at least `seconds` ago; every repeat, shown or not, renews the wait."""
    w = Window.partitionBy(*keys).orderBy(ts, *tie)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    return df.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= F.lit(int(seconds * 1_000_000)))).drop("__gap")


def stitch(df: DataFrame, key: str, ts: str, flag: str, body: str, tie: str, timeout: float = 8.0) -> DataFrame:
    """Fragments to messages: F opens and takes the C that follow in time, joined without a separator; K, and C
    without an open F, stand alone."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    late = (micros(ts) - F.lag(micros(ts)).over(w)) >= F.lit(int(timeout * 1_000_000))
    boundary = F.when(F.col(flag).isin("F", "K") | F.coalesce(late, F.lit(True)), 1).otherwise(0)
    island = df.withColumn("__island", F.sum(boundary).over(w))
    # an island opened by F is one message; in any other every row is
    opened = F.first(flag).over(Window.partitionBy(key, "__island").orderBy(ts, tie))
    named = island.withColumn("__part", F.when(opened == "F", F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(key, "__island").orderBy(ts, tie))))
    piece = F.struct(F.col(ts).alias("a"), F.col(tie).alias("b"), F.col(body).alias("c"))
    return named.groupBy(key, "__island", "__part").agg(
        F.min(ts).alias("ts"), F.count("*").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["c"]), "").alias("body")
    ).drop("__island", "__part")


def sliding_windows(df: DataFrame, ts: str, size: int, step: int) -> DataFrame:
    """df with window_id: all k with k*step <= t < k*step + size, in microseconds from the epoch."""
    t = micros(ts)
    last = F.floor(t / step)
    first = F.floor((t - size) / step) + 1
    return df.withColumn("window_id", F.explode(F.sequence(first, last)))
