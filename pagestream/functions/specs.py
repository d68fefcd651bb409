"""Specifications given as text: carrier lists, gains, map lines, names of modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sync code, bits a second and levels of the modes, in order.
MODES = ((0, 0x870C78F3, 1600, 2), (1, 0xB0684F97, 1600, 4), (2, 0x7B1884E7, 3200, 2), (3, 0xDEA0215F, 3200, 4), (4, 0x4C7CB383, 3200, 4))


def carriers(spec: Column) -> Column:
    """'930.5, 931.5' in MHz to Hz; empty entries go."""
    entries = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(entries, lambda x: F.bround(x.cast("double") * 1_000_000.0, 0).cast("long"))


def gain(spec: Column) -> Column:
    """struct(kind, overall, elements): kind null (no gain given), agc, dB or elements."""
    s = F.trim(spec)
    pairs = F.filter(F.split(s, ","), lambda x: F.trim(x) != "")
    names = F.transform(pairs, lambda x: F.trim(F.substring_index(x, "=", 1)))
    values = F.transform(pairs, lambda x: F.trim(F.regexp_replace(x, r"^[^=]*=", "")).try_cast("double"))
    agc, named = F.lower(s) == "agc", F.contains(s, F.lit("="))
    return F.struct(
        F.when(s.isNull(), F.lit(None)).when(agc, "agc").when(named, "elements").otherwise("dB").alias("kind"),
        F.when(~agc & ~named, s.try_cast("double")).alias("overall"),
        F.when(named, F.map_from_arrays(names, values)).alias("elements"),
    )


def map_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """ts (timestamp) and body of the lines with |ALN|; lines without a time go."""
    ts = F.try_to_timestamp(F.substring_index(value, " ", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.btrim(F.expr(f"substring({value}, instr({value}, '|ALN|') + 5)"), F.lit(" \t\n\x0b\x0c\r"))
    return lines.where(F.contains(F.col(value), F.lit("|ALN|"))).select(ts.alias("ts"), body.alias("body")).where("ts IS NOT NULL")


def modes(spark: SparkSession) -> DataFrame:
    """(mode, code, baud, levels): five rows."""
    return spark.createDataFrame(MODES, "mode int, code long, baud int, levels int")


def ascii_text(data: Column) -> Column:
    """Bytes read as ASCII, anything else as the replacement character."""
    hexed = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    codes = F.filter(F.split(hexed, " "), lambda x: x != "")
    return F.array_join(F.transform(codes, lambda x: F.when(F.conv(x, 16, 10).cast("int") < 128, F.char(F.conv(x, 16, 10).cast("int"))).otherwise(F.lit("�"))), "")


def html_escaped(text: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text
