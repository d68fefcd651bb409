"""URL verdicts from explicit rules and from the reputation of hosts.

Method: empirical Bayes. Labelled pages are outcomes (bad: of low quality or toxic) of their host. From host
(without port or user) to registered domain (one label more than the suffix) to suffix (the last label, or the last two
if they are in SECOND_LEVEL) to all, each level's rate of bad pages
is shrunk to its parent's by a beta-binomial prior whose strength comes from the spread of the rates within
that level (method of moments). A host without outcomes has its parent's rate. A page is blocked when the
lower bound of the host's posterior (normal approximation, Z deviations) passes BAD.

Rules say `host/path` and fit that host and its subdomains where the url's path starts with the path; the
longest that fits decides.

Edge cases: null urls and urls without :// have an empty host and path, fit no rule and get the verdict of
all; pages without labels are judged by their host; several labels of one page count as bad if any is;
repeated rows stay rows; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import cut, discard

BAD, Z = 0.5, 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
#: (rule, verdict)
# Public suffixes of two labels.
SECOND_LEVEL = "ac.uk co.uk gov.uk org.uk com.au edu.au gov.au net.au org.au ac.jp co.jp ne.jp or.jp ac.nz co.nz org.nz co.za org.za com.ar com.br com.cn com.hk com.mx com.sg com.tr com.tw co.il co.in co.kr".split()
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def named_host(name: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":\d*$", "")


def levels(name: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    last = lambda n: F.substring_index(name, ".", -n)
    second = last(2).isin(SECOND_LEVEL)
    return F.when(second, last(3)).otherwise(last(2)), F.when(second, last(2)).otherwise(last(1))


def _level(below: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """key, parent's rate, n, bad, and the posterior's alpha and beta."""
    rated = below.groupBy(key, parent_key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    up = parent.select(parent_key, F.col("rate").alias("prior"))
    joined = rated.join(up, parent_key)
    # spread of the rates around their priors, less what chance alone makes
    moments = joined.agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("ss"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("chance"),
        F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))).alias("whole"),
    ).select(F.when(F.col("ss") > F.col("chance"), F.least(F.greatest(F.lit(MIN_STRENGTH), (F.col("whole") - F.col("ss")) / (F.col("ss") - F.col("chance")) * F.lit(1.0)), F.lit(MAX_STRENGTH))).otherwise(F.lit(MAX_STRENGTH)).alias("strength"))
    post = joined.crossJoin(F.broadcast(moments))  # one row
    return post.select(
        key, parent_key, "n", "bad",
        (F.col("prior") * F.col("strength") + F.col("bad")).alias("alpha"),
        ((1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")).alias("beta"),
    ).withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad, rate, lower: one row per host of pages, n and bad of its labelled pages."""
    outcome = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    named = pages.select(F.col("page_id").cast("long").alias("id"), host(F.col("url")).alias("host"))
    counts = named.join(outcome, "id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    domain, suffix = levels(named_host(F.col("host")))
    hosts = cut(counts.withColumn("domain", domain).withColumn("suffix", suffix).withColumn("all", F.lit(1)))
    seen = hosts.where("n > 0")
    top = seen.groupBy("all").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("rate"))
    suffixes = cut(_level(seen, "suffix", top, "all"))
    domains = cut(_level(seen, "domain", suffixes, "suffix"))
    own = cut(_level(seen, "host", domains, "domain"))
    bound = lambda a, b: a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    out = hosts
    for name, table in (("host", own), ("domain", domains), ("suffix", suffixes)):
        out = out.join(table.select(name, F.col("rate").alias(f"r_{name}"), bound(F.col("alpha"), F.col("beta")).alias(f"l_{name}")), name, "left")
    out = cut(out.select("host", "n", "bad", F.coalesce("r_host", "r_domain", "r_suffix", F.lit(0.0)).alias("rate"), F.coalesce("l_host", "l_domain", "l_suffix", F.lit(0.0)).alias("lower")))
    discard(hosts, suffixes, domains, own)
    return out


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = None
    for text, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, start = text.partition("/")
        hit = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + start)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(hit, value) if fits is None else fits.when(hit, value)
    return fits


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, bad: float = BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's rate and lower bound."""
    known = reputations(pages, labels)
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = named.join(known, "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("lower") > bad, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "rate", "lower")
