"""Queries of text scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.plans.base import table

C = "len(regexp_extract_all(text, '{}'))"
_n = lambda p: C.format(p.replace("'", "''"))
_letters, _vowels = _n("[A-Za-z]"), _n("[aeiouAEIOUy]")
_marks = f"({_n('[0-9]')} + {_n(T.PUNCTUATION)} - {_n(' ')})"
_control = _n(r"[\x00-\x08\x0B-\x1F\x7F]")
_run = f"list_max(list_transform(regexp_split_to_array(text, '[^{T.CONSONANT}]'), lambda w: length(w)))"
SCORE = f"""CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
 (({_letters} + {_n(' ')})::DOUBLE / length(text) + 0.5 * least({_marks}::DOUBLE / length(text), 0.30::DOUBLE) - 2.5 * {_control}::DOUBLE / length(text) - 0.2::DOUBLE * greatest(0, {_run} - 4))
 * (0.4::DOUBLE + 0.6::DOUBLE * CASE WHEN {_letters} < 3 THEN 0.3::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - greatest(0.0::DOUBLE, 0.18::DOUBLE - {_vowels}::DOUBLE / {_letters}, {_vowels}::DOUBLE / {_letters} - 0.55::DOUBLE) / 0.20::DOUBLE) END))) END"""
_clean = f"(length(text) >= 12 AND {_n(r'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')} = 0 AND ({SCORE}) >= 0.45)"
PLAIN = r"replace(replace(replace(text, '\t', ' '), '\n', ' '), '\r', ' ')"
_tokens = rf"list_filter(regexp_split_to_array({PLAIN}, '\s+'), lambda t: t <> '')"
ENCODED = rf"""CASE WHEN len({_tokens}) = 0 THEN false
 WHEN len(list_filter({_tokens}, lambda t: regexp_matches(t, '{T.EMAIL}') OR regexp_matches(t, '{T.URL}'))) > 0 THEN false
 ELSE list_max(list_transform({_tokens}, lambda t: length(t))) >= 24 OR (len({_tokens}) = 1 AND length({_tokens}[1]) >= 20 AND len(regexp_extract_all({_tokens}[1], '[A-Za-z0-9+/=]')) >= 0.9 * length({_tokens}[1])) END"""
READABLE = rf"""(length(trim(regexp_replace({PLAIN}, '\s+', ' ', 'g'))) >= 3 AND len(regexp_extract_all({PLAIN}, '[ -~]')) >= 0.85 * length({PLAIN})
 AND len(regexp_extract_all({PLAIN}, '\p{{L}}')) >= 3 AND regexp_matches({PLAIN}, '[A-Za-z]{{3}}') AND NOT ({ENCODED}))"""
KEY = r"trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '(\s*\[[0-9]+\])+$', ''))"


def _docs(s, d):
    return table(s, d, "documents")


def english_score(s, d):
    return _docs(s, d).select("doc_id", F.round(T.english_score(F.col("text")), 6).alias("score"))


def clean_alpha(s, d):
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.is_clean_alpha(F.col("text"))).alias("n_clean"))


def gates(s, d):
    """Readable and encoded flags of messages with blobs and addresses mixed in."""
    m = F.pmod(F.col("doc_id"), F.lit(5))
    body = F.when(m == 0, F.sha2(F.col("text"), 256)).when(m == 1, F.concat(F.lit("see www.example.net/ "), F.sha2("text", 256))).when(m == 2, F.substring(F.sha2("text", 256), 1, 21)).otherwise(F.col("text"))
    return _docs(s, d).select("doc_id", body.alias("text")).select("doc_id", T.looks_encoded(F.col("text")).alias("encoded"), T.is_readable(F.col("text")).alias("readable"))


def dedup_keys(s, d):
    body = F.concat(F.lit("  "), F.col("text"), F.lit(" [12] [3]"))
    return _docs(s, d).select("doc_id", F.md5(T.dedup_key(body)).alias("key"))


def quality_pick(s, d):
    """The least garbled text of each source and language."""
    return _docs(s, d).where("text IS NOT NULL").groupBy("source", "lang").agg(F.min(F.struct(T.quality_key(F.col("text")).alias("q"), F.col("doc_id"))).alias("m")).select("source", "lang", F.col("m.doc_id").alias("doc_id"))


QUERIES = {
    "txt1_english_score": (english_score, f"SELECT doc_id, round({SCORE}, 6) AS score FROM documents"),
    "flt4_clean_alpha": (clean_alpha, f"SELECT source, count(*) AS n, count(*) FILTER ({_clean}) AS n_clean FROM documents GROUP BY source"),
    "flt5_7_gates": (gates, f"""WITH m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN sha256(text) WHEN 1 THEN 'see www.example.net/ ' || sha256(text) WHEN 2 THEN substr(sha256(text), 1, 21) ELSE text END AS text FROM documents)
 SELECT doc_id, {ENCODED} AS encoded, {READABLE} AS readable FROM m"""),
    "txt3_dedup_key": (dedup_keys, f"WITH m AS (SELECT doc_id, '  ' || text || ' [12] [3]' AS text FROM documents) SELECT doc_id, md5({KEY}) AS key FROM m"),
    "txt5_quality_pick": (quality_pick, r"""SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) - len(regexp_extract_all(text, '\p{L}')), -length(text), doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1"""),
}
