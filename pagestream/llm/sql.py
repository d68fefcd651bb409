"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from pagestream.llm import quality, url_reputation

WORD, SPACE_CLASS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def quality_sql() -> str:
    """op5: base counts and the verdict of the two distances."""
    common = sorted({w for words in quality.COMMON.values() for w in words})
    classes = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[\x09-\x0D\x20]", r"[.,;:''\"()?-]"]
    counts = ", ".join(f"length(regexp_replace(t, '[^{c[1:-1] if c[0] == '[' else c}]', '', 'g'))" for c in classes)

    def distance(a: str, b: str) -> str:
        share = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1e-9))"
        term = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0.0 END"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(a)}, {share(b)}), lambda z: ({term(1)} + {term(2)}) / 2))))"

    m = len(common) + 1
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM base),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '{SPACE_CLASS}', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(t) AS chars,
  list_transform([{counts}], lambda x: x::DOUBLE) AS k,
  list_transform({_list(common)}, lambda c: len(list_filter(w, lambda x: rtrim(lower(x), '.,;:') = c))::DOUBLE) AS m
  FROM w LEFT JOIN rep ON rep.r = w.r),
g AS (SELECT * REPLACE (list_append(k, greatest(0.0, chars - list_sum(k))) AS k, list_append(m, greatest(0.0, n_words - list_sum(m))) AS m),
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f),
ref AS (SELECT lang, [{", ".join(f"sum(k[{i}])" for i in range(1, 7))}] AS rk, [{", ".join(f"sum(m[{i}])" for i in range(1, m + 1))}] AS rm FROM g WHERE NOT base_failed GROUP BY lang),
j AS (SELECT g.*, CASE WHEN rk IS NOT NULL AND chars >= {quality.CHAR_GUARD} THEN {distance("k", "rk")} END AS dk,
  CASE WHEN rm IS NOT NULL AND n_words >= {quality.WORD_GUARD} THEN {distance("m", "rm")} END AS dm FROM g LEFT JOIN ref ON g.lang IS NOT DISTINCT FROM ref.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND coalesce(dk, 0) <= {quality.CHAR_LIMIT} AND coalesce(dm, 0) <= {quality.WORD_LIMIT}) AS kept FROM j"""


def url_sql() -> str:
    """op7: host, path, rule and verdict."""
    u = url_reputation
    rules = "".join(
        f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{text}'"
        for text, name, start in sorted(((t, *t.split("/", 1)) for t, _ in u.RULES), key=lambda x: -len(x[0]))
    )
    verdicts = "".join(f" WHEN '{t}' THEN '{v}'" for t, v in u.RULES)
    upper = f"translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{u._UPPER}', '{u._LOWER}')"
    second = f"list_contains({_list(u.SECOND_LEVEL)}, array_to_string(p[-2:], '.'))"

    def level(key: str, parent: str, up: str) -> str:
        return f"""
{key}_j AS (SELECT s.*, rate AS prior FROM (SELECT {key}, "{parent}", sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY ALL) s JOIN {up} USING ("{parent}")),
{key}_m AS (SELECT CASE WHEN ss > chance THEN least(greatest({u.MIN_STRENGTH}, (whole - ss) / (ss - chance)), {u.MAX_STRENGTH}) ELSE {u.MAX_STRENGTH} END AS strength
  FROM (SELECT sum(n * pow(bad / n - prior, 2)) AS ss, sum(prior * (1 - prior)) AS chance, sum(n * prior * (1 - prior)) AS whole FROM {key}_j)),
{key}_l AS (SELECT *, a / (a + b) AS rate, a / (a + b) - {u.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower
  FROM (SELECT {key}, "{parent}", prior * strength + bad AS a, (1 - prior) * strength + n - bad AS b FROM {key}_j, {key}_m))"""

    return f"""
WITH o AS (SELECT doc_id AS id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
pg AS (SELECT page_id, coalesce({upper}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
c AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM pg LEFT JOIN o ON id = page_id GROUP BY host),
d AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS p FROM c),
hosts AS (SELECT host, n, bad, array_to_string(CASE WHEN {second} THEN p[-3:] ELSE p[-2:] END, '.') AS domain, array_to_string(CASE WHEN {second} THEN p[-2:] ELSE p[-1:] END, '.') AS suffix, 1 AS "all" FROM d),
seen AS (SELECT * FROM hosts WHERE n > 0),
top AS (SELECT "all", (sum(bad) + 0.5) / (sum(n) + 1) AS rate FROM seen GROUP BY "all"),{level("suffix", "all", "top")},{level("domain", "suffix", "suffix_l")},{level("host", "domain", "domain_l")},
known AS (SELECT hosts.host, coalesce(host_l.lower, domain_l.lower, suffix_l.lower, 0.0) AS lower FROM hosts LEFT JOIN host_l ON hosts.host = host_l.host LEFT JOIN domain_l ON hosts.domain = domain_l.domain LEFT JOIN suffix_l ON hosts.suffix = suffix_l.suffix),
r AS (SELECT page_id, host, path, lower, CASE{rules} END AS rule FROM pg LEFT JOIN known USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule{verdicts} END, CASE WHEN lower > {u.BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM r"""


def suffix_sql(width: int = 400) -> str:
    """op4: bytes as pairs of hex digits; windows are compared as they stand."""
    two = 2 * width
    return f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, i, md5(substr(x, 2 * i + 1, {two})) AS s FROM (SELECT r, x, unnest(range(0, strlen(x) // 2 - {width} + 1)) AS i FROM b WHERE strlen(x) >= {two})),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM p) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {width} THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, k, min(i) AS s, max(i) + {width} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
ends AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM runs),
kept AS (SELECT b.r, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS x, sum(e - s) AS n, count(*) AS k FROM ends JOIN b ON b.r = ends.r GROUP BY b.r)
SELECT doc_id, (strlen(b.x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256
FROM b LEFT JOIN kept ON kept.r = b.r"""


def jaccard_sql(size: int = 4, percent: int = 85) -> str:
    """op10: all pairs that share a shingle, then the smallest id reachable."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_reputation._UPPER}', '{url_reputation._LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id"""


def line_sql() -> str:
    """op8: each line with a word against all earlier ones, by words with one replaced, missing or more."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, ln, regexp_extract_all(lower(lines[ln]), '{WORD}') AS w FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS ln FROM d) WHERE regexp_matches(lines[ln], '{WORD}')),
c AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((doc_id, ln)) AS o FROM l GROUP BY 1),
v AS (SELECT s, o, i, CASE WHEN i = 0 THEN s ELSE array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') END AS k FROM (SELECT s, w, o, unnest(range(0, CASE WHEN len(w) >= 8 THEN len(w) ELSE 0 END + 1)) AS i FROM c WHERE len(w) >= 7)),
near AS (SELECT DISTINCT a.s FROM v a JOIN v b ON a.k = b.k AND b.o < a.o AND ((a.i = b.i AND a.i > 0) OR ((a.i = 0) <> (b.i = 0)))),
gone AS (SELECT l.doc_id, l.ln FROM l JOIN c ON c.s = array_to_string(l.w, ' ') LEFT JOIN near ON near.s = c.s WHERE near.s IS NOT NULL OR (l.doc_id, l.ln) > c.o),
g AS (SELECT doc_id, list(ln) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_dedup": suffix_sql(),
        "op5_quality_divergence": quality_sql(),
        "op7_url_reputation": url_sql(),
        "op8_line_dedup": line_sql(),
        "op10_jaccard_join": jaccard_sql(),
    }
