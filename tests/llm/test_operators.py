"""Small cases and brute-force comparisons of the training-data operators."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import types as T

from pagestream.llm import bpe_table, html_blocks, jaccard_join, line_dedup, nn_descent, packing, quality, suffix_dedup, toxicity, url_reputation

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("row", T.StringType())])
LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [None, "", "one", LONG, LONG, LONG.replace("word60", "other"), "x " * 3000, "a\nb\na\n" + LONG, "ñ" * 900 + "<|endoftext|>  end"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_jaccard(docs, empty):
    sets = [shingles(t) for t in TEXTS]
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_suffix(docs, empty):
    data = [(t or "").encode() for t in TEXTS]
    seen = collections.Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    for i, b in enumerate(data):
        gone = set()
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone.update(range(p, p + 400))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.clean(docs).columns == docs.columns


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sorted(by) == list(range(len(TEXTS)))
    for pieces in by.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    size = collections.Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 1024
    assert packing.pack(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    from pagestream.llm.tokens import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: r for r in bpe_table.encode_decode(docs).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == (text or "")
    assert bpe_table.encode_digest(empty).count() == 0


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[6].n_repeat_words == 3000 and got[6].base_failed
    assert got[7].n_dup_lines == 1 and got[3].n_repeat_words == 0
    assert quality.judge(empty).count() == 0


def test_lines(docs, empty):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert [got[i].n_removed for i in range(8)] == [0, 0, 0, 0, 1, 1, 0, 2]
    assert got[0].kept_sha256 is None
    assert line_dedup.line_dedup(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(1, "you m0ron id1ot", "en", "z"), (2, "a clown fish swims by", "en", "z"), (3, None, "en", "z")], SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(bad, labels).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].predicted == 0
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:80]
    header = "daily news from the harbour office for everyone "
    texts = [header + (f"zorblax case{i}" if n % 2 else f"calm case{i}") for n, i in enumerate(ids)]
    texts[:4] = [header + "quillish"] * 4  # equal texts: one text, toxic as two of its labels are
    rows = spark.createDataFrame([(i, t, "en", "z") for i, t in zip(ids, texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    weights, coefficients = toxicity.learn(rows, labels)
    assert weights["zorblax"] >= toxicity.MIN_WEIGHT and "quillish" not in weights and "calm" not in weights
    assert coefficients != toxicity.COEFFICIENTS
    few = [f"{header} {w} snarkel" for w in "aaa bbb ccc aaa bbb ccc".split()] + [f"{header} calm{i}" for i in range(6)]
    few = spark.createDataFrame([(i, t, "en", "z") for i, t in zip(ids, few)], SCHEMA)
    mixed = spark.createDataFrame([(i, 1, int(n < 3)) for n, i in enumerate(ids[:12])], "doc_id long, quality int, toxic int")
    assert toxicity.learn(few, mixed)[0]["snarkel"] > 0  # three texts, each with both labels


def test_urls(spark):
    pages = spark.createDataFrame([(0, None), (1, "nothing"), (2, "http://A.Example.ORG/es/x?y"), (3, "https://b.com/de/"), (4, "https://b.com"), (5, "http://q.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(4, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, labels).collect()}
    assert got[0] == ("", "", None, "allow") and got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[3] == ("b.com", "/de/", "com/de/", "block") and got[5][2:] == ("org/", "allow")


def test_html(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>First  long text of it.<p>Second one.</article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(0, "u", page), (1, None, None), (2, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_blocks.extract(rows).collect()}
    assert got == {0: "Title & more\n\nFirst long text of it.\n\nSecond one.", 1: "", 2: ""}


def test_nearest(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16))
    rows = [(i, x[i].tolist()) for i in range(300)] + [(300, x[0].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16)]
    got = collections.defaultdict(list)
    for q in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[q.query_id].append(q.vec_id)
    u = np.vstack([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 301, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(got[q]))
    assert hit >= 0.9 * 35


def test_nearest_search_ends_when_nothing_is_left_to_expand(spark):
    """Nine nodes in a row, each nearer to the query than the one before: the last is eight steps away."""
    import math

    angle = [0.0] + [1.0 - i / 10 for i in range(1, 9)]
    nodes = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angle)], "node long, v array<double>")
    graph = spark.createDataFrame([(i, [i + 1], [0.5]) for i in range(8)], "node long, ids array<long>, sims array<float>")
    query = nodes.where("node = 0").withColumnRenamed("node", "query")
    assert nn_descent.search(query, nodes, graph).first().ids == [8, 7, 6, 5, 4, 3, 2, 1]


def test_nearest_splits_full_leaves_by_hyperplanes(spark, monkeypatch):
    """A close cluster in which all vectors fall into one leaf, and vectors of one direction."""
    import numpy as np

    monkeypatch.setattr(nn_descent, "LEAF", 64)
    monkeypatch.setattr(nn_descent, "TREES", 4)
    r = np.random.default_rng(2)
    x = np.vstack([1 + 1e-3 * r.normal(size=(600, 8)), np.outer(np.arange(1, 201), np.eye(8)[0])])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").cache()
    units = nodes.mapInArrow(nn_descent._units, "node long, v array<float>")
    of = collections.defaultdict(set)
    size = collections.Counter()
    for row in nn_descent.leaves_of(nodes, units, 800).collect():
        of[row.node].add(row.leaf)
        size[row.leaf] += 1
    assert all(len(of[i]) == 4 for i in range(800))
    assert max(size.values()) <= 100  # hash parts of one direction vary in size
    u = x[:600] / np.linalg.norm(x[:600], axis=1, keepdims=True)
    u = u - u.mean(axis=0)
    near = np.argsort(((u[:, None] - u[None]) ** 2).sum(axis=2), axis=1)[:, 1:6]
    together = np.mean([bool(of[i] & of[j]) for i in range(600) for j in near[i]])
    assert together > 0.6  # parts by hash: about 1 - 0.9 ** 4 = 0.34
