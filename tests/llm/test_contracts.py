"""Queries against SQL and brute force, and the cases that tables may hold: clashing names, repeated and null ids, long
texts, ties and empty tables."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from pagestream.llm import bpe_table, html_blocks, jaccard_join, line_dedup, nn_descent, packing, quality, queries, suffix_dedup, toxicity, url_reputation
from test_operators import SCHEMA, shingles

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents pages labels".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(([r[i] for i in at] for r in cursor.fetchall()), key=repr)
    assert sorted(df.columns) == columns
    assert sorted(([r[c] for c in columns] for r in df.collect()), key=repr) == want


def near_copies(seed: int, families: int, members: int) -> list[str]:
    r = random.Random(seed)
    texts = []
    for f in range(families):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 160))]
        for _ in range(members):
            w = list(words)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(60)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [768, 6])
def test_jaccard_random_sets(spark, monkeypatch, block):
    """Clusters of 12 are larger than the smaller block, so that pivots and the rest are searched too."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    texts = near_copies(block, 25, 12)
    sets = [shingles(t) for t in texts]
    union = jaccard_join.Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                union.join(i, j)
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), union.root(i)) for i, s in enumerate(sets)}


def test_jaccard_lists_hold_every_link():
    """Pairs just at the threshold share a list, whatever their sizes."""
    r = np.random.default_rng(5)
    for percent in (80, 85):
        parts, tried = jaccard_join.Parts(percent), 0
        for _ in range(4000):
            a = np.unique(r.integers(0, 2**64, int(np.exp(r.uniform(0, 7))), dtype=np.uint64))
            common = len(a) - int(r.integers(0, len(a) // 5 + 2))
            more = 100 * common // percent - len(a)
            if common < 1 or more < 0 or common == len(a) == common + more:
                continue
            b = np.unique(np.concatenate([r.permutation(a)[:common], r.integers(0, 2**64, more, dtype=np.uint64)]))
            assert len(np.intersect1d(parts.of(a), parts.of(b)))
            tried += 1
        assert tried > 1000


def test_jaccard_writes_no_chance_matches(spark, monkeypatch):
    """Texts of few words share most shingles with some other text, and are like none: no table of the join may hold
    rows for that."""
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(r.randrange(100, 140))) for _ in range(300)]
    sets = [shingles(t) for t in texts]
    seen = collections.Counter(x for s in sets for x in s)
    assert sum(seen[x] > 1 for s in sets for x in s) > 0.7 * sum(map(len, sets))
    written = []

    def cut(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        written.append(out.count())
        return out

    plain = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", cut)
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i for i in range(len(texts))} and max(written) <= 2 * len(texts)


def test_near_stage_writes_no_chance_matches(spark, monkeypatch):
    """The same for the pipeline's stage; planted near copies go, the rest stays."""
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randrange(100, 140))) for _ in range(200)]
    texts += [texts[i] + " z" for i in range(20)]
    written = []

    def cut(df, *args, **kwargs):
        out = plain(df, *args, **kwargs)
        written.append(out.count())
        return out

    plain = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", cut)
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    copies = 20 * 2 * 100  # sets of copies stand in all lists that they share
    assert kept == set(range(200)) and max(written) <= copies


def test_histograms_never_drop_a_link():
    r = np.random.default_rng(4)
    for n in (1, 5, 40, 900, 2100, 9000):
        for percent in (80, 85):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            for _ in range(20):
                common = a[: -(-2 * percent * len(a) // (100 + percent))]  # just enough
                b = np.unique(np.concatenate([common, r.integers(0, 2**64, len(a) - len(common), dtype=np.uint64)]))
                overlap = len(np.intersect1d(a, b))
                x, y = (np.frombuffer(jaccard_join.histogram(s), np.uint8) for s in (a, b))
                size = min(len(x), len(y))
                ok = jaccard_join.may_link(np.array([len(a)]), np.array([len(b)]), jaccard_join.folded(x, size)[None], jaccard_join.folded(y, size)[None], percent)
                assert ok[0] or 100 * overlap < percent * (len(a) + len(b) - overlap)
    full = np.arange(2000, dtype=np.uint64)  # all in one class, which is cut at 255
    x = np.frombuffer(jaccard_join.histogram(full), np.uint8)
    assert jaccard_join.may_link(np.array([2000]), np.array([2000]), x[None], x[None], 85)[0]


@pytest.mark.parametrize("width", [120, 240, 400])
def test_suffix_random_repeats(spark, width):
    r = random.Random(width)
    passages = ["".join(r.choice("abcdefgh ñ") for _ in range(r.randrange(width - 30, 3 * width))) for _ in range(6)]
    texts = ["".join(r.choice([r.choice(passages), "".join(r.choice("stuvw ") for _ in range(r.randrange(1, 300)))]) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    texts += ["ab" * 700, "ab" * 900, "z" * width, "z" * (width - 1), passages[0][:width], "", None]
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + width] for b in data for p in range(len(b) - width + 1))
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.suffix_dedup(docs, width).collect()}
    for i, b in enumerate(data):
        gone = {q for p in range(len(b) - width + 1) if seen[b[p : p + width]] > 1 for q in range(p, p + width)}
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        assert got[i] == (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())


def test_packing_pieces(spark):
    from tokenizers import Tokenizer

    from pagestream.llm.tokens import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = near_copies(1, 12, 4) + [None, "", "One. Two! Three?", "long " * 3000]
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    rows = packing.pack(docs).collect()
    used = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        used[sequence] = at
        assert at <= 1024
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert padding < 0.15 * sum(used.values())  # few, odd texts


def test_texts_are_encoded_whole_with_the_tokenizers_ids(monkeypatch):
    """Texts of any characters have the library's ids, and only those that need it are split to words first."""
    from tokenizers import Tokenizer

    from pagestream.llm import tokens

    split, words = [], tokens.Splitter.words
    monkeypatch.setattr(tokens.Splitter, "words", lambda self, text: split.append(text) or words(self, text))
    encoder, tokenizer = tokens.CachedEncoder(tokens.vocabulary_path()), Tokenizer.from_file(tokens.vocabulary_path())
    r = random.Random(5)
    plain = list("aaeeio sstt  nrlmvd''.,!?-09\n\t\r\x0b\x1c\x00\x85\xa0\u2003\u2028\u3000") + ["'s", "'ll", "'RE", "é", "ñ", "Ж", "中", "½", "٣", "€", "e\u0301", "word", " the", "\U00010400", "\U00020000"]
    rare = ["\u200b", "😀", "\u0378", "\U0001f9ff", "ª", "ꟸ", "\U0010ffff", "\ufeff"]
    usual = ["".join(r.choices(plain, k=r.randrange(1, 90))) for _ in range(3000)]
    usual += ["", " ", " \n x", "a" * 30_000, " " * 30_000 + "x", "!" * 30_000, "é中" * 9000, "\u3000 " * 9000]
    odd = ["".join(r.choices(plain + rare, k=r.randrange(1, 90))) for _ in range(1500)]
    odd += [a + "<|endoftext|>" + b for a, b in zip(usual[:200], odd)] + ["<|endoftext|>" * 2, " " * 1_100_000 + "x", "it's " * 110_000]
    for text in usual + odd:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not (set(split) - set(odd)) & set(usual) and set(odd[-203:]) <= set(split)


def test_packing_cuts_are_the_cheapest():
    r = random.Random(8)
    for _ in range(60):
        ends = np.unique([r.randrange(1, 120) for _ in range(15)])
        place, penalty = packing.candidates(ends, np.unique([*r.choices(ends.tolist(), k=4), 130]))
        window = 40
        best = {0: 0}
        for p, extra in zip(place, penalty):
            best[p] = min(c + extra + window - (p - q) for q, c in best.items() if p - q <= window)
        cuts = packing.best_cuts(place, penalty, window)
        cost = dict(zip(place, penalty))
        spent = sum(cost[b] + window - (b - a) for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == 130 and all(b - a <= window for a, b in zip([0, *cuts], cuts)) and spent == best[130]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><body><p>Hello there.</p>", ["Hello there."]),
        ("<p>Before <svg class='i'/> after it.</p><p>More.</p>", ["Before after it.", "More."]),
        ("<svg-icon></svg-icon><p>The rest.</p>", ["The rest."]),
        ("<iframe src=x /><p>Text.</p>", ["Text."]),
        ("<iframe src=x><p>Text.</p>", ["Text."]),
        ("<p>Seen.</p><script>var x = '<p>not</p>'", ["Seen."]),
        ('<p class="a>b</p><p>c</p>', ["b", "c"]),
        ("<p>" + "word " * 30_000 + "</p>", [("word " * 30_000).strip()]),
    ],
)
def test_html_loses_no_text(page, want):
    assert [b[1] for b in html_blocks.blocks(page)] == want


def test_urls_of_bad_hosts_are_blocked(spark):
    hosts = ["bad.example.co.uk:8080", "good.example.co.uk", "other.net"]
    pages = spark.createDataFrame([(i, f"http://{hosts[i % 3]}/a/{i}") for i in range(240)] + [(900, "http://new.bad.co.uk/"), (901, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge(pages, labels).collect()}
    assert {got[i].verdict for i in range(0, 240, 3)} == {"block"} and {got[i].verdict for i in range(240) if i % 3} == {"allow"}
    assert got[900].verdict == "allow" and got[901].verdict == "allow" and got[0].host == "bad.example.co.uk:8080"
    assert url_reputation.judge(pages.where("page_id < 0"), labels.where("doc_id < 0")).count() == 0
    assert url_reputation.judge(pages, labels.where("doc_id < 0")).where("verdict = 'block'").count() == 0


ODD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())] + [T.StructField(c, T.StringType()) for c in "gone row h n label kept node count pairs first source n_chars".split()])
WORDS = " ".join(f"word{i}" for i in range(90))
LINES = "a line of some nine words that is long enough\nanother line\n" + WORDS


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids, null in any column, a very long text, names that operators use themselves."""
    texts = [(1, LINES), (1, WORDS + " more"), (1, LINES), (None, LINES), (None, None), (2, None), (3, ""), (4, "x" * 300_000), (5, "long words " * 30_000), (6, WORDS.replace("word5 ", "wordy "))]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", *[None if k % 3 else "z"] * 12) for k, (i, t) in enumerate(texts)], ODD)


def test_odd_tables_pass_every_operator(spark, odd):
    n = odd.count()
    assert suffix_dedup.suffix_dedup(odd).count() == n
    assert quality.judge(odd).count() == n
    assert line_dedup.line_dedup(odd).count() == n
    assert bpe_table.encode_digest(odd).count() == n
    assert jaccard_join.jaccard_components(odd).count() == n
    assert toxicity.score(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == n
    assert packing.pack(odd).select("doc_id").distinct().count() == 7
    for stage in (quality.keep_good, line_dedup.clean, jaccard_join.keep_one_of_each, suffix_dedup.clean):
        assert stage(odd).columns == odd.columns
        assert stage(odd.where("false")).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark, odd):
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(odd).where("doc_id = 1 OR doc_id IS NULL").collect()]
    assert len([k for k in kept if k[0] == 1]) == 1  # three near copies
    assert len([k for k in kept if k[0] is None]) == 2
    texts = [r.text for r in line_dedup.clean(odd).where("doc_id = 1 OR (doc_id IS NULL AND text IS NOT NULL)").collect()]
    assert sum("another line" in t for t in texts) == 1
    two = spark.createDataFrame([(1, "too short", "en", "z"), (1, " ".join(f"the word{i} of" for i in range(60)), "en", "z")], SCHEMA)
    assert [r.text[:4] for r in quality.keep_good(two).collect()] == ["the "]


def test_pages_and_vectors_may_be_empty_or_repeat(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some text of a page.</p>", "x"), (1, "u", "<p>Some text of a page.</p>", "y"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert html_blocks.extract(pages).count() == 3
    assert html_blocks.extract(pages.where("false")).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nn_descent.nearest(none).count() == 0


def test_lines_by_one_word(spark):
    base = "one two three four five six seven eight".split()
    lines = [" ".join(base), " ".join([*base[:3], "else", *base[4:]]), " ".join(base[:-1]), " ".join([*base, "nine"]), " ".join(["zero", *base[:6], "x"]), "short line", "short lime", "Short  LINE", "\t", ""]
    docs = spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(lines)], SCHEMA)
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(docs).collect()}
    assert [got[i] for i in range(len(lines))] == [0, 1, 1, 1, 0, 0, 0, 1, 0, 0]


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    clean = [" ".join(f"the {r.randrange(10**6)} of" for _ in range(60)) for _ in range(12)]
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(55))
    texts = clean + [clean[0], clean[1] + " more", clean[2] + " " + passage, clean[3][:200] + passage + clean[4][200:600], "too short"]
    words = clean[5].split()
    words[20] = words[80] = words[140] = "changed"
    texts.append(" ".join(words))
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "z") for i, t in enumerate(texts)], SCHEMA).write.parquet(os.path.join(path, "documents.parquet"))
    docs = spark.read.parquet(os.path.join(path, "documents.parquet"))
    stages = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        stages.append({x.doc_id: x.text for x in docs.collect()})
    assert 16 not in stages[0] and len(stages[0]) == 17
    assert stages[1][12] == stages[1][13] == ""  # their only line stands in an earlier document
    assert set(range(12)) <= set(stages[2]) and 17 not in stages[2]
    assert all(passage not in t for t in stages[3].values()) and set(stages[3]) == set(stages[2])
    packed = corpus_pipeline.run(spark, path)
    assert {x.doc_id for x in packed.collect()} == set(stages[3])
