"""Removal of lines that repeat an earlier line of the corpus, exactly or but for one word, in DataFrame
functions only.

Method: deletion-neighbourhood join on words. Lines are compared as their words, lower-cased. For a line of
at least NEAR_WORDS words every variant with one word deleted is a hashed key: two lines that differ in the
word at one place share the variant with that place; a line that lacks one word of another is a variant of
it (which may be one word short of NEAR_WORDS itself). The keys come in two steps: first the words outside each of
PARTS parts of the line, then, for parts that share this key with another line, the variants of the words inside.
Within a key all that counts is the earliest line, found by a minimum that is combined before the shuffle; no pairs
are emitted but those of a line and its earliest partner, whose words are compared to verify the edit distance. A line
goes if any earlier line (by doc_id, then line number) is equal (by 192 bits of hashes, 64 for short lines) or within the bound. The bound is one word; shorter
lines differ too much by a word, so they are compared for equality only.

Lines that can't have a partner are kept out of the variants first: one edited word leaves either the
first four words or the last four as they are, so a line takes part only if another line of about as many
words shares one of the two.

Edge cases: null text stays null and has no lines; lines without a word stay; an empty text keeps its one
empty line; very long lines cost time in proportion to their words, or with the
square of a part's where all other parts are equal; equal lines of one document leave the
first; where doc_id is null or repeats, rows are told apart, and their order is that of numbers made for them; an empty
table gives none; other columns pass through `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import cut, discard, let, numbered, release

NEAR_WORDS, ENDS, PARTS = 8, 4, 8
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.split(F.btrim(F.lower(line), F.lit(SPACE_CHARS)), SPACE)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, line) of the lines with a word."""
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).where(F.btrim("line", F.lit(SPACE_CHARS)) != "")


def _order(lines: DataFrame) -> Column:
    """doc_id and ln as one number in their order: a long where it fits, else a decimal."""
    most = lines.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("ln").alias("ln")).first()
    if most.lo is None or (most.lo >= 0 and most.hi < 1 << 38 and most.ln < 1 << 24):
        return F.shiftleft("doc_id", 24) + F.col("ln")
    return (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("ln")).cast("decimal(38,0)")


def _neighbourhoods(hashed: DataFrame) -> DataFrame:
    """hashed(h, o, wh: word hashes) to (h, o, own, k, mid): for each of PARTS parts of a line the key of the
    words outside it, and the words inside; own: parts of the line, else parts of a line of one word more,
    of which this one may be a variant. Lines within the bound share the key of the part that differs."""

    def parts(own: bool) -> Column:
        n = F.size("wh") + (0 if own else 1)
        less = 0 if own else 1

        def cell(s: Column) -> Column:
            a = F.floor(s * n / PARTS).cast("int")
            b = F.floor((s + 1) * n / PARTS).cast("int") - less
            k = F.xxhash64(n, s, F.slice("wh", F.lit(1), a), F.slice("wh", b + 1, F.size("wh")))
            return F.struct(F.lit(own).alias("own"), k.alias("k"), F.slice("wh", a + 1, b - a).alias("mid"))

        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), cell)

    return hashed.where(F.size("wh") >= NEAR_WORDS).select("h", "o", F.explode(parts(True)).alias("c")).unionByName(hashed.select("h", "o", F.explode(parts(False)).alias("c"))).select("h", "o", "c.own", "c.k", "c.mid")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, gone: array of line numbers from 0) of the rows of docs(doc_id, text) that lose lines; doc_id is a key."""
    spark = docs.sparkSession
    split = _lines(docs).select("doc_id", "ln", _words(F.col("line")).alias("w"))
    n = F.size("w")
    end = lambda at: F.when(n >= NEAR_WORDS - 1, F.xxhash64(F.slice("w", at, ENDS), F.lit(at))).otherwise(F.lit(0).cast("long"))
    lines = cut(split.select("doc_id", "ln", F.xxhash64("w", F.lit(0)).alias("h"), n.alias("n"), end(1).alias("head"), end(-ENDS).alias("tail")))
    lines_o = lines.withColumn("o", _order(lines))
    firsts = cut(lines_o.groupBy("h", "n", "head", "tail").agg(F.min("o").alias("o"), F.count("*").alias("c")))
    release(spark)
    some = firsts.where(F.col("n") >= NEAR_WORDS - 1)
    longer = F.array(F.xxhash64("head", F.col("n") + 1), F.xxhash64("tail", F.col("n") + 1))
    own = F.when(F.col("n") >= NEAR_WORDS, F.array(F.xxhash64("head", "n"), F.xxhash64("tail", "n"))).otherwise(F.array().cast("array<bigint>"))
    keys = some.select("h", F.explode(F.concat(own, longer)).alias("k"))
    met = keys.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("k")
    partners = keys.join(met, "k", "left_semi").select("h").distinct()
    places = lines_o.join(firsts.join(partners, "h", "left_semi").select("h", "o"), ["h", "o"]).select("doc_id", "ln", "h", "o").dropDuplicates(["h"])
    mine = cut(places.groupBy("doc_id").agg(F.collect_list(F.struct("ln", "h", "o")).alias("mine")))  # some lines of one document
    release(spark)
    # each line is taken out of its text before rows are made of them
    taken = let(F.split("text", "\n"), lambda all_: F.transform("mine", lambda m: F.struct(m["h"].alias("h"), m["o"].alias("o"), F.get(all_, m["ln"]).alias("line"))))
    texts = docs.join(mine.hint("shuffle_hash"), "doc_id").select(F.explode(taken).alias("m")).select("m.h", "m.o", _words(F.col("m.line")).alias("w"))
    hashed = cut(texts.select("h", "o", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh")))
    release(spark)
    cells = _neighbourhoods(hashed)
    alike = cells.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("k")
    close = cut(cells.join(alike, "k", "left_semi"))
    release(spark)
    inner = F.transform("mid", lambda x, i: F.xxhash64("k", F.concat(F.slice("mid", F.lit(1), i), F.slice("mid", i + 2, F.size("mid")))))
    variants = close.where("own").select("h", "o", F.posexplode(inner).alias("i", "v")).select("h", "o", "i", F.col("v").alias("k"))
    wholes = close.where("NOT own").select("h", "o", F.lit(-1).alias("i"), F.xxhash64("k", "mid").alias("k"))
    meeting = cut(variants.unionByName(wholes))
    discard(close)
    # the same word place left out of both: one word replaced; a whole line equal to a variant: one word more
    place = meeting.where("i >= 0").groupBy("k", "i").agg(F.min("o").alias("first"))
    replaced = meeting.join(place, ["k", "i"]).where("first < o").select("h", "first")
    whole = meeting.groupBy("k").agg(F.min(F.when(F.col("i") < 0, F.col("o"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("o"))).alias("longer"))
    more = meeting.join(whole.where("whole IS NOT NULL AND longer IS NOT NULL"), "k").withColumn("first", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("whole"))).where("first < o").select("h", "first")
    pairs = replaced.unionByName(more).groupBy("h").agg(F.min("first").alias("first"))
    words = hashed.select("h", "o", "w")
    both = pairs.join(words.select("h", "w"), "h").join(words.select(F.col("o").alias("first"), F.col("w").alias("other")), "first")
    near = both.where(within_one_word(F.col("w"), F.col("other"))).select("h", F.lit(True).alias("near"))
    judged = cut(firsts.select("h", "n", "head", "tail", "c", F.col("o").alias("first")).join(near, "h", "left").where("near OR c > 1"))
    gone = lines_o.join(judged, ["h", "n", "head", "tail"]).where(F.col("near") | (F.col("o") > F.col("first")))
    out = cut(gone.groupBy("doc_id").agg(F.collect_list("ln").alias("gone")))
    discard(lines, firsts, mine, hashed, meeting, judged)
    release(spark)
    return out


def within_one_word(a: Column, b: Column) -> Column:
    """Whether one word replaced, or one word more or less, makes a of b."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    tail = lambda w, start: F.slice(w, F.greatest(start, F.lit(1)), F.size(w))
    same = F.size(a) - F.size(b)
    return (at == 0) | F.when(same == 0, tail(a, at + 1) == tail(b, at + 1)).when(same == 1, tail(a, at + 1) == tail(b, at)).when(same == -1, tail(a, at) == tail(b, at + 1)).otherwise(F.lit(False))


def without_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut to the lines that stay, and __removed, their number (all columns kept)."""
    marked, _ = numbered(docs)
    rows = marked.select(F.col("__row").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = removed_lines(rows).select(F.col("doc_id").alias("__row"), F.col("gone").alias("__gone"))
    release(docs.sparkSession)
    joined = marked.join(gone.hint("shuffle_hash"), "__row", "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size("__gone"), F.lit(0)).alias("__removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null for null text)."""
    lines = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return without_lines(lines).select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.col("__removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines; n_chars, if there, follows the text."""
    out = without_lines(docs)
    size = F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
