"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are compared with
references, the pooled histograms of the documents of its language (lang; null is a group of its own) that
pass the base rules, by Jensen-Shannon distance (base 2, 0 to 1). A document is kept if both distances stay
within their bounds; the one of words is asked only of documents of at least WORD_GUARD words, the one of
characters of CHAR_GUARD characters, and only where the language has a reference.

Base: n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words (words in windows
of eight words found twice or more in the text); base_failed if n_words < 20 or
100 * n_repeat_words > 30 * n_words.

Edge cases: null and empty text have no words and fail; ties do not arise; repeated rows, null doc_id and
unknown languages are judged as rows; an empty table gives none. Columns other than doc_id, text and lang
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestream.llm.common import cut, let, numbered

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CHAR_LIMIT, WORD_LIMIT, CHAR_GUARD, WORD_GUARD = 0.2, 0.28, 100, 80
# Frequent words of the four languages.
COMMON = {
    "en": "the of and to a in is that for it with as".split(),
    "fr": "de la le et les des en un que du est une".split(),
    "de": "der die und das den zu in ist mit von für ein".split(),
    "es": "de la que el en y los se del las un por".split(),
}
#: Character classes, as regular expressions; the rest is the last class.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[\s]+", r"[.,;:'\"()?-]+")


def covered(hashes: Column) -> Column:
    """Words that stand in windows whose hash occurs twice or more; hashes: of the windows in order."""

    def neighbours(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
        after = F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
        same = F.filter(
            F.arrays_zip(s.alias("own"), before.alias("before"), after.alias("after")),
            lambda x: F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(same, lambda x: x["own"]["i"]))

    def words(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(order, neighbours), words)


def features(docs: DataFrame, *key: str) -> DataFrame:
    """doc_id, key, lang, the base counts, and the two histograms of every row."""
    lines = r"[^\x20\x09-\x0D]"
    text = docs.select(F.col("doc_id"), *key, F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    split = text.withColumn("trimmed", F.btrim("t", F.lit(SPACE_CHARS))).withColumn(
        "w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACE))
    )
    hashed = split.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w"))
    # the hash of 2, 4 and then 8 words from each word on is that of two halves
    windows, span = hashed.withColumn("h", F.col("wh")), 1
    while span < WINDOW:
        rest = F.greatest(F.size("h") - span, F.lit(0))
        windows = windows.withColumn("h", F.zip_with(F.slice("h", F.lit(1), rest), F.slice("h", F.lit(span + 1), rest), lambda x, y: F.xxhash64(x, y)))
        span *= 2
    size = F.length("t")
    # each class is counted in what the classes before it leave
    class_counts, before = [], "t"
    for k, pattern in enumerate(CLASSES):
        windows = windows.withColumn(f"left{k}", F.regexp_replace(before, pattern, ""))
        class_counts.append(F.length(before) - F.length(f"left{k}"))
        before = f"left{k}"
    every_common = sorted({w for words in COMMON.values() for w in words})
    common = F.filter(F.transform("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:"))), lambda x: x.isin(every_common))
    counted = windows.select(
        "doc_id",
        *key,
        "lang",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(lines)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), covered(F.col("h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        size.cast("long").alias("n_chars_all"),
        F.array(*[c.cast("double") for c in class_counts]).alias("classes"),
        let(common, lambda c: F.transform(F.array(*map(F.lit, every_common)), lambda x: F.size(F.filter(c, lambda y: y == x)).cast("double"))).alias("commons"),
    )
    rest = lambda total, counts: F.concat(counts, F.array(F.greatest(F.lit(0.0), total - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x))))
    return (
        counted.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("classes", rest(F.col("n_chars_all").cast("double"), F.col("classes")))
        .withColumn("commons", rest(F.col("n_words").cast("double"), F.col("commons")))
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of equal length (counts; both with a sum above 0)."""
    share = lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), lambda s: F.transform(a, lambda x: x / F.greatest(s, F.lit(1e-9))))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = F.zip_with(share(p), share(q), lambda x, y: let((x + y) / 2, lambda m: (term(x, m) + term(y, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))


def judge(docs: DataFrame, *key: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the two distances (null where there is no reference), and the
    columns key."""
    table = cut(features(docs, *key))
    sums = []
    for name in ("classes", "commons"):
        length = len(CLASSES) + 1 if name == "classes" else len({w for words in COMMON.values() for w in words}) + 1
        sums.append(F.array(*[F.sum(F.col(name)[i]) for i in range(length)]).alias(f"{name}_ref"))
    reference = table.where("NOT base_failed").groupBy(F.col("lang").alias("ref_lang")).agg(*sums)
    joined = table.join(reference, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    far = joined.withColumn("char_distance", F.when(F.col("classes_ref").isNotNull() & (F.col("n_chars_all") >= CHAR_GUARD), jensen_shannon(F.col("classes"), F.col("classes_ref")))).withColumn(
        "word_distance", F.when(F.col("commons_ref").isNotNull() & (F.col("n_words") >= WORD_GUARD), jensen_shannon(F.col("commons"), F.col("commons_ref")))
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance", "word_distance", *key
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are judged good, each by its own text (all columns kept)."""
    marked, _ = numbered(docs)
    gone = judge(marked, "__row").where("NOT kept").select("__row")
    return marked.join(gone, "__row", "left_anti").select(*docs.columns)
