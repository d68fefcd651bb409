"""Text scores and gates as column functions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestream.functions.bind import let

# Character classes of the readability score, and shapes of addresses.
CONSONANT = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXYZ"
VOWEL = "aeiouAEIOUy"
PUNCTUATION = r"[.,:;/\-()#@%+*=?!'\" \t\n]"
MARKS = ".,:;/-()#@%+*=?!'\" \t\n".replace(" ", "")
CONTROL = "".join(map(chr, [*range(9), *range(11, 32), 127]))
PRINTABLE = "".join(map(chr, range(32, 127)))
EMAIL = r"[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9-]{2,}\.[A-Za-z]{2,}"
URL = r"https?://|www\.[A-Za-z0-9-]+\.[A-Za-z]{2,}|[A-Za-z0-9-]+\.[A-Za-z]{2,}/"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def among(text: Column, characters: str) -> Column:
    """How many characters of a text are of the given ones."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def english_score(text: Column) -> Column:
    """How much a text looks like words, 0 to 1; 0 for empty and null."""
    run = F.transform(F.regexp_extract_all(text, F.lit(f"([{CONSONANT}]{{5,}})"), F.lit(1)), lambda w: F.length(w))  # shorter runs cost nothing
    counts = F.struct(
        F.length(text).alias("n"),
        among(text, string.ascii_letters).alias("letters"),
        among(text, " ").alias("spaces"),
        # the space counts with the letters, so it is not among the marks
        among(text, string.digits + MARKS).alias("marks"),
        among(text, CONTROL).alias("control"),
        among(text, VOWEL).alias("vowels"),
        F.coalesce(F.array_max(run), F.lit(0)).alias("run"),
    )

    def score(c: Column) -> Column:
        ratio = c["vowels"] / F.nullif(c["letters"], F.lit(0))
        outside = F.greatest(F.lit(0.0), F.lit(0.18) - ratio, ratio - F.lit(0.55))
        balance = F.when(c["letters"] < 3, F.lit(0.3)).otherwise(F.greatest(F.lit(0.0), 1 - outside / 0.20))
        raw = (c["letters"] + c["spaces"]) / c["n"] + 0.5 * F.least(c["marks"] / c["n"], F.lit(0.30)) - 2.5 * c["control"] / c["n"] - 0.2 * F.greatest(F.lit(0), c["run"] - 4)
        return F.when(F.coalesce(c["n"], F.lit(0)) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (0.4 + 0.6 * balance))))

    return let(counts, score)


def printable_ratio(text: Column) -> Column:
    return among(text, PRINTABLE) / F.length(text)


def unescaped(text: Column) -> Column:
    """Written-out line ends and tabs as spaces."""
    for mark in ("\\t", "\\n", "\\r"):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_clean_alpha(text: Column, floor: float = 0.45) -> Column:
    """Cheap tests first: length, control characters, then the score."""
    return (F.length(text) >= 12) & ((~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))) & (english_score(text) >= floor)


def looks_encoded(text: Column) -> Column:
    tokens = F.filter(F.split(unescaped(text), r"\s+"), lambda t: t != "")
    longest = F.array_max(F.transform(tokens, lambda t: F.length(t)))
    address = F.exists(tokens, lambda t: t.rlike(EMAIL) | t.rlike(URL))
    only = F.get(tokens, F.lit(0))
    alphabet = (F.size(tokens) == 1) & (F.length(only) >= 20) & (count(only, "[A-Za-z0-9+/=]") >= 0.9 * F.length(only))
    return F.when(F.size(tokens) == 0, False).when(address, False).otherwise((longest >= 24) | alphabet)


def is_readable(text: Column) -> Column:
    plain = unescaped(text)
    return (
        (F.length(F.trim(F.regexp_replace(plain, r"\s+", " "))) >= 3)
        & (among(plain, PRINTABLE) >= 0.85 * F.length(plain))
        & plain.rlike("[A-Za-z]{3}")  # which are three letters, too
        & ~looks_encoded(text)
    )


def dedup_key(text: Column) -> Column:
    """White space collapsed and trailing [digits] groups dropped."""
    return F.trim(F.regexp_replace(collapsed(text), r"(\s*\[[0-9]+\])+$", ""))


def quality_key(text: Column) -> Column:
    """Smaller is less garbled: characters that are no letters, then length."""
    return F.struct((F.length(text) - count(text, r"\p{L}")).alias("other"), (-F.length(text)).alias("shorter"))
