"""BCH(31,21) with parity, and bit unpacking, as column functions over BIGINT words."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.functions.bind import let

# Fixed value: the generator polynomial x^10 + x^9 + x^8 + x^6 + x^5 + x^3 + 1.
GENERATOR = 0x769


def remainder(word: int) -> int:
    """Remainder of a 31-bit polynomial by the generator."""
    for bit in range(30, 9, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 10)
    return word


def syndrome_of(word: int) -> int:
    """Remainder of the upper 31 bits, and the parity of all 32 below it."""
    return remainder(word >> 1) << 1 | (word.bit_count() & 1)


def encode(data: int) -> int:
    """21 data bits to a codeword of even parity."""
    word = data << 10 | remainder(data << 10)
    return word << 1 | (word.bit_count() & 1)


#: The syndrome of each single bit; the syndrome is linear, so a word's is the XOR of its bits'.
BITS = tuple(syndrome_of(1 << i) for i in range(32))


def syndrome(word: Column) -> Column:
    """11 bits, from the 32 low bits of a word."""
    out = None
    for i, s in enumerate(BITS):
        term = F.shiftright(word, i).bitwiseAND(F.lit(1)) * F.lit(s)
        out = term if out is None else out.bitwiseXOR(term)
    return out


def error_table() -> dict[int, int]:
    """Syndrome to the error of one or two bits that makes it."""
    table: dict[int, int] = {}
    for weight in (1, 2):
        for bits in combinations(range(32), weight):
            error = sum(1 << b for b in bits)
            s = 0
            for b in bits:
                s ^= BITS[b]
            table.setdefault(s, error)
    return table


def errors(spark: SparkSession) -> DataFrame:
    """(syndrome, error): 528 rows."""
    return spark.createDataFrame(sorted(error_table().items()), "syndrome long, error long")


def hard_decode(words: DataFrame, column: str = "word") -> DataFrame:
    """Adds fixed (null if not correctable) and n_errors (0, 1, 2 or -1)."""
    with_syndrome = words.withColumn("syndrome", syndrome(F.col(column)).cast("long"))
    joined = with_syndrome.join(F.broadcast(errors(words.sparkSession)), "syndrome", "left")  # 528 rows by construction
    return joined.select(
        *words.columns,
        "syndrome",
        F.when(F.col("syndrome") == 0, F.col(column)).otherwise(F.col(column).bitwiseXOR(F.col("error"))).alias("fixed"),
        F.when(F.col("syndrome") == 0, 0).otherwise(F.coalesce(F.bit_count("error"), F.lit(-1))).cast("int").alias("n_errors"),
    )


def chase_decode(word: Column, magnitudes: Column, weak: int = 4) -> Column:
    """Soft decoding: all flips of the `weak` least reliable bits (ties to the lower bit) are decoded hard, and the
    result nearest to the word by the magnitudes of its changed bits wins (ties to the lower flip pattern).
    magnitudes[i] belongs to bit 31 - i. Null if nothing decodes."""
    known = error_table()
    by_syndrome = F.lit([0, *(known.get(s, -1) for s in range(1, 1 << 11))]).cast("array<bigint>")  # -1: no error of two bits
    bit = lambda i: F.pow(F.lit(2), F.lit(31) - i).cast("long")
    weakest = F.transform(F.slice(F.array_sort(F.transform(magnitudes, lambda m, i: F.struct(m.alias("m"), i.alias("i")))), 1, weak), lambda x: bit(x["i"]))

    def flipped(masks: Column) -> Column:
        chosen = lambda combo: F.transform(masks, lambda m, k: F.when(F.bit_get(combo, k) == 1, m).otherwise(F.lit(0).cast("long")))
        flip = lambda combo: F.aggregate(chosen(combo), word, lambda a, m: a.bitwiseXOR(m))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << weak) - 1)), lambda combo: F.struct(combo.alias("combo"), flip(combo).alias("w")))

    def fixed(table: Column, tried: Column) -> Column:
        found = F.transform(tried, lambda x: F.struct(x["combo"].alias("combo"), x["w"].alias("w"), F.get(table, syndrome(x["w"]).cast("int")).alias("e")))
        good = F.transform(F.filter(found, lambda x: x["e"] >= 0), lambda x: F.struct(x["combo"].alias("combo"), x["w"].bitwiseXOR(x["e"]).alias("w")))
        distance = lambda change: F.aggregate(F.transform(magnitudes, lambda m, i: F.when(F.bit_get(change, F.lit(31) - i) == 1, m).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
        return F.array_min(F.transform(good, lambda x: F.struct(distance(x["w"].bitwiseXOR(word)).alias("distance"), x["combo"].alias("combo"), x["w"].alias("word"))))["word"]

    return let(by_syndrome, lambda table: let(weakest, lambda masks: let(flipped(masks), lambda tried: fixed(table, tried))))


def reverse_bits(word: Column, width: int = 32) -> Column:
    out = None
    for i in range(width):
        term = F.shiftright(word, i).bitwiseAND(F.lit(1).cast("long")) * F.lit(1 << (width - 1 - i))
        out = term if out is None else out.bitwiseOR(term)
    return out


def unmask(word: Column) -> Column:
    """The 21 data bits of a decoded word, in order, inverted back."""
    return reverse_bits(word).bitwiseAND(F.lit(0x1FFFFF)).bitwiseXOR(F.lit(0x1FFFFF))


def pack_msb(bits: Column) -> Column:
    """Bits, first is the highest, to a number."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def capcode(first: Column, second: Column) -> Column:
    """Address of a short (one word) or long (two words) address."""
    long_form = (first < 0x8001) | (first > 0x1E0000)
    # Offsets of the two address ranges.
    return F.when(long_form, first + second.bitwiseXOR(F.lit(0x1FFFFF)) * F.lit(1 << 15) + F.lit(0x1F9000)).otherwise(first - 0x8000)


def alpha_characters(words: Column) -> Column:
    """Three 7-bit characters a word, low bits first, without end marks (3)."""
    three = F.flatten(F.transform(words, lambda w: F.array(*[F.shiftright(w, s).bitwiseAND(F.lit(127)) for s in (0, 7, 14)])))
    return F.filter(three, lambda c: c != 3)


def text_of(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.char(c.cast("long"))), "")


def seven_bit(bits: Column) -> Column:
    """Characters of seven bits, lowest first, without 0 and 4; bits left over are ignored."""

    def codes(b: Column) -> Column:
        starts = F.when(F.size(b) >= 7, F.sequence(F.lit(0), F.size(b) - 7, F.lit(7))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: sum((F.get(b, at + k) * F.lit(1 << k) for k in range(1, 7)), F.get(b, at)))

    return F.filter(let(bits, codes), lambda c: ~c.isin(0, 4))


# Fixed value: the digit alphabet; 12 is the filler.
DIGITS = tuple("0123456789 U") + (None,) + tuple("-][")


def digits(words: Column, skip: int) -> Column:
    """4-bit digits through 21-bit words, low bits first, after `skip` bits, without the filler 12."""
    letters = F.array(*map(F.lit, DIGITS))

    def digit(w: Column, at: Column) -> Column:
        """The digit at a bit: it begins in one word and may end in the next."""
        i, off = F.floor(at / 21).cast("int"), at % 21
        low = F.call_function("shiftright", F.get(w, i).bitwiseAND(F.lit(0x1FFFFF)), off)
        code = F.when(off <= 17, low).otherwise(low.bitwiseOR(F.call_function("shiftleft", F.get(w, i + 1), F.lit(21) - off)))
        return F.get(letters, code.bitwiseAND(F.lit(15)).cast("int"))

    def read(w: Column) -> Column:
        last = F.size(w) * 21 - 4
        starts = F.when(last >= skip, F.sequence(F.lit(skip), last, F.lit(4))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: digit(w, at))

    return F.array_join(let(words, read), "")
