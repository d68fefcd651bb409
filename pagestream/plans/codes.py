"""Queries of error correction, unpacking and page grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestream.functions import fec
from pagestream.functions import text as T
from pagestream.plans.base import spread, table
from pagestream.plans.texts import SCORE

_SYN = lambda w: "xor(" * 31 + f"((({w}) >> 0) & 1) * {fec.BITS[0]}" + "".join(f", ((({w}) >> {i}) & 1) * {fec.BITS[i]})" for i in range(1, 32))
# a codeword from an order key: the low 21 bits encoded by the parity-check identity, then up to three bits flipped
_CODE = [fec.encode(1 << b) for b in range(21)]


def _encoded(key):
    out = None
    for b, c in enumerate(_CODE):
        term = F.shiftright(key, b).bitwiseAND(F.lit(1).cast("long")) * F.lit(c)
        out = term if out is None else out.bitwiseXOR(term)
    return out


_SENT = "xor(" * 20 + f"((o_orderkey >> 0) & 1) * {_CODE[0]}" + "".join(f", ((o_orderkey >> {b}) & 1) * {_CODE[b]})" for b in range(1, 21))
_FLIP = "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1::BIGINT << (o_orderkey % 32)::INT WHEN 2 THEN xor(1::BIGINT << (o_orderkey % 32)::INT, 1::BIGINT << ((o_orderkey + 7) % 32)::INT) ELSE xor(xor(1::BIGINT << (o_orderkey % 32)::INT, 1::BIGINT << ((o_orderkey + 7) % 32)::INT), 1::BIGINT << ((o_orderkey + 13) % 32)::INT) END"
WORDS = f"SELECT o_orderkey, xor({_SENT}, ({_FLIP})::BIGINT) AS word FROM orders"
_TABLE = ", ".join(f"({s}, {e})" for s, e in sorted(fec.error_table().items()))
DECODED = f"""WITH w AS ({WORDS}), s AS (SELECT o_orderkey, word, {_SYN('word')} AS syndrome FROM w), t(syn, error) AS (VALUES {_TABLE})
 SELECT o_orderkey, word, syndrome::BIGINT AS syndrome, CASE WHEN syndrome = 0 THEN word ELSE xor(word, error::BIGINT) END AS fixed, CASE WHEN syndrome = 0 THEN 0 ELSE coalesce(bit_count(error::BIGINT)::INT, -1) END AS n_errors FROM s LEFT JOIN t ON syndrome = syn"""


def words(s, d):
    k = F.col("o_orderkey")
    bit = lambda add: F.expr(f"shiftleft(1L, int(pmod(o_orderkey + {add}, 32)))")
    m = F.pmod(k, F.lit(4))
    flip = F.when(m == 0, F.lit(0).cast("long")).when(m == 1, bit(0)).when(m == 2, bit(0).bitwiseXOR(bit(7))).otherwise(bit(0).bitwiseXOR(bit(7)).bitwiseXOR(bit(13)))
    return table(s, d, "orders").select("o_orderkey", _encoded(k).bitwiseXOR(flip).alias("word"))


def syndromes(s, d):
    return words(s, d).select("o_orderkey", fec.syndrome(F.col("word")).cast("long").alias("syndrome"))


def decoded(s, d):
    return fec.hard_decode(words(s, d))


def status_counts(s, d):
    return decoded(s, d).groupBy("n_errors").agg(F.count("*").alias("n"), F.count_if(F.col("fixed").isNull()).alias("n_failed"))


def chase(s, d):
    """Soft decoding of the words that hard decoding rejects."""
    failed = decoded(s, d).where("n_errors < 0").select("o_orderkey", "word")
    magnitudes = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.pmod(F.col("o_orderkey") * 31 + i * 17, F.lit(97)) + 1).cast("double"))
    return failed.select("o_orderkey", "word", fec.chase_decode(F.col("word"), magnitudes).alias("fixed"))


_magnitude = "((o_orderkey * 31 + i * 17) % 97 + 1)"
CHASE = f"""WITH f AS (SELECT o_orderkey, word FROM ({DECODED}) WHERE n_errors < 0), b AS (SELECT o_orderkey, word, i, {_magnitude} AS m FROM f, range(32) r(i)),
 weak AS (SELECT o_orderkey, list(1::BIGINT << (31 - i)::INT ORDER BY m, i)[:4] AS masks FROM b GROUP BY o_orderkey),
 tried AS (SELECT f.o_orderkey, word, c, xor(xor(xor(xor(word, masks[1] * (c & 1)), masks[2] * ((c >> 1) & 1)), masks[3] * ((c >> 2) & 1)), masks[4] * ((c >> 3) & 1)) AS w FROM f JOIN weak USING (o_orderkey), range(16) r(c)),
 t(syn, error) AS (VALUES (0, 0), {_TABLE}),
 good AS (SELECT o_orderkey, word, c, xor(w, error::BIGINT) AS w FROM tried JOIN t ON {_SYN('w')} = syn),
 far AS (SELECT o_orderkey, word, c, w, sum(CASE WHEN (xor(w, word) >> (31 - i)::INT) & 1 = 1 THEN {_magnitude} ELSE 0 END) AS d FROM good, range(32) r(i) GROUP BY ALL),
 best AS (SELECT o_orderkey, w FROM far QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d, c) = 1)
 SELECT f.o_orderkey, word, w AS fixed FROM f LEFT JOIN best USING (o_orderkey)"""


def deinterleave(s, d):
    """Blocks of 256 bits to eight words: bit i*8+j is bit i of word j, first is highest."""
    bits = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.pmod(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.lit(256)).cast("int").alias("idx"), F.floor((F.col("l_orderkey") * 8 + F.col("l_linenumber")) / 256).alias("block"), F.pmod(F.col("l_partkey"), F.lit(2)).alias("bit"))
    return bits.groupBy("block", F.pmod("idx", F.lit(8)).alias("j")).agg(F.sum(F.expr("shiftleft(bit, int(31 - floor(idx / 8)))")).alias("word"), F.count("*").alias("n_bits"))


def capcodes(s, d):
    aw1, aw2 = F.pmod(F.col("l_partkey") * 7919, F.lit(2097152)), F.pmod(F.col("l_orderkey") * 104729, F.lit(2097152))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fec.capcode(aw1, aw2).alias("capcode"))


def unpack(s, d):
    """Letters, digits and 7-bit text from words made of keys."""
    w = F.array(*[F.pmod(F.col("o_orderkey") * p + F.col("o_custkey"), F.lit(2097152)) for p in (7919, 104729, 1299709)])
    bits = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.bit_get(F.col("o_orderkey") * 7919, i).cast("int"))
    return spread(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
        "o_orderkey", F.array_join(fec.alpha_characters(w), ",").alias("alpha"), fec.digits(w, 6).alias("digits"), F.array_join(fec.seven_bit(bits), ",").alias("seven"), fec.unmask(w[0]).alias("unmasked")
    )


def _graded(s, d):
    """Pages of lineitem words, with the body of a document, by confidence: no words are C, as NaN margins are no
    evidence; A and B need 0.85 of printable characters, and letter pages a score of 0.60."""
    li = table(s, d, "lineitem")
    h = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(40))
    margin = F.when(F.pmod(F.col("l_orderkey"), F.lit(11)) == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity") / 25)
    words_ = li.select("l_orderkey", F.when(h == 0, -1).when(h < 4, 1).when(h == 4, 3).otherwise(0).alias("status"), margin.alias("margin"))
    page = words_.groupBy("l_orderkey").agg(F.count("*").alias("n_words"), F.count_if(F.col("status") < 0).alias("failed"), F.count_if(F.col("status").isin(1, 2)).alias("corrected"), F.count_if(F.col("status") == 3).alias("chase"), F.min("margin").alias("margin"))
    bodies = table(s, d, "documents").select(F.col("doc_id").alias("l_orderkey"), F.col("text").alias("body")).where("length(body) > 0")
    typ = F.when(F.pmod(F.col("l_orderkey"), F.lit(3)) == 0, "NUM").otherwise("ALN")
    graded = bodies.join(page, "l_orderkey", "left").withColumns({"typ": typ, "score": F.round(T.english_score(F.col("body")), 6), "printable": T.printable_ratio(F.col("body"))})
    return graded.withColumn("tier", tier(F.col("n_words"), F.col("failed"), F.col("corrected"), F.col("chase"), F.col("margin"), F.col("typ"), F.col("printable"), F.col("score"))).na.fill(0, ["n_words", "failed", "corrected", "chase"])


def tier(n_words, failed, corrected, chase_, margin, typ, printable, score):
    """A to D of a page from what its words needed (n_words null: nothing is known) and how its body reads."""
    decoded_ = F.when(n_words.isNull(), "C").when(failed > 0, "D").when(~F.isnan(margin) & (margin < 0.5), "C").when((corrected > 0) | (chase_ > 0), "B").otherwise("A")
    weak = (printable < 0.85) | ((typ == "ALN") & (score < 0.60))
    return F.when(decoded_.isin("A", "B") & weak, "C").otherwise(decoded_)


_GRADED = f"""SELECT l_orderkey, coalesce(n_words, 0) AS n_words, coalesce(failed, 0) AS failed, coalesce(corrected, 0) AS corrected, coalesce(chase, 0) AS chase, typ,
 CASE WHEN t0 IN ('A', 'B') AND (printable < 0.85 OR (typ = 'ALN' AND score < 0.60)) THEN 'C' ELSE t0 END AS tier FROM (
 SELECT *, CASE WHEN n_words IS NULL THEN 'C' WHEN failed > 0 THEN 'D' WHEN NOT isnan(margin) AND margin < 0.5 THEN 'C' WHEN corrected > 0 OR chase > 0 THEN 'B' ELSE 'A' END AS t0 FROM (
 SELECT doc_id AS l_orderkey, CASE WHEN doc_id % 3 = 0 THEN 'NUM' ELSE 'ALN' END AS typ, round({SCORE}, 6) AS score, len(regexp_extract_all(text, '[ -~]'))::DOUBLE / length(text) AS printable FROM documents WHERE length(text) > 0) b LEFT JOIN (
 SELECT l_orderkey, count(*) AS n_words, count(*) FILTER (status < 0) AS failed, count(*) FILTER (status IN (1, 2)) AS corrected, count(*) FILTER (status = 3) AS chase, min(margin) AS margin FROM (
 SELECT l_orderkey, CASE WHEN (l_partkey + l_suppkey) % 40 = 0 THEN -1 WHEN (l_partkey + l_suppkey) % 40 < 4 THEN 1 WHEN (l_partkey + l_suppkey) % 40 = 4 THEN 3 ELSE 0 END AS status, CASE WHEN l_orderkey % 11 = 0 THEN 'nan'::DOUBLE ELSE l_quantity / 25 END AS margin FROM lineitem) GROUP BY l_orderkey) p USING (l_orderkey))"""


def tiers(s, d):
    return _graded(s, d).select("l_orderkey", "n_words", "failed", "corrected", "chase", "typ", "tier")


def tier_pivot(s, d):
    return _graded(s, d).groupBy("typ").pivot("tier", ["A", "B", "C", "D"]).count().na.fill(0)


def tier_rollup(s, d):
    return _graded(s, d).rollup("tier", "typ").agg(F.count("*").alias("n")).select(F.coalesce("tier", F.lit("all")).alias("tier"), F.coalesce("typ", F.lit("all")).alias("typ"), "n")


_w = lambda p: f"((o_orderkey * {p} + o_custkey) % 2097152)"
_ws = f"[{_w(7919)}, {_w(104729)}, {_w(1299709)}]"
_bits = f"flatten(list_transform({_ws}, lambda w: list_transform(range(0, 21), lambda k: (w >> k::INT) & 1)))"
_nib = f"list_transform(range(0, 14), lambda g: list_sum(list_transform(range(0, 4), lambda k: ({_bits})[6 + g * 4 + k + 1] << k::INT))::BIGINT)"
_sev = "list_transform(range(0, 4), lambda g: list_sum(list_transform(range(0, 7), lambda k: (((o_orderkey * 7919) >> (g * 7 + k)::INT) & 1) << k::INT))::BIGINT)"
_rev = " + ".join(f"((({_w(7919)} >> {i}) & 1) << {31 - i})" for i in range(32))

QUERIES = {
    "fec2_syndrome": (syndromes, f"SELECT o_orderkey, ({_SYN('word')})::BIGINT AS syndrome FROM ({WORDS})"),
    "fec4_bch_decode": (decoded, DECODED),
    "agg4_bch_status": (status_counts, f"SELECT n_errors, count(*) AS n, count(*) FILTER (fixed IS NULL) AS n_failed FROM ({DECODED}) GROUP BY n_errors"),
    "fec5_chase_decode": (chase, CHASE),
    "fec7_deinterleave": (deinterleave, "SELECT block, j, sum(bit << (31 - idx // 8)::INT)::BIGINT AS word, count(*) AS n_bits FROM (SELECT (l_orderkey * 8 + l_linenumber) // 256 AS block, (l_orderkey * 8 + l_linenumber) % 256 AS idx, ((l_orderkey * 8 + l_linenumber) % 256) % 8 AS j, l_partkey % 2 AS bit FROM lineitem) GROUP BY block, j"),
    "prs4_capcode": (capcodes, "SELECT l_orderkey, l_linenumber, CASE WHEN a < 32769 OR a > 1966080 THEN a + xor(b, 2097151) * 32768 + 2068480 ELSE a - 32768 END AS capcode FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 7919) % 2097152 AS a, (l_orderkey * 104729) % 2097152 AS b FROM lineitem)"),
    "prs2_5_6_unpack": (unpack, f"""SELECT o_orderkey, array_to_string(list_filter(flatten(list_transform({_ws}, lambda w: [w & 127, (w >> 7) & 127, (w >> 14) & 127])), lambda c: c <> 3), ',') AS alpha,
 array_to_string(list_transform(list_filter({_nib}, lambda c: c <> 12), lambda c: substr('0123456789 U -][', c + 1, 1)), '') AS digits, array_to_string(list_filter({_sev}, lambda c: c NOT IN (0, 4)), ',') AS seven, xor(({_rev}) & 2097151, 2097151)::BIGINT AS unmasked FROM orders"""),
    "grade_tiers": (tiers, f"SELECT l_orderkey, n_words, failed, corrected, chase, typ, tier FROM ({_GRADED})"),
    "agg1_tier_pivot": (tier_pivot, f"SELECT typ, count(*) FILTER (tier = 'A') AS A, count(*) FILTER (tier = 'B') AS B, count(*) FILTER (tier = 'C') AS C, count(*) FILTER (tier = 'D') AS D FROM ({_GRADED}) GROUP BY typ"),
    "agg2_tier_rollup": (tier_rollup, f"SELECT coalesce(tier, 'all') AS tier, coalesce(typ, 'all') AS typ, count(*) AS n FROM ({_GRADED}) GROUP BY ROLLUP (tier, typ)"),
}
