"""Self-join of documents by the Jaccard similarity of their word-shingle sets.

Method: T-occurrence search with DivideSkip, twice. Equal sets are one set from the start.

1. The hash range is cut into as many parts as the size class of the smaller set asks for, and a part's list holds the
   sets that have the same shingles there. Sets of n and m shingles with overlap T or more differ in n + m - 2T
   shingles at most, so in as many parts at most, and occur together in the lists of all other parts. As in DivideSkip,
   all but one of that number of lists may be set aside, and these are the longest: the parts with the fewest shingles.
   The other lists are merged in Spark, and sets that meet in one form candidate clusters. Single shingles would not do:
   in a large corpus most of them are shared by chance, while parts are shared by copies. In a list, pairs are dropped
   only if counts of shingles by class, which bound the overlap from above, show that they cannot reach the threshold,
   so no link is lost.
2. Inside a cluster the sets are indexed by whole inverted lists of shingles and searched with every set: short lists
   are merged, the longest only probed by binary search for the sets that can still reach T. Links are decided on whole
   sets; they leave as stars, since components are what is asked for, and a search ends when its sets are one component.

A cluster of more than BLOCK sets is not compared all with all. Every set is searched against some PIVOTS sets
first; then only sets outside the largest component found are searched against the cluster.

Edge cases: null text and text without words have an empty set, which links with nothing; fewer words
than a shingle make one shingle of all; repeated shingles count once; repeated rows of one doc_id are compared
as rows, and component_id is the smallest doc_id among a component's rows; an empty table gives an empty result;
rows of null doc_id link with nothing and have no component. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.llm.bytehash import U, mix, shingle_hashes, word_hashes
from pagestream.llm.common import bounded_batches, components, cut, discard, numbered, release

#: Sets to a block, and pivots of a cluster that has more.
BLOCK, PIVOTS = 768, 64
#: Classes of shingles in a histogram: the least number, and how many shingles a class holds at most on average.
BINS, PER_BIN = 128, 16
#: Size classes end at this multiple of where they begin; one part in SPARE is there only to be set aside.
WIDER, SPARE = 1.5, 8


def distinct(sorted_: np.ndarray) -> np.ndarray:
    """Flags of the first of equal neighbours."""
    return np.append(len(sorted_) > 0, sorted_[1:] != sorted_[:-1])[: len(sorted_)]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    s = np.sort(shingle_hashes(word_hashes(text), size))
    return s[distinct(s)]


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each class; 255 stands for that or more. Longer sets have 4, 16, ... times the
    classes, which are the next bits of the hash, so that neighbours add up to the classes of shorter sets."""
    bits = 7
    while PER_BIN << bits < len(shingles):
        bits += 2
    return np.minimum(np.bincount((shingles >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(bins: np.ndarray, classes: int) -> np.ndarray:
    """Histograms (last axis) with fewer classes."""
    return bins.reshape(*bins.shape[:-1], classes, -1).sum(axis=-1, dtype=np.int64)


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles with histograms x and y (last axis) can have the similarity. The overlap is
    at most the sum of the lesser counts; a histogram cut at 255 (its counts fall short of n) bounds nothing."""
    whole = (x.sum(axis=-1, dtype=np.int64) == n) & (y.sum(axis=-1, dtype=np.int64) == m)
    most = np.where(whole, np.minimum(x, y).sum(axis=-1, dtype=np.int64), np.minimum(n, m))
    return 100 * most >= percent * (n + m - most)


MARKS = "row long, n long, k1 long, k2 long, bins binary"


def _signatures(size: int):
    """Row, set size, set key and histogram of each text."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, size)
                rows.append((row, len(s), *set_key(s), histogram(s)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], [c.split()[0] for c in MARKS.split(", ")])

    return run


def most_differing(total: int, percent: int) -> int:
    """How many shingles at most are in one only of two linked sets that have so many together."""
    return total * (100 - percent) // (100 + percent)


class Parts:
    """The lists that sets of one threshold are dealt to. Pairs meet in the class of the smaller set."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.bounds, self.salts = percent, [1], [], []

    def _class(self, n: int) -> int:
        """The class of sets of n shingles: class c holds sizes from ends[c] to ends[c + 1] - 1."""
        while self.ends[-1] <= n:
            end = max(self.ends[-1] + 1, int(self.ends[-1] * WIDER))
            differ = most_differing(end - 1 + 100 * (end - 1) // self.percent, self.percent)
            parts = differ + 2 + differ // SPARE
            self.ends.append(end)
            self.bounds.append(np.array([-(-(i << 64) // parts) for i in range(1, parts)], U))
            self.salts.append(mix((np.arange(1, parts + 1, dtype=U) << U(16)) + U(len(self.ends))))
        return bisect.bisect_right(self.ends, n) - 1

    def of(self, s: np.ndarray) -> np.ndarray:
        """Lists of a set (sorted hashes) such that two sets that link share one, unless they are equal."""
        n, out = len(s), []
        if not n:
            return s
        sums = np.append(U(0), np.cumsum(mix(s + U(1))))
        own = self._class(n)
        for c in range(self._class(-(-self.percent * n // 100)), own + 1):
            partner = 100 * n // self.percent if c == own else self.ends[c + 1] - 1  # the largest that it meets here
            differ = most_differing(n + partner, self.percent)
            if not differ:
                continue
            edge = np.concatenate([[0], np.searchsorted(s, self.bounds[c]), [n]])
            count = np.diff(edge)
            lists = mix(np.diff(sums[edge]) + self.salts[c]) >> U(6) | U(63) - np.minimum(count, 63).astype(U) << U(58)
            # the longest lists are the last; the order depends on the list alone, so the first that two sets share is kept by both
            out.append(np.partition(lists, differ)[: differ + 1])
        return np.concatenate(out) if out else s[:0]


def _dealt(size: int, percent: int):
    """(token, k1): the lists of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(percent)
        for batch in batches:
            tokens, keys = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, size)
                tokens.append(parts.of(s))
                keys.append(np.full(len(tokens[-1]), set_key(s)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64), pa.int64()), pa.array(np.concatenate(keys), pa.int64())], ["token", "k1"])

    return run


def _alike(percent: int):
    """Lists of sets (node, n, bins) to edges (a, b) of pairs that may link, as stars around the smallest node of
    what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            alike: dict[tuple, list] = {}
            for x in zip(*(batch.column(i) for i in range(3))):
                bins = [np.frombuffer(v, np.uint8) for v in x[2].values.to_pylist()]
                classes = {len(v) for v in bins}
                alike.setdefault((len(bins), classes.pop()) if len(bins) <= 8 and len(classes) == 1 else (0, 0), []).append((x[0].values.to_numpy(), x[1].values.to_numpy(), bins))
            for (size, classes), group in alike.items():
                if size:  # many short lists at once
                    node, n = (np.stack([x[k] for x in group]) for k in (0, 1))
                    bins = np.stack([np.stack(x[2]) for x in group])
                    for i in range(size):
                        for j in range(i + 1, size):
                            ok = may_link(n[:, i], n[:, j], bins[:, i], bins[:, j], percent)
                            out_a.append(np.minimum(node[ok, i], node[ok, j]))
                            out_b.append(np.maximum(node[ok, i], node[ok, j]))
                    continue
                for node, n, bins in group:
                    by = np.argsort(node)
                    node, n, union = node[by], n[by], Union(len(node))
                    length = np.array([len(bins[i]) for i in by])
                    for classes in np.unique(length):  # each pair is compared by the classes of the shorter set
                        at = np.flatnonzero(length >= classes)
                        h = np.stack([folded(bins[by[i]], int(classes)) for i in at])
                        for i in np.flatnonzero(length[at] == classes):
                            if union.parts == 1:
                                break
                            for j in np.flatnonzero(may_link(n[at[i]], n[at], h[i], h, percent)):
                                union.join(int(at[i]), int(at[j]))
                    a, b = union.stars()
                    out_a.append(node[a])
                    out_b.append(node[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    return run


class Union:
    """Parts of 0..n-1 joined pair by pair; the first of a part stands for it."""

    def __init__(self, n: int):
        self.first, self.parts = list(range(n)), n

    def root(self, x: int) -> int:
        first = self.first
        while first[x] != x:
            first[x] = first[first[x]]
            x = first[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.first[max(x, y)] = min(x, y)
            self.parts -= 1

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(r, i) for i in range(len(self.first)) if (r := self.root(i)) != i]
        return [a for a, _ in pairs], [b for _, b in pairs]


def divide_skip(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> Union:
    """The parts that links join. With left (one flag a set), only pairs of a flagged and an unflagged set are asked
    for. Pairs already in one part are not compared, and the search ends when one part is left."""
    sizes = np.array([len(s) for s in sets], np.int64)
    union = Union(len(sets))
    if not sizes.sum():
        return union
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by], owners[by]
    value, begin = np.unique(tokens, return_index=True)
    end = np.append(begin[1:], len(tokens))
    for i, own in enumerate(sets):
        if union.parts == 1:
            break
        if not len(own) or (left is not None and not left[i]):
            continue
        at = np.searchsorted(value, own)
        lo, hi = begin[at], end[at]
        least = -(-percent * len(own) // 100)
        length = hi - lo
        order = np.argsort(length, kind="stable")
        longest = int(length[order[-1]])
        n_long = min(int(least / (0.05 * np.log2(longest + 1) + 1)), least - 1, len(own) - 1)
        short, long = order[: len(own) - n_long], order[len(own) - n_long :]
        short = short[length[short] > 1]
        merged = np.concatenate([owners[lo[x] : hi[x]] for x in short]) if len(short) else np.zeros(0, np.int64)
        # n_long short of the overlap may still come from the long lists
        count = np.bincount(merged, minlength=len(sets))
        found = np.flatnonzero(count >= max(1, least - n_long))
        found = found[(sizes[found] * 100 >= percent * len(own)) & (sizes[found] * percent <= 100 * len(own))]
        found = found[found > i] if left is None else found[~left[found]]
        mine = union.root(i)
        found = np.array([j for j in found.tolist() if union.root(j) != mine], np.int64)
        if not len(found):
            continue
        overlap = count[found]
        for x in long:
            members = owners[lo[x] : hi[x]]
            p = np.minimum(np.searchsorted(members, found), len(members) - 1)
            overlap = overlap + (members[p] == found)
        for j in found[100 * overlap >= percent * (len(own) + sizes[found] - overlap)].tolist():
            union.join(i, j)
    return union


def _search(size: int, percent: int):
    """Rows (cid, bi, bj, side, node, text), sorted by cid, bi, bj, to the stars (cid, a, b) of each group. A group
    that holds both sides is searched with the sets of side 0 among those of side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def stars() -> list[tuple[int, int, int]]:
            held.sort(key=lambda x: x[0])
            side = np.array([x[1] for x in held])
            a, b = divide_skip([x[2] for x in held], percent, side == 0 if side.any() else None).stars()
            return [(key[0], held[x][0], held[y][0]) for x, y in zip(a, b) if held[x][0] != held[y][0]]

        for batch in batches:
            out = []
            for *group, side, node, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group != key:
                    if held:
                        out += stars()
                    key, held = group, []
                held.append((node, side, shingle_set(text, size)))
            yield _edges(out)
        if held:
            yield _edges(stars())

    return run


def _edges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], ["cid", "a", "b"])


def _linked(dealt: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """dealt(cid, bi, bj, side, node) searched group by group."""
    texts = dealt.join(rows, dealt.node == rows.row).select("cid", "bi", "bj", "side", "node", "text")
    out = cut(texts.repartition("cid", "bi", "bj").sortWithinPartitions("cid", "bi", "bj").mapInArrow(_search(size, percent), "cid long, a long, b long"))
    release(rows.sparkSession)
    return out


def _blocks(name: str, count, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), count).cast("int").alias(name)


def _every(name: str, count):
    return F.explode(F.sequence(F.lit(0), count - 1)).alias(name)


def _large(large: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that join the linked sets of large clusters. large: (cid, node, c), c the cluster's size."""
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    pivot = large.where(F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / PIVOTS)) == 0)
    first = pivot.select("cid", F.lit(0).alias("bi"), _every("bj", nb), F.lit(0).alias("side"), "node").unionByName(
        large.select("cid", F.lit(0).alias("bi"), _blocks("bj", nb, 2), F.lit(1).alias("side"), "node")
    )
    found = _linked(first, rows, size, percent).select("a", "b")
    labels = components(found)
    placed = cut(large.join(labels, "node", "left").select("cid", "node", "c", F.coalesce("component", "node").alias("label")))
    main = placed.groupBy("cid", "label").count().groupBy("cid").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("c"))
    sizes = cut(main.select("cid", F.col("m.label").alias("main"), F.ceil((F.col("c") - F.col("m.count")) / BLOCK).cast("int").alias("nr")).where("nr > 0"))
    both = placed.join(sizes, "cid")
    rest = both.where("label != main").select("cid", _blocks("bi", F.col("nr"), 3), _every("bj", nb), F.lit(0).alias("side"), "node")
    second = rest.unionByName(both.select("cid", _every("bi", F.col("nr")), _blocks("bj", nb, 2), F.lit(1).alias("side"), "node"))
    return found.unionByName(_linked(second, rows, size, percent).select("a", "b"))


def _labelled(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, n, label) of rows(row, text): set size, and the smallest row reachable by links."""
    spark = rows.sparkSession
    bounded_batches(spark)
    sets = cut(rows.mapInArrow(_signatures(size), MARKS))
    classes = cut(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("n").alias("n"), F.min("bins").alias("bins")))
    dealt = rows.select("text").mapInArrow(_dealt(size, percent), "token long, k1 long")
    shared = cut(dealt.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("token"))
    release(spark)
    hits = cut(dealt.join(shared, "token", "left_semi").distinct())
    release(spark)
    # tokens with the same list need one search
    lists = hits.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("k1")).alias("x"), F.sum(F.pmod(F.xxhash64("k1", F.lit(1)), F.lit(1 << 31))).alias("y")).groupBy("c", "x", "y").agg(F.min("token").alias("token"))
    lists = cut(lists.select("token", "c"))
    listed = hits.join(lists, "token").join(classes.select("k1", "node", "n", "bins"), "k1")
    short = listed.where(F.col("c") <= BLOCK).groupBy("token").agg(F.collect_list(F.struct("node", "n", "bins")).alias("x"))
    edges = short.select("x.node", "x.n", "x.bins").mapInArrow(_alike(percent), "a long, b long").distinct()
    # longer lists are clusters as they stand
    wide = cut(listed.where(F.col("c") > BLOCK).select("token", "node"))
    least = cut(wide.groupBy("token").agg(F.min("node").alias("a")))
    edges = cut(edges.unionByName(wide.join(least, "token").select("a", F.col("node").alias("b")).where("a != b").distinct()))
    discard(shared, hits, lists, wide, least)
    release(spark)
    cluster = components(edges).withColumnRenamed("component", "cid")
    many = cut(cluster.groupBy("cid").agg(F.count("*").alias("c")))
    member = cut(cluster.join(many, "cid").select("cid", "node", "c"))
    small = member.where(F.col("c") <= BLOCK).select("cid", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "node")
    label = _linked(small, rows, size, percent).select(F.col("b").alias("node"), F.col("a").alias("component"))
    large = member.where(F.col("c") > BLOCK)
    if not large.isEmpty():
        label = label.unionByName(components(_large(large, rows, size, percent)))
    label = cut(label)
    discard(edges, many, member)
    placed = cut(classes.join(label, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("label")))
    discard(classes, label)
    return sets.join(placed, ["k1", "k2"], "left").select("row", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("row")).alias("label"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least percent/100)."""
    docs, is_key = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = _labelled(_rows(docs), size, percent)
    if is_key:
        return found.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))
    named = cut(docs.select("doc_id", "__row").join(found.withColumnRenamed("row", "__row"), "__row", "left"))
    smallest = cut(named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    null = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.where("label IS NOT NULL").join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(null)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component (the smallest doc_id), with all columns. Rows of null
    doc_id stay."""
    marked, is_key = numbered(docs)
    found = _labelled(_rows(marked), size, percent)
    if is_key:
        gone = found.where("row != label").select(F.col("row").alias("__row"))
    else:
        named = cut(found.join(marked.select(F.col("__row").alias("row"), F.col("doc_id").alias("__id")), "row"))
        first = cut(named.groupBy("label").agg(F.min(F.struct("__id", "row")).alias("first")))
        gone = named.join(first, "label").where("row != first.row").select(F.col("row").alias("__row"))
    return marked.join(gone, "__row", "left_anti").select(*docs.columns)
