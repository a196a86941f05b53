"""Near-duplicate records by an LSH forest.

Every record is the set of its words or runs of words. Its signature, minima of
random hash functions, is read in several orders, one for each tree of the forest.
In each order the records are sorted, and the nearest ones on both sides, those
with the longest common prefixes, are candidates: where many records are alike the
prefixes are long, elsewhere short. Candidates are checked on their signatures,
then on the sets themselves. Pairs that are similar link their records to groups.
A family of records that are all alike has more pairs than neighbours; its group is
completed by comparing its members with each other, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distinct import distinct_by
from ..sharedfs import written
from .termfreq import terms

#: Trees, values of the signature that are a tree's own, and values that neighbours have in common at least.
TREES, OWN, LEAST = 24, 4, 2
#: Neighbours on either side of a record in each order, and rows of an order in a task.
WINDOW, TASK_ROWS = 8, 250_000
#: Bytes of the values by which an order is sorted: values further on rarely decide, and one byte will do for an estimate.
WIDTHS = (3, 3, 2, 2, *[1] * 20)
#: Members of a group in a block when its pairs are completed.
BLOCK = 4_000
#: Deviations of the signatures' estimate below the least similarity that are let pass to the exact check.
SLACK = 4.0
#: The same for the estimate by the values of one order alone.
ORDER_SLACK = 2.5
#: Keys that are broadcast at most, of up to 64 characters.
BROADCAST_KEYS = 100_000
#: Members of a class of equal records that are paired in one place; larger classes are cut into parts of about so many.
CLASS = 1_000

_C = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, kept while they are few."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out

    def shingles(self, text: str, run: int) -> np.ndarray:
        """The distinct runs of ``run`` words, as sorted hashes."""
        h = self.hashes(terms(text))
        if len(h) < run:
            return np.empty(0, np.uint64)
        n = len(h) - run + 1
        s = h[:n].copy()
        for j in range(1, run):
            s = _mixed(s + _C) ^ h[j : j + n]
        return np.unique(_mixed(s))


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, m, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each hash function."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * a + b
        low = np.minimum(low, (part >> np.uint64(32)).min(0).astype(np.uint32))
    return low


def order_keys(sig: np.ndarray, tree: int, own: int = OWN, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """The first values of a tree's order as bytes, a row for each row of ``sig``."""
    m = sig.shape[1]
    big = np.ascontiguousarray(sig[:, [(tree * own + d) % m for d in range(len(widths))]].astype(">u4")).view(np.uint8).reshape(len(sig), len(widths), 4)
    return np.concatenate([big[:, d, 4 - w :] for d, w in enumerate(widths)], 1)


def neighbour_pairs(tree: np.ndarray, keys: np.ndarray, ids: np.ndarray, similar: float, window: int = WINDOW, widths: tuple[int, ...] = WIDTHS, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows up to ``window`` apart in sorted orders that have the first LEAST values in common, as ``ids``.

    Pairs whose values in this order speak against a similarity of ``similar`` are
    left out, and those among the first ``fresh`` rows.
    """
    prefix = sum(widths[:LEAST])
    limit = _limit(len(widths), similar, ORDER_SLACK)
    a, b = [ids[:0]], [ids[:0]]
    for k in range(1, min(window, len(ids) - 1) + 1):
        at = np.flatnonzero((tree[k:] == tree[:-k]) & (keys[k:, :prefix] == keys[:-k, :prefix]).all(1))
        at = at[at + k >= fresh]
        equal = keys[at] == keys[at + k]
        values = np.logical_and.reduceat(equal, np.cumsum([0, *widths[:-1]]), axis=1).sum(1) if len(at) else np.empty(0)
        at = at[values >= limit]
        a.append(ids[at]), b.append(ids[at + k])
    x, y = np.concatenate(a), np.concatenate(b)
    return np.minimum(x, y), np.maximum(x, y)


def signatures(df: DataFrame, key: str, text: str, run: int, least_set: int, least_words: int, trees: int = TREES, own: int = OWN) -> DataFrame:
    """``(key, h, n, sig)``: a hash of the set of each record that is large enough, its size and signature."""
    kind = df.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        a, b = _functions(trees * own)
        for batch in batches:
            keys, hs, ns, sigs = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if least_words and len(t.split()) < least_words:
                    continue
                s = words.shingles(t, run)
                if len(s) >= least_set:
                    keys.append(i)
                    hs.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                    ns.append(len(s))
                    sigs.append(signature(s, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(hs, pa.int64()), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary())], names=["key", "h", "n", "sig"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("key").isNotNull() & F.col("t").isNotNull())
    return rows.mapInArrow(sign, f"key {kind}, h bigint, n int, sig binary")


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, m)


def _limit(m: int, similar: float, slack: float = SLACK) -> float:
    """Equal bytes of two signatures of ``m`` values below which a similarity of ``similar`` is out of the question."""
    # of each value a byte will do: others agree in one of 256
    agree = similar + (1 - similar) / 256
    return m * agree - slack * (m * agree * (1 - agree)) ** 0.5


def _short(sets: DataFrame, m: int) -> DataFrame:
    """``(h, s)``: a byte of each value of the signatures."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = (_matrix(b.column("sig"), m) & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "s"])

    return sets.select("h", "sig").mapInArrow(short, "h bigint, s binary")


def block_pairs(ids: np.ndarray, sigs: np.ndarray, other_ids: np.ndarray, other_sigs: np.ndarray, limit: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of two blocks, or of one with itself, whose short signatures have at least ``limit`` equal values."""
    columns, n = np.ascontiguousarray(other_sigs.T), len(other_ids)
    # some rows at a time, so that a step is long enough and its numbers stay in the cache
    for i in range(0, len(ids), 8):
        rows = sigs[i : i + 8]
        at = i + 1 if within else 0
        same, equal = np.zeros((len(rows), n - at), np.uint8), np.empty((len(rows), n - at), bool)
        for c, v in zip(columns, rows.T):
            np.equal(c[None, at:], v[:, None], out=equal)
            same += equal.view(np.uint8)
        r, o = np.nonzero(same >= limit)
        if within:
            later = o + at > r + i
            r, o = r[later], o[later]
        if len(r):
            x, y = ids[i + r], other_ids[at + o]
            yield np.minimum(x, y), np.maximum(x, y)


def _large(members: DataFrame, sets: DataFrame, m: int, limit: float, block: int) -> DataFrame:
    """``(a, b)``: the pairs within large groups ``(route, h, c)`` of ``c`` members that pass the signatures, by pairs of blocks."""
    rows = members.agg(F.sum(F.ceil(F.col("c") / block))).first()[0] or 0
    parts = max(12, min(20_000, rows // 20_000))
    own = members.join(_short(sets, m), "h").withColumn("k", F.ceil(F.col("c") / block).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")).cast("int"))
    spread = own.select("route", "h", "s", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("with"))
    spread = spread.select("route", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "h", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        route, lo, hi, own, h = (t.column(c).to_numpy() for c in ("route", "lo", "hi", "own", "h"))
        sigs = np.frombuffer(b"".join(t.column("s").to_pylist()), np.uint8).reshape(-1, m)
        order = np.lexsort([own, hi, lo, route])
        route, lo, hi, own, h, sigs = route[order], lo[order], hi[order], own[order], h[order], sigs[order]
        new = (route[1:] != route[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        ends = np.concatenate([[0], np.flatnonzero(new) + 1, [len(h)]])
        for i, j in zip(ends[:-1], ends[1:]):
            within = lo[i] == hi[i]
            cut = i if within else i + int(np.searchsorted(own[i:j], hi[i]))
            first = slice(i, j) if within else slice(i, cut)
            a, b, n = [], [], 0
            for x, y in block_pairs(h[first], sigs[first], h[cut:j], sigs[cut:j], limit, within):
                a.append(x), b.append(y)
                n += len(x)
                if n >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return spread.repartition(parts, "route", "lo", "hi").mapInArrow(compare, "a bigint, b bigint")


def candidates(sets: DataFrame, n: int, similar: float, trees: int = TREES, own: int = OWN, window: int = WINDOW, rows: int = TASK_ROWS) -> DataFrame:
    """``(a, b)``, ``a`` < ``b``: the neighbours in the sorted orders of the ``n`` records ``(h, sig)``.

    Their number is at most ``trees * window`` a record. The orders are cut into
    ranges of the sorted rows, so that no prefix, however frequent, is gathered in
    one task; the first and last rows of the ranges are sorted once more, so that
    neighbours are found across their borders.
    """
    m = trees * own

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column("sig"), m)
            for t in range(trees):
                o = order_keys(sig, t, own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array([r.tobytes() for r in o], pa.binary()), b.column("h")], names=["t", "o", "h"])

    width = sum(WIDTHS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(c: int, a: np.ndarray, b: np.ndarray, o: list[bytes] | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), c, np.int32)), pa.array(a), pa.array(b), pa.array(o or [None] * len(a), pa.binary())], names=["c", "a", "b", "o"])

        t, o, h = np.empty(0, np.int64), np.empty((0, width), np.uint8), np.empty(0, np.int64)
        begun = 0
        for b in batches:
            if not b.num_rows:
                continue
            kept = len(h)
            t = np.concatenate([t, b.column("t").to_numpy().astype(np.int64)])
            o = np.concatenate([o, np.frombuffer(b"".join(b.column("o").to_pylist()), np.uint8).reshape(-1, width)])
            h = np.concatenate([h, b.column("h").to_numpy()])
            x, y = neighbour_pairs(t, o, h, similar, window, fresh=kept)
            if len(x):
                both = np.unique(np.stack([x, y], 1), axis=0)
                yield block(0, both[:, 0], both[:, 1])
            if begun < window:  # the first rows of the range
                own_ = slice(kept, kept + window - begun)
                yield block(1, t[own_], h[own_], [r.tobytes() for r in o[own_]])
                begun += len(h[own_])
            t, o, h = t[-window:], o[-window:], h[-window:]
        if len(h):
            yield block(1, t, h, [r.tobytes() for r in o])

    planted = sets.select("h", "sig").mapInArrow(plant, "t int, o binary, h bigint")
    schema = "c int, a bigint, b bigint, o binary"
    parts = max(1, min(n * trees // 4_000, max(12, n * trees // rows)))
    found = written(planted.repartitionByRange(parts, "t", "o", "h").sortWithinPartitions("t", "o", "h").mapInArrow(look, schema), "neighbours")
    inside = found.where("c = 0").select("a", "b")
    # 2 * window rows of each range; the task reads them in order and keeps few of them
    border = found.where("c = 1").select(F.col("a").cast("int").alias("t"), "o", F.col("b").alias("h")).distinct().repartition(1).sortWithinPartitions("t", "o", "h").mapInArrow(look, schema).where("c = 0").select("a", "b")
    return inside.unionByName(border).where("a <> b").distinct()


def estimated(pairs: DataFrame, sets: DataFrame, least: float, trees: int = TREES, own: int = OWN, slack: float = SLACK) -> DataFrame:
    """The candidates whose signatures don't speak against a similarity of ``least``."""
    m = trees * own
    limit = _limit(m, least, slack)
    s = _short(sets, m)
    both = pairs.join(s.withColumnsRenamed({"h": "a", "s": "sa"}), "a").join(s.withColumnsRenamed({"h": "b", "s": "sb"}), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, m) for c in ("sa", "sb"))
                keep = pa.array((x == y).sum(1) >= limit)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(near, "a bigint, b bigint")


def _only(df: DataFrame, key: str, keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``, which are broadcast if they are few and short."""
    size = keys.agg(F.count("*"), F.coalesce(F.max(F.length(F.col("k").cast("string"))), F.lit(0))).first()
    few = F.broadcast(keys) if size[0] <= limit and size[1] <= 64 else keys
    return df.join(few, F.col(key) == F.col("k"), "left_semi")


class Found:
    """Classes of equal records and the similar pairs of classes."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        #: ``(key, h)`` of every record that is large enough, and ``(a, b, similarity)`` of classes.
        self.members, self.pairs = members, pairs


def _checked(df: DataFrame, key: str, text: str, run: int, least: float, signed: DataFrame, close: DataFrame) -> DataFrame:
    """``(a, b, similarity)``: the pairs of ``close`` with a similarity of at least ``least``, by the sets themselves."""
    # one record of each class of which the set is needed
    needed = close.select(F.col("a").alias("k")).union(close.select(F.col("b").alias("k"))).distinct()
    one = written(_only(signed.select("key", "h"), "h", needed).groupBy("h").agg(F.min("key").alias("key")), "needed")
    texts = _only(df.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("t").isNotNull()), "key", one.select(F.col("key").alias("k")).distinct())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            sets_ = [words.shingles(t, run) for t in b.column("t").to_pylist()]
            hs = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets_]
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([s.tobytes() for s in sets_], pa.binary())], names=["h", "s"])

    found = texts.select("t").mapInArrow(collect, "h bigint, s binary").join(one.select("h"), "h", "left_semi").dropDuplicates(["h"])
    both = close.join(found.withColumnsRenamed({"h": "a", "s": "sa"}), "a").join(found.withColumnsRenamed({"h": "b", "s": "sb"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                c = len(np.intersect1d(x, y, assume_unique=True))
                share.append(c / (len(x) + len(y) - c))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(share, pa.float64())], names=["a", "b", "similarity"])

    return written(both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint, similarity double").where(F.col("similarity") >= least), "pairs")


def near_duplicates(df: DataFrame, key: str, text: str, run: int, least: float, least_set: int = 1, least_words: int = 0, trees: int = TREES, window: int = WINDOW, complete: bool = True, block: int = BLOCK) -> Found:
    """Classes of records with the same set, and the pairs of classes with a similarity of at least ``least``.

    A record's set has the distinct runs of ``run`` words (longest runs of letters,
    marks and digits, after NFC and lower-casing); similarity is the share of the
    common elements in all of two. Records with a null key or text, with fewer than
    ``least_set`` elements or ``least_words`` words between white space are left
    out. Equal sets are one class, of which one record is compared; a key with
    several sets is in several classes. Texts are taken whole. The sets' 64-bit
    hashes stand for the sets. An empty table gives no rows; other columns are
    ignored.

    The pairs found are those among the neighbours in the forest's orders, whose
    number grows in proportion to the records; ``complete`` adds all other similar
    pairs within the groups that these form, by comparing the members of each group
    in blocks of ``block``, work that grows with the number of pairs in a group.
    A pair is missed if nothing in its group links its records. README.md has the
    measured recall.
    """
    signed = written(signatures(df, key, text, run, least_set, least_words, trees), "signatures")
    members = signed.select("key", "h").distinct()
    sets = distinct_by(signed.select("h", "sig"), "h")
    n = signed.count()
    close = written(estimated(candidates(sets, n, least, trees, window=window), sets, least, trees), "close")
    pairs = _checked(df, key, text, run, least, signed, close)
    if complete:
        label = labels(pairs)
        large = label.groupBy("l").agg(F.count("*").alias("c")).where("c > 2")
        if not large.isEmpty():
            m = trees * OWN
            grouped = label.join(large, "l").select(F.col("l").alias("route"), F.col("v").alias("h"), "c")
            more = written(_large(grouped, sets, m, _limit(m, least), block).join(close, ["a", "b"], "left_anti"), "rest")
            if not more.isEmpty():
                pairs = pairs.unionByName(_checked(df, key, text, run, least, signed, more))
    return Found(members, pairs)


def _all_pairs(m: DataFrame, links: DataFrame, part: int) -> DataFrame:
    """``(x, y)``: all keys of ``a`` with all of ``b`` for the classes ``(a, b)`` of ``links``; large classes are joined by parts."""
    large = m.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > part).withColumn("k", F.ceil(F.col("c") / part).cast("int")).select("h", "k")
    # of large classes each key has a part; a pair of classes is written out for each pair of parts
    keys = m.join(large, "h", "left").select("h", "key", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("key"), F.col("k"))).cast("int").alias("p"))
    for c in ("a", "b"):
        links = links.join(large.withColumnsRenamed({"h": c, "k": f"k{c}"}), c, "left")
        links = links.withColumn(f"p{c}", F.explode(F.sequence(F.lit(0), F.coalesce(f"k{c}", F.lit(1)) - 1)))
    left = links.select("a", "b", "pa", "pb").join(keys.withColumnsRenamed({"h": "a", "key": "x", "p": "pa"}), ["a", "pa"])
    return left.join(keys.withColumnsRenamed({"h": "b", "key": "y", "p": "pb"}), ["b", "pb"]).select("x", "y")


def record_pairs(found: Found, class_limit: int | None = None, part: int = CLASS) -> DataFrame:
    """``(key_a, key_b)``, ``key_a`` < ``key_b``: the similar pairs of records with different keys.

    All pairs are written, of classes of any size; keys of classes over ``part``
    are joined part by part. ``groups`` has the classes without their pairs. With
    a ``class_limit``, each record of a class over it is paired with the least key
    only, and across classes the least key stands for a class over it.
    """
    m = written(found.members, "members")
    star = None
    if class_limit is not None:
        large = m.groupBy("h").agg(F.count("*").alias("c"), F.min("key").alias("least")).where(F.col("c") > class_limit)
        star = m.join(large.select("h", "least"), "h").select(F.col("least").alias("x"), F.col("key").alias("y"))
        m = m.join(large.select("h"), "h", "left_anti").select("h", "key").unionByName(large.select("h", F.col("least").alias("key")))
    shared = m.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("a"), F.col("h").alias("b"))
    rows = _all_pairs(m, shared.unionByName(found.pairs.select("a", "b")), part)
    rows = rows.unionByName(star) if star is not None else rows
    return rows.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def labels(pairs: DataFrame) -> DataFrame:
    """``(v, l)``: the least class connected with each class that is in a pair.

    Labels go from neighbour to neighbour, and to the label's label, until none
    changes: every round but the last lowers one, and a chain of any length takes
    about the logarithm of its length.
    """
    edges = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = written(edges.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v")), "labels")
    while True:
        near = edges.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, F.col("v") == F.col("a")).select("v", "l", F.least("l", "m").alias("m"))
        jump = step.join(label.select(F.col("v").alias("w"), F.col("l").alias("ll")), F.col("m") == F.col("w"))
        after = written(jump.select("v", F.least("m", "ll").alias("l"), (F.least("m", "ll") != F.col("l")).alias("changed")), "labels")
        label = after.select("v", "l")
        if after.where("changed").isEmpty():
            return label


def groups(found: Found) -> DataFrame:
    """``(key, class_id, group_id, links)``: one row for each record and class.

    ``group_id`` is the least class that is connected with the record's by similar
    pairs, ``links`` the number of other classes it was found to be similar to.
    """
    label = labels(found.pairs)
    both = found.pairs.select("a").union(found.pairs.select(F.col("b").alias("a")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    rows = found.members.join(label, F.col("h") == F.col("v"), "left").join(degree, F.col("h") == F.col("a"), "left")
    return rows.select("key", F.col("h").alias("class_id"), F.coalesce("l", "h").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
