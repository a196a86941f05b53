"""The most similar vectors of every vector: probed lists scanned by adaptive dimensions.

Vectors are scaled to length 1, rotated at random and assigned to the list of
their nearest centroid. A vector is compared with the members of the lists it
probes, a column block after the other; after each block a hypothesis test on the
partial distance gives up the candidates that can hardly be among the k nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sharedfs import written
from ..operators.distinct import distinct_by

K, DIMENSIONS = 5, 96
#: Vectors of a list on average, and vectors a list on which centroids are fitted (in all at least SAMPLE, where there are so many).
LIST_SIZE, PER_LIST, SAMPLE = 4_000, 12, 20_000
#: Centroids that are fitted and broadcast at most; more vectors make longer lists, which their tasks divide once more.
CENTROIDS = 1 << 16
#: A vector probes the lists whose centroids are at most this much less similar than the nearest one, and at most so many.
GAP, PROBES = 0.2, 8
#: Columns of a block, and how many deviations a partial distance must be beyond the threshold.
BLOCK, SIGMA = 32, 3.0
#: Candidates of a query up to which they are followed one by one.
MANY = 24
#: Members of a list that one task compares; longer lists are split into parts of so many.
PART = 200_000
#: Pairs of vectors whose partial distances are in memory at a time.
PAIRS = 500_000
#: Largest error of a cosine by rounded values and sums.
ERROR = 1e-5


def usable(vector: np.ndarray | None, d: int) -> bool:
    return vector is not None and len(vector) == d and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at, first = np.unique(near[order], return_index=True)
        c[at] = np.add.reduceat(x[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


class Centroids:
    """The lists' centroids; many are searched by groups of near ones, whose centroids are a second level."""

    def __init__(self, points: np.ndarray, lists: int, flat: int = 1024):
        self.top = None
        if lists <= flat:
            self.c = fit_centroids(points, lists)
            return
        groups = math.ceil(lists**0.5)
        self.top = fit_centroids(points, groups)
        near = np.concatenate([(points[i : i + 4096] @ self.top.T).argmax(1) for i in range(0, len(points), 4096)])
        parts = [fit_centroids(points[near == g], max(1, round(lists * (near == g).mean())), seed=g) for g in range(groups) if (near == g).any()]
        self.top = self.top[[g for g in range(groups) if (near == g).any()]]
        self.c = np.concatenate(parts)
        self.first = np.cumsum([0, *map(len, parts)])

    def __len__(self) -> int:
        return len(self.c)

    def nearest(self, x: np.ndarray, most: int = PROBES, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
        """For each row the numbers of the nearest lists, in order, and how many of them it probes."""
        m = min(most, len(self.c))
        if self.top is None:
            same = x @ self.c.T
            near = np.argpartition(-same, m - 1, 1)[:, :m]
        else:
            groups = np.argsort(-(x @ self.top.T), 1)[:, : 2 * most]
            near, best = np.zeros((len(x), m), np.int64), np.full((len(x), m), -2, np.float32)
            for g in np.unique(groups):
                rows = np.flatnonzero((groups == g).any(1))
                found = x[rows] @ self.c[self.first[g] : self.first[g + 1]].T
                both = np.concatenate([best[rows], found], 1)
                number = np.concatenate([near[rows], np.broadcast_to(np.arange(self.first[g], self.first[g + 1]), found.shape)], 1)
                keep = np.argpartition(-both, m - 1, 1)[:, :m]
                best[rows], near[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(number, keep, 1)
        like = np.einsum("ij,ikj->ik", x, self.c[near]) if len(x) else np.empty((0, m))
        order = np.argsort(-like, 1, kind="stable")
        near, like = np.take_along_axis(near, order, 1), np.take_along_axis(like, order, 1)
        return near.astype(np.int32), (like >= like[:, :1] - gap).sum(1)


def scan(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, block: int = BLOCK, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to ``k`` nearest members of each query: numbers of queries and members, and squared distances.

    Squared distances over the first columns of randomly rotated vectors, scaled up
    by the number of columns, deviate from the whole by about ``sqrt(2 / columns)``
    of it; a candidate beyond the threshold by ``sigma`` of these is given up. The
    threshold is the ``k``-th whole distance of those that look nearest at first.
    """
    d, n = members.shape[1], len(members)
    rows_q, rows_m, dist = [], [], []
    step, wide = max(1, PAIRS // max(1, n)), 16
    blocks = [slice(c, min(d, c + block)) for c in range(0, d, block)]
    m2 = [(members[:, c] ** 2).sum(1)[None] for c in blocks]
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]

        def block_of(b: int) -> np.ndarray:
            c = blocks[b]
            x = q[:, c] @ members[:, c].T
            x *= -2
            x += m2[b]
            x += (q[:, c] ** 2).sum(1)[:, None]
            return x

        def bound() -> np.ndarray | None:
            """Of each few members the least partial distance: the ``k + 1`` least of these bound as many."""
            return np.partition(part[:, : n // wide * wide].reshape(len(q), wide, -1).min(1), k, axis=1)[:, k] if n // wide > k + 1 else None

        def near(done: int) -> np.ndarray:
            beyond = limit * (1 + sigma * math.sqrt(2 / done)) * (done / d)
            if done == d:  # these are whole distances
                beyond = limit if (x := bound()) is None else np.minimum(limit, x)
            return np.flatnonzero((part <= beyond[:, None]).ravel())

        part = block_of(0)
        limit = np.full(len(q), np.inf, np.float32)
        if (least := bound()) is not None:
            i, j = divmod(np.flatnonzero((part <= least[:, None]).ravel()), n)
            whole = ((q[i] - members[j]) ** 2).sum(1)
            whole[ids[j] == own[lo + i]] = np.inf
            order = np.lexsort((whole, i))
            at = np.searchsorted(i, np.arange(len(q)), "left") + k - 1
            limit = whole[order][at] * 1.00001 + 2e-6  # sums in another order differ a little
        b, at = 1, near(blocks[0].stop)
        # while many are left, whole blocks of columns are cheaper than those of single candidates
        while b < len(blocks) and len(at) > MANY * len(q):
            part += block_of(b)
            at = near(blocks[b].stop)
            b += 1
        i, j = divmod(at, n)
        so_far = part.ravel()[at]
        while b < len(blocks) and len(i):
            so_far = so_far + ((q[:, blocks[b]][i] - members[:, blocks[b]][j]) ** 2).sum(1)
            done = blocks[b].stop
            keep = so_far <= limit[i] if done == d else so_far * (d / done) <= limit[i] * (1 + sigma * math.sqrt(2 / done))
            i, j, so_far = i[keep], j[keep], so_far[keep]
            b += 1
        real = ids[j] != own[lo + i]
        rows_q.append(lo + i[real]), rows_m.append(j[real]), dist.append(so_far[real])
    i, j, s = np.concatenate(rows_q), np.concatenate(rows_m), np.maximum(np.concatenate(dist), 0)
    return _least(i, j, s, ids, k)


def _least(i: np.ndarray, j: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` least distances of each query, ties by the member's id."""
    order = np.lexsort((ids[j], s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], j[keep], s[keep]


def scan_list(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, size: int = LIST_SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`scan`; a list of more than two times ``size`` members is divided by centroids of its own, which are probed in turn."""
    if len(members) <= 2 * size:
        return scan(queries, members, ids, own, k)
    lists = -(-len(members) // size)
    pick = np.random.default_rng(7).permutation(len(members))[: max(4_000, PER_LIST * lists)]
    inner = Centroids(members[pick], lists)
    at = np.concatenate([inner.nearest(members[i : i + 8192], 1)[0][:, 0] for i in range(0, len(members), 8192)])
    near, count = inner.nearest(queries)
    found = []
    for c in range(len(inner)):
        m = np.flatnonzero(at == c)
        r = np.flatnonzero(((near == c) & (np.arange(near.shape[1]) < count[:, None])).any(1))
        if len(m) and len(r):
            i, j, s = scan(queries[r], members[m], ids[m], own[r], k)
            found.append((r[i], m[j], s))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    return _least(*(np.concatenate(x) for x in zip(*found)), ids, k)


def packed(x: np.ndarray) -> np.ndarray:
    """24-bit values, as precise as the sums that are made of them, and a scale for each row, as bytes."""
    scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32)
    values = np.rint(x.astype(np.float64) / scale[:, None] * 8388607).astype("<i4")
    return np.concatenate([scale[:, None].view(np.uint8), values.view(np.uint8).reshape(*x.shape, 4)[:, :, :3].reshape(len(x), -1)], 1)


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 + 3 * d)
    wide = np.zeros((len(raw), d, 4), np.uint8)
    wide[:, :, 1:] = raw[:, 4:].reshape(-1, d, 3)
    return (wide.view("<i4")[:, :, 0] >> 8).astype(np.float32) * (np.ascontiguousarray(raw[:, :4]).view(np.float32) / np.float32(8388607))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, d)


def usable_rows(df: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """``(id, v)``: one row for each key with a vector of ``d`` numbers, none null, NaN or infinite, not all zero."""
    v = F.col(vector).cast("array<float>")
    whole = df.where(F.col(key).isNotNull() & (F.size(v) == d) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    return distinct_by(whole.select(F.col(key).alias("id"), v.alias("v")), "id")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", d: int = DIMENSIONS, k: int = K, list_size: int = LIST_SIZE, most: int = PROBES, gap: float = GAP, part: int = PART) -> DataFrame:
    """``(<key>, neighbour, cosine, rank)``: the ``k`` most similar other vectors of every usable vector.

    Usable are vectors of ``d`` numbers, none null, NaN or infinite, not all zero;
    others have no rows, nor are they found. Rows that repeat a key are taken as
    repeats of one row. Equal vectors with different keys are neighbours of each
    other with cosine 1; ties go to the smaller key. The centroids are fitted on a
    bounded sample (those with the least hashes of their keys), but every vector is
    in a list and every vector is a query. A vector is sent, as 24-bit values, to
    its own list and to at most ``most - 1`` others, whatever the number of
    vectors; a list of more than ``part`` members is scanned in parts by several
    tasks. With fewer than ``k`` others, all of them come out. The result is
    approximate: neighbours in lists that aren't probed are missed, and cosines are
    off by less than ERROR.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    clean = usable_rows(df, key, vector, d)
    turn = rotation(d)

    def rotated(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("v"), d).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn).astype(np.float32)

    schema = f"`{key}` {kind}, neighbour {kind}, cosine double, rank int"
    n = clean.count()
    if not n:
        return spark.createDataFrame([], schema)
    lists = min(CENTROIDS, max(1, n // list_size))
    sample = max(SAMPLE, PER_LIST * lists)
    bound = min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, sample / n)))
    points = [rotated(b) for b in clean.where(F.xxhash64("id") <= bound).select("v").limit(2 * sample).toArrow().to_batches() if b.num_rows]
    points = np.concatenate(points) if points else np.eye(1, d, dtype=np.float32)
    shared = spark.sparkContext.broadcast(Centroids(points, min(lists, len(points))))  # at most CENTROIDS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = rotated(b)
                near, count = shared.value.nearest(x, most, gap)
                lists_ = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(near[np.arange(near.shape[1]) < count[:, None]]))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in packed(x)], pa.binary()), lists_], names=["id", "x", "lists"])

    assigned = written(clean.mapInArrow(assign, f"id {kind}, x binary, lists array<int>"), "lists")
    # of equal vectors only the k + 1 least keys can be anybody's neighbours
    alike = F.xxhash64("x", F.hash("x"))
    copies = assigned.groupBy(alike.alias("h")).count().where(F.col("count") > k + 1)
    surplus = None
    if not copies.isEmpty():
        w = Window.partitionBy("h").orderBy("id")
        # Spark keeps the first rows of each group before the shuffle, so that none is large after it
        kept = written(assigned.withColumn("h", alike).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1), "kept")
        least = kept.where(F.col("r") <= k).groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("near"))
        surplus = assigned.select("id", alike.alias("h")).join(kept.select("id"), "id", "left_anti").join(least, "h").select(F.col("id").alias(key), F.posexplode("near").alias("rank", "neighbour"))
        surplus = surplus.select(key, "neighbour", F.lit(1.0).alias("cosine"), (F.col("rank") + 1).alias("rank"))
        assigned = kept.select("id", "x", "lists")
    sizes = assigned.groupBy(F.get("lists", F.lit(0)).alias("l")).count().collect()  # one row a list
    # the parts of all lists are numbered one after another
    table, units = [], 0
    for l, c in sorted((r[0], r[1]) for r in sizes):
        parts = -(-c // part)
        table.append((l, units, parts))
        units += parts
    where = F.broadcast(spark.createDataFrame(table, "l int, first int, parts int"))
    # members go to one part of their list, queries to all parts of the lists they probe; lists without members are left out
    sent = assigned.select("id", "x", F.posexplode("lists").alias("r", "l")).join(where, "l").select("id", "x", "r", "first", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    sent = sent.select((F.col("first") + F.col("p")).alias("u"), ((F.col("r") == 0) & (F.col("p") == F.col("mine"))).alias("member"), "id", "x")
    work = sent.repartitionById(units, "u").sortWithinPartitions("u", F.desc("member"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(held: list, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            names, mat = held
            i, j, s = scan_list(x, mat, names, ids, k, list_size)
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(names[j]), pa.array((1 - s / 2).astype(np.float32))], names=["id", "neighbour", "cosine"])

        def lists_(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    u = b.column("u").to_numpy()
                    member, ids, x = b.column("member").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False), unpacked(b.column("x"), d)
                    edges = np.flatnonzero(np.diff(u)) + 1
                    for lo, hi in zip([0, *edges], [*edges, len(u)]):
                        yield u[lo], member[lo:hi], ids[lo:hi], x[lo:hi]

        at, held, waiting = None, [], []

        def all_() -> Iterator[pa.RecordBatch]:
            if waiting and held:
                yield ask([np.concatenate([a for a, _ in held]), np.concatenate([m for _, m in held])], np.concatenate([a for a, _ in waiting]), np.concatenate([m for _, m in waiting]))

        for u, member, ids, x in lists_(batches):
            if u != at:
                yield from all_()
                at, held, waiting = u, [], []
            if member.any():
                held.append((ids[member], x[member]))
            waiting.append((ids, x))
            if not member.any() and sum(len(a) for a, _ in waiting) >= 100_000:  # the members have all been read
                yield from all_()
                waiting = []
        yield from all_()

    found = work.mapInArrow(compare, f"id {kind}, neighbour {kind}, cosine float")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", F.col("cosine").cast("double").alias("cosine"), "rank")
    return ranked if surplus is None else ranked.unionByName(surplus)


def similar_pairs(neighbours: DataFrame, key: str = "vec_id", least: float = 0.85, vectors: DataFrame | None = None, vector: str = "embedding", d: int = DIMENSIONS, limit: int = 200_000) -> DataFrame:
    """``(vec_a, vec_b)``, ``vec_a`` the smaller: pairs of which either is among the neighbours of the other, with at least this cosine.

    With ``vectors``, the table that ``neighbours`` was made from, the cosines of
    pairs within ERROR of ``least`` are computed once more from the vectors; up to
    ``limit`` such pairs are broadcast.
    """
    pair = [F.least(key, "neighbour").alias("vec_a"), F.greatest(key, "neighbour").alias("vec_b")]
    if vectors is None:
        return neighbours.where(F.col("cosine") >= least).select(*pair).distinct()
    both = written(neighbours.where(F.col("cosine") >= least - ERROR).select(*pair, (F.col("cosine") < least + ERROR).alias("open")).groupBy("vec_a", "vec_b").agg(F.max("open").alias("open")), "close")
    doubt = both.where("open").select("vec_a", "vec_b")
    doubt = F.broadcast(doubt) if doubt.count() <= limit else doubt
    v = usable_rows(vectors, key, vector, d)

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    half = v.join(doubt, v["id"] == doubt["vec_a"]).select("vec_a", "vec_b", F.col("v").alias("va"))
    half = F.broadcast(half) if doubt.count() <= limit // 20 else half
    sure = v.join(half, v["id"] == half["vec_b"]).where(dot("va", "v") >= least * F.sqrt(dot("va", "va")) * F.sqrt(dot("v", "v"))).select("vec_a", "vec_b")
    return both.where(~F.col("open")).select("vec_a", "vec_b").unionByName(sure)
