"""Exact top-k inner products by branch and bound over one ball tree per shard.

Rows are sharded by their nearest pivot, and each shard's tree is built and written once. A
ball with centre c and radius r bounds the product with q by <q, c> + |q| r. Queries visit
shards in waves, best bound first, and in a shard its leaves by falling bound; after each
wave a query's k-th score over all shards seen so far goes with it, and whatever is bounded
under that score is left out: shards before they are sent, nodes in the tree.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_path, map_arrow, written


class BallTree:
    """Balls over the rows of ``points``; leaves of at most ``leaf`` rows."""

    def __init__(self, points: np.ndarray, leaf: int = 64) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.start, self.end, self.child, centres, radii = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.start)
            rows = points[self.order[a:b]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            self.start.append(a)
            self.end.append(b)
            self.child.append([])
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            if parent >= 0:
                self.child[parent].append(node)
            if b - a > leaf:
                one = rows[away.argmax()]
                far = ((rows - one) ** 2).sum(axis=1)
                axis = rows @ (rows[far.argmax()] - one)
                middle = (b - a) // 2
                part = np.argpartition(axis, middle)
                self.order[a:b] = self.order[a:b][part]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaves = np.array([i for i, c in enumerate(self.child) if not c])

    def pack(self, ids: np.ndarray) -> bytes:
        """The tree and the ids of its rows, without pickled objects; single precision where that is exact."""
        small = self.points.astype(np.float32)
        points = small if (small == self.points).all() else self.points
        child = np.array([c or [-1, -1] for c in self.child], np.int32).reshape(-1, 2)
        out = io.BytesIO()
        np.savez(out, points=points, ids=ids, order=self.order, start=self.start, end=self.end, child=child, centres=self.centres, radii=self.radii)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[BallTree, np.ndarray]:
        """What :meth:`pack` packed: the tree, and the ids of its rows."""
        z, tree = np.load(io.BytesIO(data), allow_pickle=False), cls.__new__(cls)
        tree.points, tree.order = z["points"].astype(np.float64), z["order"]
        tree.start, tree.end, tree.centres, tree.radii = z["start"], z["end"], z["centres"], z["radii"]
        tree.child = [c.tolist() if c[0] >= 0 else [] for c in z["child"]]
        tree.leaves = np.flatnonzero(z["child"][:, 0] < 0)
        return tree, z["ids"]

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the products, [query, node], with room for rounding."""
        norms = np.sqrt((queries**2).sum(axis=1))
        scale = norms[:, None] * (np.sqrt((self.centres[nodes] ** 2).sum(axis=1)) + self.radii[nodes])[None]
        return queries @ self.centres[nodes].T + norms[:, None] * self.radii[nodes][None] + 1e-9 * scale + 1e-9

    def reached(self, queries: np.ndarray, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(leaf, rows of queries whose floor doesn't exclude it), by descent from the root."""
        out, todo = [], [(0, np.arange(len(queries)))]
        while todo:
            node, rows = todo.pop()
            ub = self.bounds(queries[rows], np.array([node]))[:, 0]
            rows, ub = rows[ub >= floor[rows]], ub[ub >= floor[rows]]
            if len(rows) and self.child[node]:
                todo += [(c, rows) for c in self.child[node]]
            elif len(rows):
                out.append((np.array([node]), rows, ub))
        return out


def _merge(best: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int):
    """The k best of two sets of scores per row, ties to smaller ids."""
    s, i = np.concatenate([best, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    if s.shape[1] > 4 * k:  # leave out what is under the k-th score, ties kept by widening
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        wide = int((s >= kth[:, None]).sum(axis=1).max())
        part = np.argpartition(-s, min(wide, s.shape[1] - 1), axis=1)[:, :wide] if wide < s.shape[1] else None
        if part is not None:
            s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


_NONE = np.iinfo(np.int64).max


def search(
    tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids [query, k] of the best rows but the query's own; -inf where there are fewer.

    Leaves are taken in rounds, best bound first; between rounds the k-th scores rise and
    exclude further leaves.
    """
    n = len(queries)
    best, got = np.full((n, k), -np.inf), np.full((n, k), _NONE)
    parts = tree.reached(queries, floor)
    if not parts:
        return best, got
    q = np.concatenate([rows for _, rows, _ in parts])
    leaf = np.concatenate([np.full(len(rows), node[0]) for node, rows, _ in parts])
    bound = np.concatenate([ub for _, _, ub in parts])
    order = np.lexsort((-bound, q))
    q, leaf, bound = q[order], leaf[order], bound[order]
    first = np.concatenate([[True], q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    done, width = 0, 1
    while True:
        kth = np.maximum(best[:, k - 1], floor)
        take = (place >= done) & (place < done + width) & (bound >= kth[q])
        live = (place >= done + width) & (bound >= kth[q])
        if take.any():
            order = np.argsort(leaf[take], kind="stable")
            tq, tl = q[take][order], leaf[take][order]
            cut = np.flatnonzero(np.diff(tl)) + 1
            found_q, found_s, found_i = [], [], []
            for rows, node in zip(np.split(tq, cut), tl[np.concatenate([[0], cut])]):
                members = tree.order[tree.start[node] : tree.end[node]]
                s = queries[rows] @ tree.points[members].T
                s[own[rows][:, None] == ids[members][None]] = -np.inf
                found_q.append(np.repeat(rows, len(members)))
                found_s.append(s.ravel())
                found_i.append(np.tile(ids[members], len(rows)))
            fq, fs, fi = np.concatenate(found_q), np.concatenate(found_s), np.concatenate(found_i)
            ok = (fs >= kth[fq]) & (fs > -np.inf)
            fq, fs, fi = fq[ok], fs[ok], fi[ok]
            order = np.lexsort((fi, -fs, fq))
            fq, fs, fi = fq[order], fs[order], fi[order]
            if len(fq):
                start = np.flatnonzero(np.concatenate([[True], fq[1:] != fq[:-1]]))
                rank = np.arange(len(fq)) - np.repeat(start, np.diff(np.append(start, len(fq))))
                top = rank < k
                more, more_ids = np.full((n, k), -np.inf), np.full((n, k), _NONE)
                more[fq[top], rank[top]], more_ids[fq[top], rank[top]] = fs[top], fi[top]
                best, got = _merge(best, got, more, more_ids, k)
        if not live.any():
            return best, got
        done, width = done + width, width * 2


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _shards(cand: DataFrame, k: int, shard_rows: int, max_pivots: int, keep: list[str]) -> DataFrame:
    """(shard, vec_id, v): rows near one pivot, in shards of about ``shard_rows``, however many rows a pivot has.

    Of rows with one vector only the ``k + 1`` least ids can be among the best (one may be the
    query's own), and of rows that repeat an id only ``k``; the rest leaves before the shuffle.
    """
    spark = cand.sparkSession
    same = Window.partitionBy("key", "v")
    cand = cand.withColumn("key", F.xxhash64("v"))
    cand = cand.withColumn("nth", F.row_number().over(Window.partitionBy("key", "v", "vec_id").orderBy("vec_id"))).where(F.col("nth") <= k)
    cand = cand.withColumn("nth", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    cand = written(cand.withColumn("at", F.monotonically_increasing_id()), keep)
    n = cand.count()
    many = max(1, min(max_pivots, -(-n // shard_rows)))
    share = max(1, n // (8 * many))
    drawn = cand.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(share)) == 0).orderBy(F.xxhash64("key", F.lit(11)), "at").limit(many)
    pivots: dict[int, list[np.ndarray]] = {}
    for r in drawn.select("v").toLocalIterator():  # at most max_pivots
        pivots.setdefault(len(r[0]), []).append(np.array(r[0], float))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            out = np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                if len(own := pivots.get(d, [])) > 1:
                    rows, p = np.flatnonzero(dims == d), np.array(own)
                    x = _matrix(b.column(1).take(pa.array(rows)), d)
                    out[rows] = ((p**2).sum(axis=1)[None] - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims.astype(np.int32)), pa.array(out)], names=["vec_id", "v", "at", "d", "pivot"])

    near = map_arrow(cand.select("vec_id", "v", "at"), nearest, "vec_id long, v array<double>, at long, d int, pivot int")
    near = written(near, keep)
    tally = sorted((r["d"], r["pivot"], r["count"]) for r in near.groupBy("d", "pivot").count().toLocalIterator())  # a row a pivot and dimension
    base, parts = 0, []
    for d, p, c in tally:
        parts.append((d, p, base, -(-c // shard_rows)))
        base += parts[-1][3]
    numbers = F.broadcast(spark.createDataFrame(parts, "d int, pivot int, base int, parts int"))
    shard = (F.col("base") + F.pmod(F.xxhash64("at"), F.col("parts"))).cast("int")
    return near.join(numbers, ["d", "pivot"]).select(shard.alias("shard"), "vec_id", "v")


_TREES = "shard int, d int, centre array<double>, radius double, tree binary"


def build_trees(shards: DataFrame, leaf: int) -> DataFrame:
    """(shard, d, centre, radius, tree): a packed ball tree of each shard, and its root ball."""

    def run(t: pa.Table) -> pa.Table:
        d = len(t["v"][0])
        tree = BallTree(_matrix(t["v"].combine_chunks(), d), leaf)
        row = {"shard": t["shard"][0].as_py(), "d": d, "centre": tree.centres[0].tolist(), "radius": float(tree.radii[0])}
        kinds = pa.schema([("shard", pa.int32()), ("d", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tree", pa.binary())])
        return pa.Table.from_pylist([row | {"tree": tree.pack(t["vec_id"].to_numpy())}], kinds)

    return shards.groupBy("shard").applyInArrow(run, _TREES)


_ASKED = "shard int, vec_id long, key long, v array<double>, floor double"


def _route(asked: DataFrame, roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], bounded: bool, first: int, last: int) -> DataFrame:
    """(shard, query) rows: each query's ``first`` to ``last`` shards by falling bound, less those bounded under its k-th score.

    ``roots``: (shards, centres, radii) by dimension. Without ``bounded`` shards come by number.
    """
    shared = asked.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for d in set(dims.tolist()) & set(shared.value):
                number, centres, radii = shared.value[d]
                rows = np.flatnonzero(dims == d)
                step = max(1, min(4_000_000 // len(number), 65_536 // max(1, min(last, len(number)) - first)))
                for at in range(0, len(rows), step):
                    own = rows[at : at + step]
                    floor = b.column(3).to_numpy()[own]
                    if bounded:
                        q = _matrix(b.column(2).take(pa.array(own)), d)
                        norm = np.sqrt((q**2).sum(axis=1))[:, None]
                        near = norm * (np.sqrt((centres**2).sum(axis=1)) + radii)[None]
                        ub = q @ centres.T + norm * radii[None] + 1e-9 * near + 1e-9
                        order = np.argsort(-ub, axis=1, kind="stable")[:, first:last]
                        i, j = np.nonzero(np.take_along_axis(ub, order, 1) >= floor[:, None])
                        shard = number[order[i, j]]
                    else:
                        some = number[first:last]
                        i, shard = np.repeat(np.arange(len(own)), len(some)), np.tile(some, len(own))
                    if len(i):
                        at_row = pa.array(own[i])
                        cols = [pa.array(shard.astype(np.int32)), *(b.column(c).take(at_row) for c in range(4))]
                        yield pa.RecordBatch.from_arrays(cols, names=["shard", "vec_id", "key", "v", "floor"])

    return map_arrow(asked.select("vec_id", "key", "v", "floor"), run, _ASKED)


def _searched(trees: DataFrame, routed: DataFrame, k: int, partitions: int) -> DataFrame:
    """(query_id, key, vec_id, score): the k best rows of each shard for each query sent to it.

    A shard's tree comes first in its task and the queries stream past it, so that a task
    holds a tree and a batch of queries, however many those are.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("key", "long"), ("v", "array<double>"), ("floor", "double"))]
    rows = trees.select("shard", *none, "tree").unionByName(routed.withColumn("tree", F.lit(None).cast("binary")))
    rows = rows.repartition(partitions, "shard").sortWithinPartitions("shard", F.col("tree").isNull())
    names = ["query_id", "key", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, ids = None, None, None
        for b in batches:
            shard = b.column(0).to_numpy()
            packed = np.flatnonzero(b.column(5).is_valid().to_numpy(zero_copy_only=False))
            cuts = np.unique(np.concatenate([[0], packed, packed + 1, np.flatnonzero(np.diff(shard)) + 1, [b.num_rows]])).astype(int)
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b.column(5)[a].is_valid:
                    held, tree = b.column(5)[a].as_py(), None
                    continue
                if tree is None:
                    (tree, ids), held = BallTree.load(held), None
                for at in range(a, e, 2048):
                    q = b.slice(at, min(2048, e - at))
                    own, ask = q.column(1).to_numpy(), _matrix(q.column(3), tree.points.shape[1])
                    scores, got = search(tree, ids, ask, own, q.column(4).to_numpy(), k)
                    row, col = np.nonzero(scores > -np.inf)
                    cols = [own[row], q.column(2).to_numpy()[row], got[row, col], scores[row, col].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return map_arrow(rows, run, "query_id long, key long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_rows: int = 16_384,
    pass_rows: int = 1_000_000,
    max_pivots: int = 1_024,
    max_roots: int = 16_384,
    leaf: int = 64,
) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product for every row of ``queries``.

    Both tables have vec_id (long) and v (array<double>), whose components are integers.
    Returns query_id, rank (from 1), vec_id and score, ties to the smaller vec_id; fewer
    than k rows where there are fewer candidates. A row with the query's own id is no
    candidate. A query that repeats (same id and vector) is answered once. Vectors that are
    null or hold null or non-finite components take no part; vectors of different lengths
    aren't compared; empty vectors all score 0. Of rows that repeat an id, each counts as a
    candidate. Scores are exact while sums of products stay under 2**53. Other columns are
    ignored; an empty table of either kind gives no rows.

    Shards hold about ``shard_rows`` rows near one of at most ``max_pivots`` drawn pivots;
    trees are built once and written. A query meets its best-bounded shard, then the next
    three, twelve and so on; between such waves its k-th score is taken over all shards seen.
    The root balls are broadcast while there are at most ``max_roots`` shards; beyond, shards
    come by number and are judged in their tasks. Queries pass in parts of about
    ``pass_rows``. Any sharding and order gives the same rows.
    """
    spark = vectors.sparkSession
    keep: list[str] = []

    def valid(df: DataFrame) -> DataFrame:
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(
            F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine
        )

    asked = written(valid(queries).dropDuplicates().withColumn("key", F.xxhash64("v")), keep)
    trees = written(build_trees(_shards(valid(vectors), k, shard_rows, max_pivots, keep), leaf), keep)
    shards = trees.count()
    bounded = shards <= max_roots
    roots: dict[int, tuple[np.ndarray, ...]] = {}
    for d, group in _by_dimension(trees, bounded).items():
        roots[d] = (np.array([g[0] for g in group]), np.array([g[1] for g in group], float).reshape(len(group), -1), np.array([g[2] for g in group]))
    most = max((len(r[0]) for r in roots.values()), default=0)
    passes = max(1, -(-asked.count() // pass_rows))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    out: list[DataFrame] = []
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(passes)) == p)
        tops: DataFrame | None = None
        first, last = 0, 1
        while first < most:
            if tops is None:
                now = some.withColumn("floor", F.lit(float("-inf")))
            else:
                kth = tops.groupBy("query_id", "key").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k)
                kth = kth.select(F.col("query_id").alias("vec_id"), "key", F.col("s").cast("double").alias("floor"))
                now = some.join(kth, ["vec_id", "key"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
            found = _searched(trees.select("shard", "tree"), _route(now, roots, bounded, first, last), k, shards)
            if tops is not None:
                found = found.unionByName(tops)
            found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            before, tops = tops, written(found.select("query_id", "key", "vec_id", "score"), keep)
            if before is not None:
                drop_path(spark, keep.pop(-2))
            first, last = last, 4 * last
        if tops is not None:
            out.append(tops)
    if not out:
        for path in keep:
            drop_path(spark, path)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = out[0]
    for t in out[1:]:
        result = result.unionByName(t)
    for path in keep[:-len(out)]:
        drop_path(spark, path)
    return result.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def _by_dimension(trees: DataFrame, bounded: bool) -> dict[int, list[tuple]]:
    """(shard, centre, radius) of the root balls by dimension, in the order of shards; without balls unless ``bounded``."""
    out: dict[int, list[tuple]] = {}
    cols = ["shard", "d"] + (["centre", "radius"] if bounded else [])
    for r in trees.select(*cols).toLocalIterator():
        out.setdefault(r["d"], []).append((r["shard"], list(r["centre"]) if bounded else [], r["radius"] if bounded else 0.0))
    return {d: sorted(rows, key=lambda x: x[0]) for d, rows in out.items()}
