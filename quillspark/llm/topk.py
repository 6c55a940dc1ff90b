"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Vectors are dealt into blocks of bounded size (``shard_rows`` vectors), queries
into blocks of ``query_rows``; a task holds one vector block and one query block.
Each block is cut into a ball tree; a node's inner products with ``q`` are at most
``q.c + |q| r``.  A query block walks the tree depth first, every query into the
child of larger bound first; a query leaves a branch when its bound is below the
query's current k-th score.

That score is shared between shards.  Shards are groups of near vectors (nearest
of ``n_centers`` centres, taken from a bounded sample), each with its own ball.
In a first round every query searches its shard of largest bound; the k-th score
it finds goes along to the second round, for which only the shards are kept whose
bound reaches it.  A shard is sent to the query blocks that want it and to no others.
The number of centres grows with the table up to ``max_centers``; beyond that (2 M vectors by default) a
centre's shards share one ball, so that fewer of them can be left out.  The result is exact either way.

Defined results: rows without an id, and vectors that are null, empty or hold
null, NaN or infinite components, take no part; query and candidate must have the same number of
components; ties go to the smaller id; equal rows of one id count once for each
row; a query with no candidate gives no row.  Scores, also those that prune, are exact
integers; one beyond 64 bits is returned as the nearest 64-bit value.  Ids are whole
numbers (others raise Spark's cast error); other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

FOUND_DDL = "query_id long, vec_id long, score long"
_LEAF = 64
_EXACT = 2.0**52


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double (an integral value); null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: _floor(x.cast("double") * scale)))


def _floor(x: Column) -> Column:
    # floor() of a double is a long and would wrap for huge values; those have no fraction
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


class BallTree:
    """Median splits along the widest axis; ``lo:hi`` are ranges of the permuted rows."""

    def __init__(self, x: np.ndarray, leaf: int = _LEAF) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # lo, hi, left, right
        centers, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = x[self.order[lo:hi]]
            c = rows.mean(0)
            centers.append(c)
            radii.append(float(np.sqrt(((rows - c) ** 2).sum(1).max())))
            me = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (p[0], p[1], me, p[3]) if side == 0 else (p[0], p[1], p[2], me)
            if hi - lo > leaf and radii[-1] > 0:
                axis = int(np.argmax(rows.max(0) - rows.min(0)))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], mid)]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.x = x[self.order]


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    top = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(1, x.shape[1])
    if top < _EXACT:
        return q @ x.T
    to_int = np.vectorize(int, otypes=[object])
    return to_int(q) @ to_int(x).T


class _Search:
    """The best ``k`` of each query of a block so far."""

    def __init__(self, tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: list, k: int) -> None:
        self.tree, self.ids, self.q, self.q_ids, self.floor, self.k = tree, ids[tree.order], q, q_ids, floor, k
        self.best: list[list[tuple]] = [[] for _ in q]
        self.kth: list[int | None] = [None if f is None or f <= -(2**63) else int(f) for f in floor]
        self.bar = np.array([-np.inf if f is None else float(f) for f in self.kth])  # bounds are wider than its rounding
        norms = np.sqrt((q**2).sum(1))
        with np.errstate(over="ignore"):
            self.bound = q @ tree.centers.T + norms[:, None] * tree.radii[None, :]
            self.bound += np.abs(self.bound) * 1e-9 + norms[:, None] * np.sqrt((tree.centers**2).sum(1))[None, :] * 1e-9 + 1e-6
        self.bound[~np.isfinite(self.bound)] = np.inf
        self.visited = 0

    def walk(self, node: int, rows: np.ndarray) -> None:
        rows = rows[self.bound[rows, node] >= self.bar[rows]]
        if not len(rows):
            return
        lo, hi, left, right = self.tree.nodes[node]
        if left < 0:
            self.leaf(lo, hi, rows)
            return
        first = self.bound[rows, left] >= self.bound[rows, right]
        self.walk(left, rows[first])
        self.walk(right, rows)
        self.walk(left, rows[~first])

    def leaf(self, lo: int, hi: int, rows: np.ndarray) -> None:
        self.visited += len(rows) * (hi - lo)
        scores, ids = _dot(self.q[rows], self.tree.x[lo:hi]), self.ids[lo:hi]
        for r, row in zip(rows, scores, strict=True):
            kth = self.kth[r]
            take = np.flatnonzero((ids != self.q_ids[r]) if kth is None else (row >= kth) & (ids != self.q_ids[r]))
            if not len(take):
                continue
            if len(take) > self.k and row.dtype != object:
                cut = np.partition(row[take], len(take) - self.k)[len(take) - self.k]
                take = take[row[take] >= cut]
            both = sorted(self.best[r] + [(-int(row[i]), int(ids[i])) for i in take])[: self.k]
            self.best[r] = both
            if len(both) == self.k:
                self.kth[r] = -both[-1][0] if kth is None else max(kth, -both[-1][0])
                self.bar[r] = float(self.kth[r])


def search_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: list, k: int) -> list[tuple[int, int, int]]:
    found = _Search(BallTree(x), ids, q, q_ids, floor, k)
    found.walk(0, np.arange(len(q)))
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    return [(int(q_ids[r]), i, clip(-s)) for r, best in enumerate(found.best) for s, i in best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64)


def _search_group(k: int):
    def run(key, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(qs):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        floor = [None if f is None else int(f) for f in qs["floor"]]  # digits, as pandas has no long with nulls
        rows = search_block(_matrix(xs["v"]), xs["vec_id"].to_numpy(), _matrix(qs["q"]), qs["query_id"].to_numpy(), floor, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def _assign(centers):
    """Nearest centre of each vector and the distance to it, by dimension."""

    @F.pandas_udf("center int, distance double")
    def nearest(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = {d: (m, (m**2).sum(1)) for d, m in centers.value.items()}
        for vs in columns:
            near, far = np.zeros(len(vs), np.int32), np.full(len(vs), np.inf)
            dims = vs.map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in known:
                    m, sq = known[d]
                    v = _matrix(vs.iloc[at])
                    near[at] = np.argmin(sq[None, :] - 2 * v @ m.T, axis=1)
                    far[at] = np.sqrt(((v - m[near[at]]) ** 2).sum(1))
            yield pd.DataFrame({"center": near, "distance": far})

    return nearest


def _bounds(balls):
    """Upper bound of the inner product with each ball of the query's dimension: array of (center, salts, bound)."""

    @F.pandas_udf("array<struct<center:int,salts:int,bound:double>>")
    def bounds(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = balls.value
        for qs in columns:
            out = []
            for q in qs:
                numbers, salts, c, r = known[len(q)]
                norm = np.sqrt((q**2).sum())
                with np.errstate(over="ignore", invalid="ignore"):
                    b = c @ q + norm * r
                    b += np.abs(b) * 1e-9 + norm * 1e-6 + 1e-6
                b[~np.isfinite(b)] = np.inf
                out.append([{"center": int(i), "salts": int(s), "bound": float(x)} for i, s, x in zip(numbers, salts, b, strict=True)])
            yield pd.Series(out)

    return bounds


def _lloyd(x: np.ndarray, k: int, steps: int = 5) -> np.ndarray:
    x = np.unique(x, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(steps):
        near = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def top_k(
    vectors: DataFrame,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_query: Column,
    scale: int = 256,
    shard_rows: int = 2048,
    query_rows: int = 2048,
    sample_rows: int = 65_536,
    max_centers: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest scores of every row for
    which ``is_query`` holds, against all rows but its own id.

    To the driver go a sample of 16 vectors a centre (4096 at least, ``sample_rows`` at
    most) and one row for each centre (at most ``max_centers`` for each vector length),
    which is also all that is broadcast.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantize(F.col(vector_col), scale).alias("v"), is_query.alias("asks")).where("v is not null and vec_id is not null").withColumn("dim", F.size("v"))
    wanted = max(1, min(max_centers, base.count() // (shard_rows // 4)))
    sample_rows = min(sample_rows, max(4096, 16 * wanted))
    sample = base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    offsets, values = sample.offsets.to_numpy(), sample.values.to_numpy()
    per_dim: dict[int, list] = {}
    for a, b in zip(offsets, offsets[1:], strict=False):
        per_dim.setdefault(int(b - a), []).append(values[a:b])
    centers = {d: _lloyd(np.array(vs, dtype=np.float64), max(1, round(wanted * len(vs) / len(sample)))) for d, vs in per_dim.items()}
    near = _assign(spark.sparkContext.broadcast(centers))
    base = materialize(base.withColumn("near", near("v")).select("vec_id", "v", "asks", "dim", "near.*"))

    groups = base.groupBy("dim", "center").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()
    salts = {(g.dim, g.center): -(-g.n // shard_rows) for g in groups}
    balls = {}
    for d in {g.dim for g in groups}:
        own = sorted((g.center, salts[d, g.center], g.r) for g in groups if g.dim == d)
        c = np.array([centers[d][i] for i, _, _ in own]) if d in centers else np.zeros((len(own), d))
        balls[d] = (*(np.array(x) for x in list(zip(*own, strict=True))[:2]), c, np.array([r for _, _, r in own]))
    # a centre's rows beyond shard_rows go to several shards by the hash of their id
    n_salts = spark.createDataFrame([(d, c, n) for (d, c), n in salts.items()], "dim int, center int, salts int")
    xs = base.select("vec_id", "v", "dim", "center").join(F.broadcast(n_salts), ["dim", "center"]).select(F.struct("dim", "center", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt")).alias("shard"), "vec_id", "v")

    n_blocks = max(1, -(-base.where("asks").count() // query_rows))
    queries = base.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("int").alias("block"))
    queries = queries.withColumn("bounds", _bounds(spark.sparkContext.broadcast(balls))("q"))
    home = F.array_max(F.transform("bounds", lambda b: F.struct(b["bound"].alias("bound"), (-b["center"]).alias("c"), b["salts"].alias("salts"))))
    queries = queries.withColumn("home", home).select(
        "query_id", "q", "dim", "block", "bounds", F.struct("dim", (-F.col("home.c")).alias("center"), F.pmod(F.xxhash64("query_id"), F.col("home.salts")).cast("int").alias("salt")).alias("home")
    )

    def search(wanted: DataFrame) -> DataFrame:
        pairs = materialize(wanted.select("shard", "block").distinct())
        blocks = xs.join(pairs, "shard").select("shard", "block", "vec_id", "v")
        return blocks.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInPandas(_search_group(k), FOUND_DDL)

    queries = materialize(queries)
    first = materialize(search(queries.select(F.col("home").alias("shard"), "block", "query_id", "q", F.lit(None).cast("string").alias("floor"))))
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query_id", "floor")
    left = queries.join(kth, "query_id", "left").withColumn("b", F.explode("bounds")).where("floor is null or b.bound >= floor")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("b.salts") - 1)))
    left = left.select(F.struct("dim", F.col("b.center").alias("center"), "salt").alias("shard"), "home", "block", "query_id", "q", F.col("floor").cast("string").alias("floor"))
    left = materialize(left.where("shard != home").drop("home"))
    found = first.unionByName(search(left))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
