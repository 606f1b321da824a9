"""Exact nearest-neighbour search: one query, many queries, stored points, duplicates and pairs within a distance.

Many-against-many runs over a grid of blocks: a block of queries meets a block of the base in one task as a matrix
product that keeps only k rows a query, and the blocks' results are merged by a window that limits before it shuffles.
Ties go to the smaller id. ``lsh_pairs_within`` and ``lsh_nearest`` are the approximate forms for large collections.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.functions.vectors import distance, euclidean_radius

BLOCK = 16_384  #: rows of a block; a task holds two of them and 512 rows of their distances


def nearest(base: DataFrame, query: list[float] | Column, k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: (key, distance), nearest first; fewer if the base is smaller. NaN distances come last."""
    if not isinstance(k, int) or k < 0:
        raise ValueError("k must be a whole number of at least 0")
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return base.filter(F.col(embedding).isNotNull()).select(F.col(key), distance(F.col(embedding), q).alias("distance")).orderBy("distance", key).limit(k)


def similar(base: DataFrame, point, k: int = 10, key: str = "vec_id", embedding: str = "embedding", order: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The k rows nearest to a stored point, itself included unless excluded.

    If the key is stored more than once, the row of the largest ``order`` (by default the key) is the query. An unknown
    point raises ``KeyError``.
    """
    rows = base.filter((F.col(key) == F.lit(point)) & F.col(embedding).isNotNull()).orderBy(F.col(order or key).desc()).select(embedding).head(1)
    if not rows:
        raise KeyError(point)
    rest = base.filter(F.col(key) != F.lit(point)) if exclude_self else base
    return nearest(rest, rows[0][0], k, key, embedding)


def _block_top(k: int, within: float | None, strict: bool, ordered: bool):
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = t.column("id").to_numpy()
        lists = t.column("embedding").combine_chunks()
        width = len(lists[0]) if len(lists) else 0
        x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), width)
        out: list[tuple] = []
        order = np.argsort(ids[side == 1], kind="stable")
        bi, bx = ids[side == 1][order], x[side == 1][order]
        qi, qx = ids[side == 0], x[side == 0]
        for a in range(0, len(qi) if len(bi) else 0, 512):
            d = (qx[a : a + 512] @ bx.T - 1) / -2.0
            d = np.where(d <= 0, 0.0, np.where(d >= 1, 1.0, d))
            if ordered:
                d = np.where(qi[a : a + 512][:, None] < bi[None, :], d, np.inf)
            if within is not None:
                d = np.where((d < within) if strict else (d <= within), d, np.inf)
            if k and k < d.shape[1]:
                # all that tie with the k-th stay, so that ties can go to the smaller id
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                keep = d <= kth
            else:
                keep = np.ones(d.shape, bool)
            r, c = np.nonzero(keep & (d < np.inf))
            if k:
                o = np.lexsort((bi[c], d[r, c], r))
                r, c = r[o], c[o]
                first = np.searchsorted(r, r)
                ok = np.arange(len(r)) - first < k
                r, c = r[ok], c[ok]
            out.append((qi[a : a + 512][r], bi[c], d[r, c]))
        cols = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind) for n, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"i": cols[0], "j": cols[1], "distance": cols[2]})

    return run


def _grid(queries: DataFrame, base: DataFrame, key: str, embedding: str, block: int, run) -> DataFrame:
    nq, nb = (max(1, math.ceil(df.count() / block)) for df in (queries, base))
    cut = lambda df, n: df.filter(F.col(embedding).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    left = cut(queries, nq).select("id", "embedding", F.col("own").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"), F.lit(0).alias("side"))
    right = cut(base, nb).select("id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.col("own").alias("bb"), F.lit(1).alias("side"))
    return left.union(right).groupBy("qb", "bb").applyInArrow(run, "i bigint, j bigint, distance double")


def nearest_all(queries: DataFrame, base: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(i, j, distance, rk): the k rows of the base nearest to every query row, a row's own id included."""
    part = _grid(queries, base, key, embedding, block, _block_top(k, None, False, False))
    w = Window.partitionBy("i").orderBy("distance", "j")
    return part.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def duplicates(points: DataFrame, threshold: float = 0.0, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(i, j, distance): of each point's two nearest those with i < j and distance < threshold, the farther one if both.

    This is the reference's candidate list: at most one j per i, and nothing at the default threshold.
    """
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise ValueError("the threshold must be a number")
    hits = nearest_all(points, points, 2, key, embedding, block).filter((F.col("distance") < threshold) & (F.col("i") < F.col("j")))
    return hits.groupBy("i").agg(F.max_by(F.struct("j", "distance"), "rk").alias("b")).select("i", "b.j", "b.distance")


def all_pairs_within(points: DataFrame, threshold: float, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(i, j, distance), i < j: every pair nearer than the threshold. Exact over all blocks; see ``lsh_pairs_within``."""
    return _grid(points, points, key, embedding, block, _block_top(0, threshold, True, True))


def compare(pairs: DataFrame, a: str, b: str, variant: str = "default") -> DataFrame:
    """The rows of ``pairs`` with ``equal`` and ``distance`` of two vector columns."""
    return pairs.withColumns({"equal": F.col(a) == F.col(b), "distance": distance(F.col(a), F.col(b), variant)})


def _lsh(tables: int, width: float, seed: int):
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed)


def _features(df: DataFrame, key: str, embedding: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.filter(F.col(embedding).isNotNull()).select(F.col(key).alias("id"), array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))


def lsh_pairs_within(points: DataFrame, threshold: float, tables: int = 6, width: float = 0.5, seed: int = 42, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Approximate ``all_pairs_within`` for unit vectors by random projections; a distance t is the radius 2 * sqrt(t)."""
    f = _features(points, key, embedding)
    model = _lsh(tables, width, seed).fit(f)
    near = model.approxSimilarityJoin(f, f, euclidean_radius(threshold), "r").filter("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), (F.col("r") * F.col("r") / 4).alias("distance"))


def lsh_duplicates(points: DataFrame, threshold: float = 0.0, tables: int = 6, width: float = 0.5, seed: int = 42, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Approximate ``duplicates`` for unit vectors: both directions of the near pairs, then the same rule on each point's two nearest."""
    near = lsh_pairs_within(points, threshold, tables, width, seed, key, embedding).filter(F.col("distance") < threshold)
    both = near.select("i", "j", "distance").union(near.select(F.col("j"), F.col("i"), "distance"))
    # a point is its own nearest unless a copy of a smaller id comes before it
    ranked = both.union(points.filter(F.col(embedding).isNotNull()).select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("distance"))).groupBy("i").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "j"))), 1, 2).alias("n"))
    hits = ranked.select("i", F.posexplode("n").alias("rk", "n")).select("i", "rk", F.col("n.j").alias("j"), F.col("n.distance").alias("distance")).filter("i < j")
    return hits.groupBy("i").agg(F.max_by(F.struct("j", "distance"), "rk").alias("b")).select("i", "b.j", "b.distance")


def results_json(results: DataFrame) -> DataFrame:
    """Every row as one JSON object in the column ``value``, as a client of the search service gets it."""
    return results.select(F.to_json(F.struct("*")).alias("value"))


def lsh_nearest(points: DataFrame, query: list[float], k: int = 10, tables: int = 6, width: float = 0.5, seed: int = 42, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Approximate ``nearest`` for unit vectors."""
    from pyspark.ml.linalg import Vectors

    f = _features(points, key, embedding)
    near = _lsh(tables, width, seed).fit(f).approxNearestNeighbors(f, Vectors.dense(query), k, distCol="r")
    return near.select(F.col("id").alias(key), (F.col("r") * F.col("r") / 4).alias("distance")).orderBy("distance", key)
