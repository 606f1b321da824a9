"""The most similar vectors of every vector: robust-pruned graphs over shards, searched by beam.

Vectors are routed by many small cells (centroids fitted on a bounded sample), which are grouped into shards; where the
vectors are too many for one sample, every shard is divided again by cells of its own. A vector is stored and asks in every
shard with a cell whose border lies within a margin of it, however many these are. ``exact`` instead stores it once and sends
it to every shard that may hold a vector within the distance asked for, by the same border and the triangle inequality.
Each shard is one graph in one task; a shard that is still too large is a grid of parts. Distances of what the graphs
propose are computed exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.llm.graph import FAR, Graph

DIM = 64
SAMPLE = 32_768  #: vectors that the cells of one level are fitted on, at most about this many
SHARD = 2_600  #: vectors aimed at per shard, without copies
MOST = 32_768  #: vectors stored in one graph; beyond it a shard is split
MARGIN = 0.042  #: a vector also stands in the shards with a cell whose border is nearer to it than this
ASKING = 0.3  #: the same for the queries of a set, which stand in no other shard
_ODD = np.random.default_rng(11).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def usable(embedding: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` components, none of them null or NaN, not all zero."""
    most, least = F.array_max(embedding), F.array_min(embedding)
    return F.coalesce((F.size(F.array_compact(embedding)) == dim) & (F.size(embedding) == dim) & ~F.isnan(most) & ((most != 0) | (least != 0)), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """A list column of ``dim`` floats as (n, dim) in float32; no copy where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaling by the largest component first avoids overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, weights: np.ndarray | None = None, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, weight nearest to each) of unit vectors by spherical k-means."""
    w = np.ones(len(x)) if weights is None else weights
    c = x[np.random.default_rng(5).permutation(len(x))[:k]].copy()
    for turn in range(turns + 1):
        sums, count = np.zeros((k, x.shape[1])), np.zeros(k)
        for a in range(0, len(x), 2048):  # in blocks, to spare memory
            part = x[a : a + 2048]
            near = (part @ c.T).argmax(axis=1)
            count += np.bincount(near, w[a : a + 2048], k)
            order = np.argsort(near, kind="stable")
            which, first = np.unique(near[order], return_index=True)
            sums[which] += np.add.reduceat(part[order] * w[a : a + 2048][order, None], first, axis=0)
        if turn < turns:
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c, count


class Cells:
    """Cells and the shard that each belongs to, the shards numbered from ``first`` on."""

    def __init__(self, sample: np.ndarray, shards: int, first: int = 0):
        """At most one cell per 16 vectors of the sample and one shard per 8 cells."""
        if not len(sample):
            sample = np.eye(1, sample.shape[1], dtype=np.float32)
        centroids, weight = _means(sample, max(1, min(2048, len(sample) // 16)), turns=6)
        n = max(1, min(shards, len(centroids) // 8))
        shard = (centroids @ _means(centroids, n, weight + 1e-3)[0].T).argmax(axis=1)
        order = np.argsort(shard, kind="stable")
        self.centroids, self.shard = centroids[order], np.unique(shard[order], return_inverse=True)[1].reshape(-1)
        self.starts = np.searchsorted(self.shard, np.arange(self.shard[-1] + 1))
        self.share = np.add.reduceat(weight[order], self.starts) / weight.sum()
        self.first = first

    def near(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) of the shards with a cell whose border is within ``margin``; ``home`` marks the nearest cell's."""
        out = []
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            to = part @ self.centroids.T
            best = to.argmax(axis=1)
            # the border of cells b and c is at (x.b - x.c) / |b - c|; centroids are at most 2 apart
            behind = to.max(axis=1, keepdims=True) - to
            inside = behind <= 2 * margin + 1e-6
            if margin < 0.2:  # few cells are left to look at
                r, c = np.nonzero(inside)
                between = np.einsum("ij,ij->i", self.centroids[best[r]], self.centroids[c])
                inside[r, c] = behind[r, c] <= margin * np.sqrt(np.maximum(2 - 2 * between, 0)) + 1e-6
            else:
                inside &= behind <= margin * np.sqrt(np.maximum(2 - 2 * (self.centroids[best] @ self.centroids.T), 0)) + 1e-6
            row, shard = np.nonzero(np.logical_or.reduceat(inside, self.starts, axis=1))
            out.append((row + a, shard, shard == self.shard[best][row]))
        row, shard, home = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return row, shard + self.first, home


class Routing:
    """One level of cells, or two: then the shards of the first are divided by cells of their own."""

    def __init__(self, top: Cells, below: list[Cells] | None = None):
        self.top, self.below = top, below
        self.share = top.share if below is None else np.concatenate([s * c.share for s, c in zip(top.share, below)])

    def near(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home); see ``Cells.near``."""
        row, shard, home = self.top.near(x, margin)
        if self.below is None:
            return row, shard, home
        out = []
        for s in np.unique(shard):
            at = np.nonzero(shard == s)[0]
            r, t, h = self.below[s].near(x[row[at]], margin)
            out.append((row[at][r], t, h & home[at][r]))
        row, shard, home = (np.concatenate(c) for c in zip(*out)) if out else (row, shard, home)
        order = np.argsort(row, kind="stable")
        return row[order], shard[order], home[order]


def _sampled(rows: DataFrame, key: str, part: float) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64(F.lit(3), key), F.lit(1 << 40)) <= int(min(1.0, part) * (1 << 40)))


def fit_routing(rows: DataFrame, key: str, embedding: str, total: int, dim: int, sample: int, per: int) -> Routing:
    """The routing of about ``total`` rows to shards of about ``per``, fitted on a sample of at most about ``sample`` rows.

    If that sample carries too few cells for the shards wanted, each shard is sampled alike, in a task of its own, and
    divided by the cells found there; what comes back is at most one centroid per 16 rows of the samples.
    """
    table = _sampled(rows, key, sample / max(total, 1)).select(embedding).toArrow()
    x = np.empty((table.num_rows, dim), np.float32)
    at = 0
    for b in table.column(0).chunks:
        x[at : at + len(b)] = unit(matrix(b, dim))
        at += len(b)
    del table
    wanted = max(1, round(total / per))
    top = Cells(x, wanted)
    if wanted <= len(top.share):
        return Routing(top)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(top)  # at most sample / 16 centroids
    keep = np.minimum(1.0, sample / np.maximum(top.share * total, 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, h = matrix(b.column(1), dim), b.column(0).to_numpy()
            row, shard, home = shared.value.near(unit(v).astype(np.float32), 0.0)
            row, shard = row[home], shard[home]
            ok = h[row] <= keep[shard] * float(1 << 40)
            yield pa.RecordBatch.from_arrays([pa.array(shard[ok]), b.column(1).take(pa.array(row[ok]))], names=["shard", "e"])

    def fit(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        cells = Cells(unit(matrix(t.column("e"), dim)).astype(np.float32), max(1, round(top_share[s] * total / per)))
        return pa.table({"shard": [s], "cells": [pickle.dumps(cells)]})

    top_share = top.share
    hashed = rows.select(F.pmod(F.xxhash64(F.lit(4), key), F.lit(1 << 40)).alias("h"), F.col(embedding).cast("array<float>").alias("e"))
    fitted = hashed.mapInArrow(pick, "shard bigint, e array<float>").groupBy("shard").applyInArrow(fit, "shard bigint, cells binary")
    found = {r.shard: pickle.loads(r.cells) for r in fitted.toLocalIterator()}
    below, first = [], 0
    for s in range(len(top.share)):
        cells = found.get(s) or Cells(np.zeros((0, dim), np.float32), 1)
        cells.first = first
        first += len(cells.share)
        below.append(cells)
    return Routing(top, below)


def reach(within: float | None) -> float:
    """The margin that loses no vector within a distance: the sine of its angle, all shards from a right angle on."""
    if within is None or within >= 0.5:
        return 1e6
    return float(np.sqrt(1 - (1 - 2 * within) ** 2))


def prints(x: np.ndarray) -> np.ndarray:
    """64-bit prints of the components' bits; equal vectors have equal prints."""
    bits = x.view(np.uint32).astype(np.uint64)
    h = ((bits + np.uint64(1)) * _ODD[: x.shape[1]]).sum(axis=1, dtype=np.uint64)
    return h ^ (h >> np.uint64(29))


def collapse(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Equal vectors once: (index of one row of each, class of each row, the smallest ``most`` ids of each class)."""
    _, first, cls = np.unique(prints(x), return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    order = np.lexsort((ids, cls))
    starts = np.searchsorted(cls[order], np.arange(len(first) + 1))
    lists = [np.unique(ids[order[a:b]])[:most].tolist() if b - a > 1 else [int(ids[order[a]])] for a, b in zip(starts[:-1], starts[1:])]
    return first, cls, lists


def _grid(row: np.ndarray, shard: np.ndarray, sub: np.ndarray, parts: np.ndarray, base: np.ndarray, side: int) -> np.ndarray:
    """(row, cell) of all cells of the grids that a row stands in: those of its own part on one side."""
    n = parts[shard]
    ends = np.cumsum(n)
    r, s = np.repeat(row, n), np.repeat(shard, n)
    other = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    own = sub[r] % parts[s]
    return np.stack([r, base[s] + (own * parts[s] + other if side == 0 else other * parts[s] + own)], axis=1)


_ROUTED = "shard bigint, stored boolean, asks boolean, ids array<bigint>, embedding array<float>"


def shards(vectors: DataFrame, key: str, embedding: str, dim: int, most_ids: int, margin: float = MARGIN, per: int = SHARD, sample: int = SAMPLE, asks: Column | None = None, exact: bool = False) -> DataFrame:
    """Rows of the shards: (shard, stored, asks, ids, embedding), equal vectors of an Arrow batch as one row.

    Every vector is stored and asks in all shards within ``margin``. With ``exact`` or ``asks``, which marks the queries of
    a set, it is stored in its nearest shard alone, and only what asks goes to the others.
    """
    rows = vectors.filter(usable(F.col(embedding), dim) & F.col(key).isNotNull())
    total = vectors.count()
    routing = fit_routing(rows, key, embedding, total, dim, sample, per)
    parts = np.maximum(1, np.ceil(routing.share * total * (1 if asks is not None or exact else 2) / MOST)).astype(np.int64)
    # a split shard is a grid: each part of what is stored meets each part of what asks, so every task is bounded
    base = np.concatenate([[0], np.cumsum(parts * parts)])
    shared = rows.sparkSession.sparkContext.broadcast((routing, parts, base))  # at most a centroid per 16 rows of the samples
    once = asks is not None or exact
    chosen = rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e"), (asks if asks is not None else F.lit(True)).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routing, parts, base = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, q = b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            out = []
            for ask in (True, False):
                at = np.nonzero(q == ask)[0]
                if len(at):
                    first, _, lists = collapse(ids[at], x[at], most_ids)
                    out.append((at[first], lists, np.full(len(first), ask)))
            one = np.concatenate([o[0] for o in out])
            lists = [i for o in out for i in o[1]]
            ask = np.concatenate([o[2] for o in out])
            row, shard, home = routing.near(unit(x[one]).astype(np.float32), margin)
            sub = (prints(x[one]) >> np.uint64(7)).astype(np.int64)
            kept = home if once else np.ones(len(row), bool)
            stored = _grid(row[kept], shard[kept], sub, parts, base, 0)
            asking = _grid(row[ask[row]], shard[ask[row]], sub, parts, base, 1)
            both = np.concatenate([stored, asking])
            pair, index = np.unique(both, axis=0, return_inverse=True)
            index = index.reshape(-1)
            is_stored, is_asking = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
            is_stored[index[: len(stored)]] = True
            is_asking[index[len(stored) :]] = True
            xs = x[one][pair[:, 0]]
            emb = pa.ListArray.from_arrays(pa.array(np.arange(len(pair) + 1) * dim, pa.int32()), pa.array(xs.reshape(-1)))
            named = pa.array(lists, pa.list_(pa.int64())).take(pa.array(pair[:, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1]), pa.array(is_stored), pa.array(is_asking), named, emb], names=["shard", "stored", "asks", "ids", "embedding"])

    return chosen.mapInArrow(run, _ROUTED)


def _expand(i: np.ndarray, j: np.ndarray, d: np.ndarray, a_ids: list[list[int]], b_ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes as pairs of ids; as a neighbour a class counts with its smallest ids, which win all ties."""
    na, nb = np.array([len(x) for x in a_ids]), np.array([min(len(x), k + 1) for x in b_ids])
    if na.max(initial=1) == 1 and nb.max(initial=1) == 1:
        return np.array([x[0] if x else -1 for x in a_ids], np.int64)[i], np.array([x[0] if x else -1 for x in b_ids], np.int64)[j], d
    # pairs of single ids at once, the others one by one
    single = (na[i] == 1) & (nb[j] == 1)
    first = lambda lists: np.array([x[0] if x else -1 for x in lists], np.int64)
    a, b, dd = [], [], []
    for x, y, z in zip(i[~single].tolist(), j[~single].tolist(), d[~single].tolist()):
        for p in a_ids[x]:
            for r in b_ids[y][: k + 1]:
                a.append(p)
                b.append(r)
                dd.append(z)
    left, right, far = first(a_ids)[i[single]], first(b_ids)[j[single]], d[single]
    return np.concatenate([left, np.array(a, np.int64)]), np.concatenate([right, np.array(b, np.int64)]), np.concatenate([far, np.array(dd, np.float64)])


def _all_pairs(f: np.ndarray, who: np.ndarray, base: np.ndarray, k: int, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the k nearest of each by comparing all, for the exact form; those that tie with the k-th are among them."""
    for a in range(0, len(who), 512):
        some = who[a : a + 512]
        d = 1 - f[some] @ f[base].T
        d[some[:, None] == base[None, :]] = FAR
        kth = np.partition(d, min(k, len(base)) - 1, axis=1)[:, min(k, len(base)) - 1][:, None]
        r, c = np.nonzero(d <= np.minimum(kth + 1e-6, most))
        yield some[r], base[c]


def shard_neighbors(rows: pa.Table, k: int, dim: int, within: float | None, degree: int, beam: int, exact: bool = False) -> pa.Table:
    """(vec_a, vec_b, distance): the k nearest of every asking vector of one shard, by its graph; distances exact."""
    ids, x = rows.column("ids").to_pylist(), matrix(rows.column("embedding"), dim)
    stored, asks = rows.column("stored").to_numpy().astype(bool), rows.column("asks").to_numpy().astype(bool)
    _, first, cls = np.unique(prints(x), return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    n = len(first)
    asked, kept = [[] for _ in range(n)], [[] for _ in range(n)]
    for c, i, s, a in zip(cls.tolist(), ids, stored, asks):
        if a:
            asked[c] += i
        if s:
            kept[c] += i
    once = lambda v: sorted(set(v)) if len(v) > 1 else v
    asked, kept = [once(v) for v in asked], [once(v) for v in kept]
    u = unit(x[first])
    f = u.astype(np.float32)
    base = np.array([c for c in range(n) if kept[c]], np.int64)
    ask = np.array([c for c in range(n) if asked[c]], np.int64)
    none = pa.table({"vec_a": pa.array([], pa.int64()), "vec_b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    if not len(base) or not len(ask):
        return none
    far = float(FAR) - 1 if within is None else 2 * within + 1e-5
    got: list[tuple[np.ndarray, np.ndarray]] = []
    if exact:
        got += _all_pairs(f, ask, base, k + 1, far)
    else:
        g = Graph(f[base], degree=degree, beam=beam)
        number = np.full(n, -1, np.int64)
        number[base] = np.arange(len(base))
        inner, outer = ask[number[ask] >= 0], ask[number[ask] < 0]
        # a few more than k, as the last places are decided in double precision
        for who, (j, d) in ((inner, g.nearest(k + 3, number[inner].astype(np.int32), far)), (outer, g.ask(f[outer], k + 3))):
            r, s = np.nonzero(d < far)
            got.append((who[r], base[j[r, s]]))
    twins = np.array([c for c in ask if kept[c] and len(set(asked[c]) | set(kept[c])) > 1], np.int64)
    i = np.concatenate([*(p[0] for p in got), twins])
    j = np.concatenate([*(p[1] for p in got), twins])
    d = np.round(np.clip((1 - np.einsum("ij,ij->i", u[i], u[j])) / 2, 0, 1), 8) + 0.0
    d[i == j] = 0.0
    if within is not None:
        i, j, d = i[d <= within], j[d <= within], d[d <= within]
    a, b, d = _expand(i, j, d, asked, kept, k)
    a, b, d = a[a != b], b[a != b], d[a != b]
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    start = np.searchsorted(a, a)
    best = np.arange(len(a)) - start < k
    return pa.table({"vec_a": a[best], "vec_b": b[best], "distance": d[best]})


def nearest(vectors: DataFrame, k: int = 10, within: float | None = None, key: str = "vec_id", embedding: str = "embedding", dim: int = DIM, asks: Column | None = None, margin: float | None = None, degree: int = 16, beam: int = 16, sample: int = SAMPLE, per: int = SHARD, exact: bool = False) -> DataFrame:
    """(vec_a, vec_b, distance, rank): the k most similar other vectors of every vector, or of those that ``asks`` marks.

    Distances are (1 - cosine) / 2 in double precision, rounded to 8 decimals; ties go to the smaller id. ``within``
    leaves out neighbours beyond a distance early. ``exact`` compares all vectors that may lie within that distance and
    loses none; far from all cells that means nearly all shards, so its cost grows faster than the table.
    Vectors that are not usable (see ``usable``) and rows without key have
    no part; a repeated row counts once. Equal vectors travel and are searched once per Arrow batch; each counts as a
    neighbour, and of more than k + 1 copies each finds its nearest among the copies of the smallest ids. An empty table
    gives an empty result; a single vector has no neighbours. Further columns are left out.
    """
    if exact:
        margin = reach(within)
    elif margin is None:
        margin = MARGIN if asks is None else ASKING
    routed = shards(vectors, key, embedding, dim, k + 1, margin, per, sample, asks, exact)
    found = routed.groupBy("shard").applyInArrow(lambda t: shard_neighbors(t, k, dim, within, degree, beam, exact), "vec_a bigint, vec_b bigint, distance double")
    extra = _crowded(vectors, k, key, embedding, dim)
    if asks is not None:
        extra = extra.join(vectors.filter(asks).select(F.col(key).cast("long").alias("vec_a")).distinct(), "vec_a", "left_semi")
    merged = found.union(extra).groupBy("vec_a").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "vec_b"))), 1, k).alias("n"))
    return merged.select("vec_a", F.posexplode("n").alias("rank", "n")).select("vec_a", F.col("n.vec_b").alias("vec_b"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def _crowded(vectors: DataFrame, k: int, key: str, embedding: str, dim: int) -> DataFrame:
    """Neighbours among copies where a vector has more than k + 1 of them: every copy with the k of the smallest ids.

    Only ids and prints of the vectors are shuffled, counted before they are; the window keeps k + 1 rows before its
    shuffle, so the copies of a hot vector never come together.
    """
    from pyspark.sql import Window

    e = F.col(embedding)
    rows = vectors.filter(usable(e, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(e.cast("array<float>")).alias("h1"), F.xxhash64(F.lit(1), e.cast("array<float>")).alias("h2")).distinct()
    hot = rows.groupBy("h1", "h2").count().filter(F.col("count") > k + 1).drop("count")
    members = rows.join(hot, ["h1", "h2"])
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    firsts = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    near = members.join(firsts, ["h1", "h2"]).select(F.col("id").alias("vec_a"), F.explode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("vec_b"))
    return near.select("vec_a", "vec_b", F.lit(0.0).alias("distance"))


def close_pairs(vectors: DataFrame, within: float = 0.08, k: int = 10) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs at ``within`` or less of which one is among the k nearest of the other."""
    near = nearest(vectors, k, within)
    return near.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).distinct()
