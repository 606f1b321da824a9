"""Hierarchical density clustering: neighbour graph, spanning forest, condensed hierarchy and stable clusters.

Shards (see ``neighbors``) give each vector's nearest neighbours, whose lists merged over all shards give its core distance,
and then a spanning forest of each shard under mutual reachability; their union is a sparse graph. A distributed Boruvka takes the minimum
spanning forest of it. The hierarchy is read off the forest at every distinct weight, and clusters are chosen by stability.
No step brings a cluster, however large, into one task: a task reads at most the edges of one round of the hierarchy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.components import components, follow, four_steps
from stratavec.llm.neighbors import DIM, MARGIN, SAMPLE, SHARD, matrix, prints, reach, shards, unit, usable
from stratavec.session import cut

_EDGE = "a bigint, b bigint, w double"
_ARROW_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])
_NEAR = "shard bigint, print bigint, a bigint, n int, near array<struct<b:bigint,d:double,m:int>>"
_ARROW_NEAR = pa.schema([("shard", pa.int64()), ("print", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("near", pa.list_(pa.struct([("b", pa.int64()), ("d", pa.float64()), ("m", pa.int32())])))])
_MERGED = "kind string, c bigint, n bigint, chain string, parent string, acc double, below double, t double"
_ARROW_MERGED = pa.schema([("kind", pa.string()), ("c", pa.int64()), ("n", pa.int64()), ("chain", pa.string()), ("parent", pa.string()), ("acc", pa.float64()), ("below", pa.float64()), ("t", pa.float64())])
BULK = 500_000  #: edges of the forest read in one round, and so at most in one task
GROUP = 20_000  #: edges of small trees aimed at per task


def spanning_forest(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of unit vectors under 1 - cosine, without the edges above ``most``; rows are made as needed."""
    n = len(x)
    best, parent = np.full(n, np.inf, np.float32), np.zeros(n, np.int64)
    free = np.ones(n, bool)
    a, b = [], []
    at = 0
    for _ in range(n - 1):
        free[at] = False
        d = 1 - x @ x[at]
        nearer = (d < best) & free
        best[nearer] = d[nearer]
        parent[nearer] = at
        best[at] = np.inf
        nxt = int(np.argmin(best))
        if not free[nxt]:
            nxt = int(np.argmax(free))
        elif best[nxt] <= most:
            a.append(parent[nxt])
            b.append(nxt)
        at = nxt
    return np.array(a, np.int64), np.array(b, np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        root[x] = y
    for x in range(n):
        while root[x] != root[root[x]]:
            root[x] = root[root[x]]
    return np.unique(np.array(root), return_inverse=True)[1].reshape(-1)


def shard_edges(rows: pa.Table, dim: int, most: float) -> pa.Table:
    """Edges (a, b, distance) up to ``most`` that connect one shard; vectors by the smallest id of their copies.

    The spanning forest of what is stored and, of those that only ask, the nearest one in each tree of the forest.
    """
    ids, x = rows.column("ids").to_pylist(), matrix(rows.column("embedding"), dim)
    stored = rows.column("stored").to_numpy().astype(bool)
    _, first, cls = np.unique(prints(x), return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    n = len(first)
    lists: list[set[int]] = [set() for _ in range(n)]
    is_stored = np.zeros(n, bool)
    for c, i, s in zip(cls.tolist(), ids, stored):
        lists[c].update(i)
        is_stored[c] |= s
    name = np.array([min(s) for s in lists], np.int64)
    u = unit(x[first])
    f = u.astype(np.float32)
    base = np.nonzero(is_stored)[0]
    fa, fb = spanning_forest(f[base], 2 * most + 1e-6)
    tree = _labels(len(base), fa, fb)
    pairs = [(base[fa], base[fb])]
    by_tree = np.argsort(tree, kind="stable")
    starts = np.searchsorted(tree[by_tree], np.arange(tree.max(initial=-1) + 1))
    outer = np.nonzero(~is_stored)[0]
    for at in range(0, len(outer) if len(base) else 0, 512):
        guests = outer[at : at + 512]
        ordered = (1 - f[guests] @ f[base].T)[:, by_tree]
        least = np.minimum.reduceat(ordered, starts, axis=1)
        for g, row, low in zip(guests, ordered, least):
            for t in np.nonzero(low <= 2 * most + 1e-6)[0]:
                end = starts[t + 1] if t + 1 < len(starts) else len(by_tree)
                pairs.append((np.array([g]), base[by_tree[[starts[t] + int(np.argmin(row[starts[t] : end]))]]]))
    i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    w = np.round(np.clip((1 - np.einsum("ij,ij->i", u[i], u[j])) / 2, 0, 1), 8) + 0.0
    ok = w <= most
    low, high, w = np.minimum(name[i[ok]], name[j[ok]]), np.maximum(name[i[ok]], name[j[ok]]), w[ok]
    return pa.table({"a": low, "b": high, "w": w}, schema=_ARROW_EDGE)


def shard_near(rows: pa.Table, k: int, dim: int, most: float) -> pa.Table:
    """(shard, print, a, n, near) of every vector of one cell: its print, name, copies and nearest others up to ``most``.

    ``near`` holds (b, d, m), name, distance and copies of the k - 1 nearest that the cell stores; it is empty where a
    vector does not ask. Copies are counted up to k.
    """
    ids, x = rows.column("ids").to_pylist(), matrix(rows.column("embedding"), dim)
    stored, asks = rows.column("stored").to_numpy().astype(bool), rows.column("asks").to_numpy().astype(bool)
    marks, first, cls = np.unique(prints(x), return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    n = len(first)
    lists: list[set[int]] = [set() for _ in range(n)]
    for c, i in zip(cls.tolist(), ids):
        lists[c].update(i)
    is_stored, is_asking = np.zeros(n, bool), np.zeros(n, bool)
    is_stored[cls[stored]] = True
    is_asking[cls[asks]] = True
    name = np.array([min(s) for s in lists], np.int64)
    copies = np.array([min(len(s), k) for s in lists])
    u = unit(x[first])
    f = u.astype(np.float32)
    base, who = np.nonzero(is_stored)[0], np.nonzero(is_asking)[0]
    near: list[list[dict]] = [[] for _ in range(n)]
    for at in range(0, len(who) if len(base) else 0, 512):
        some = who[at : at + 512]
        d = 1 - f[some] @ f[base].T
        d[some[:, None] == base[None, :]] = np.inf
        m = min(k + 3, len(base))  # a few more than k - 1, as the last places are decided in double precision
        at_base = base[np.argpartition(d, m - 1, axis=1)[:, :m]]
        exact = np.round(np.clip((1 - np.einsum("id,ijd->ij", u[some], u[at_base])) / 2, 0, 1), 8) + 0.0
        exact[(at_base == some[:, None]) | (exact > most)] = np.inf
        order = np.argsort(exact, axis=1, kind="stable")[:, : k - 1]
        exact, at_base = np.take_along_axis(exact, order, 1), np.take_along_axis(at_base, order, 1)
        for c, dd, bb in zip(some.tolist(), exact, at_base):
            near[c] = [{"b": int(name[j]), "d": float(v), "m": int(copies[j])} for v, j in zip(dd, bb) if v <= most]
    shard = np.full(n, rows.column("shard")[0].as_py(), np.int64)
    return pa.table([shard, marks.view(np.int64), name, copies.astype(np.int32), near], schema=_ARROW_NEAR)


def shard_forest(rows: pa.Table, known: pa.Table, dim: int, most: float) -> pa.Table:
    """The minimum spanning forest (a, b, w) under mutual reachability of all vectors of one cell that ``known`` names.

    What a split shard's cells hold are all pairs of its parts, so the forests of the cells hold that of the shard; of the
    two cells of a pair one is enough.
    """
    none = _ARROW_EDGE.empty_table()
    if not rows.num_rows or not known.num_rows:
        return none
    x = matrix(rows.column("embedding"), dim)
    stored, asks = rows.column("stored").to_numpy().astype(bool), rows.column("asks").to_numpy().astype(bool)
    marks, first, cls = np.unique(prints(x), return_index=True, return_inverse=True)
    cls = cls.reshape(-1)
    sides = np.zeros((2, len(first)), bool)
    sides[0, cls[stored]] = True
    sides[1, cls[asks]] = True
    _, here, there = np.intersect1d(marks.view(np.int64), known.column("print").to_numpy(), return_indices=True)
    name, core = known.column("a").to_numpy()[there], known.column("core").to_numpy()[there]
    first, (left, right) = first[here], sides[:, here]
    if not (left & right).any() and (not left.any() or not right.any() or name[left].min() > name[right].min()):
        return none
    u = unit(x[first])
    n = len(first)
    best, parent, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, w = [], [], []
    at = 0
    for _ in range(n - 1):
        free[at] = False
        d = np.maximum(np.maximum((1 - u @ u[at]) / 2, core), core[at])
        nearer = (d < best) & free
        best[nearer] = d[nearer]
        parent[nearer] = at
        best[at] = np.inf
        at = int(np.argmin(best))
        if not free[at]:
            at = int(np.argmax(free))
        elif round(best[at], 8) <= most:
            a.append(name[parent[at]])
            b.append(name[at])
            w.append(round(max(best[at], 0.0), 8))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "w": np.array(w, np.float64)}, schema=_ARROW_EDGE)


def core_distances(near: DataFrame, k: int) -> DataFrame:
    """(a, core) of the vectors that have k vectors, themselves counted, among the nearest of all their cells together."""
    each = near.select("a", "n", F.explode_outer("near").alias("e")).groupBy("a", F.col("e.b").alias("b")).agg(F.max("n").alias("n"), F.min("e.d").alias("d"), F.max("e.m").alias("m"))
    lists = each.groupBy("a").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("d", "m")))).alias("l"))
    reached = F.aggregate("l", F.struct(F.col("n").alias("n"), F.lit(0.0).alias("d")), lambda s, e: F.struct((s["n"] + F.when(s["n"] < k, e["m"]).otherwise(0)).alias("n"), F.when(s["n"] < k, e["d"]).otherwise(s["d"]).alias("d")))
    return lists.select("a", reached.alias("s")).filter(F.col("s.n") >= k).select("a", F.col("s.d").alias("core"))


def neighbour_graph(vectors: DataFrame, min_samples: int, most: float, key: str = "vec_id", embedding: str = "embedding", dim: int = DIM, margin: float = MARGIN, sample: int = SAMPLE, per: int = SHARD, exact: bool = False) -> DataFrame:
    """(a, b, w), a < b: edges up to ``most`` weighed by mutual reachability, the larger of distance and both core distances.

    The core distance is that to the ``min_samples``-th nearest vector, itself and all copies counted, among all cells that
    a vector stands in; with 1 it is 0 and the weight is the distance. Copies of a vector are linked to the one of the
    smallest id at their core distance.
    """
    routed = shards(vectors, key, embedding, dim, max(2, min_samples), reach(most) if exact else margin, per, sample, exact=exact)
    e = F.col(embedding)
    prints_ = vectors.filter(usable(e, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(e.cast("array<float>")).alias("h1"), F.xxhash64(F.lit(1), e.cast("array<float>")).alias("h2")).distinct()
    first = prints_.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twins = prints_.join(first, ["h1", "h2"]).filter("id <> a").select("a", F.col("id").alias("b"))
    if min_samples == 1:
        edges = cut(routed.groupBy("shard").applyInArrow(lambda t: shard_edges(t, dim, most), _EDGE))
        twins = twins.withColumn("w", F.lit(0.0))
    else:
        near = cut(routed.groupBy("shard").applyInArrow(lambda t: shard_near(t, min_samples, dim, most), _NEAR))
        core = cut(core_distances(near, min_samples))
        known = near.select("shard", "print", "a").join(core, "a")
        placed = routed.select("shard", "stored", "asks", "embedding")
        edges = cut(placed.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda t, c: shard_forest(t, c, dim, most), _EDGE))
        twins = twins.join(core, "a").select("a", "b", F.col("core").alias("w"))
    return edges.filter("a < b").groupBy("a", "b").agg(F.min("w").alias("w")).union(twins)


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (a, b, w) and the labels (v, root) of its trees, root being the smallest vertex.

    In each round every label takes its lightest edge to another one (ties by the edge's ends, so no cycle can arise); such
    an edge belongs to the forest whatever set of vertices the label stands for. Labels then move four steps along the
    edges taken, and between two labels only the lightest edge is kept.
    """
    rest = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")).filter("x <> y")
    rest = cut(rest.groupBy("x", "y").agg(F.min("e").alias("e")))
    labels = rest.select(F.explode(F.array("x", "y")).alias("v")).distinct().withColumn("c", F.col("v"))
    taken, steps = [], []
    while not rest.isEmpty():
        both = rest.select("x", "y", "e").union(rest.select("y", "x", "e"))
        chosen = cut(both.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.e").alias("e")))
        taken.append(chosen.select("e.a", "e.b", "e.w"))
        back = chosen.select(F.col("x").alias("k2"), F.col("y").alias("y2"))
        # two labels that took the same edge point at each other; the smaller one stays
        mutual = chosen.join(back, chosen.y == back.k2).select(F.col("x").alias("k"), F.when((F.col("y2") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("to"))
        best = cut(four_steps(mutual))
        steps.append(best)
        p, q = best.select(F.col("k").alias("x"), F.col("to").alias("p")), best.select(F.col("k").alias("y"), F.col("to").alias("q"))
        moved = rest.join(p, "x").join(q, "y").filter("p <> q")
        rest = cut(moved.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("e").alias("e")))
    forest = edges.select("a", "b", "w").limit(0)
    for f in taken:
        forest = forest.union(f)
    labels = cut(follow(labels, steps))
    least = labels.groupBy("c").agg(F.min("v").alias("root"))
    return forest.distinct(), labels.join(least, "c").select("v", "root")


def linked_groups(vectors: DataFrame, within: float = 0.08, least: int = 8) -> DataFrame:
    """(first_vec, vec_id): members of the groups of at least ``least`` vectors that steps of ``within`` or less connect.

    This is the density hierarchy with core distance 0, cut at ``within``. The smallest member names its group and has no
    row. Vectors that are not usable belong to no group; an empty table gives an empty result.
    """
    _, labels = boruvka(neighbour_graph(vectors, 1, within))
    labels = cut(labels)
    big = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("root")
    return labels.join(big, "root").filter("v <> root").select(F.col("root").alias("first_vec"), F.col("v").alias("vec_id"))


def merge_level(edges: pa.Table, nodes: pa.Table, level: int, least: int) -> pa.Table:
    """Whole trees merged at every distinct distance of their edges, as rows of ``_MERGED`` told apart by ``kind``.

    ``edges`` holds (x, y, t), ``nodes`` the state of what they connect. Rows "in" give the cluster and distance at which a
    node without cluster came into one, "end" the clusters that met others, "state" the merged component of each tree.
    """
    cols = {c: nodes.column(c).to_pylist() for c in ("c", "n", "chain", "acc", "below", "r")}
    name, size, chain, acc, below, tree = (cols[c] for c in ("c", "n", "chain", "acc", "below", "r"))
    at = {c: i for i, c in enumerate(name)}
    root = list(range(len(name)))
    loose = [[i] if chain[i] is None else [] for i in root]
    out: list[tuple] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rows = sorted(zip(edges.column("t").to_pylist(), edges.column("x").to_pylist(), edges.column("y").to_pylist()))
    fresh = k = 0
    while k < len(rows):
        t = rows[k][0]
        # what edges of one length connect meets at once, whatever their order
        meeting: dict[int, list[int]] = {}
        while k < len(rows) and rows[k][0] == t:
            p, q = find(at[rows[k][1]]), find(at[rows[k][2]])
            k += 1
            if p != q:
                mine, other = meeting.pop(p, [p]), meeting.pop(q, [q])
                if size[p] < size[q]:
                    p, q, mine, other = q, p, other, mine
                root[q] = p
                mine.extend(other)
                meeting[p] = mine
        for r, parts in meeting.items():
            n, bigs = sum(size[i] for i in parts), [i for i in parts if chain[i] is not None]
            if len(bigs) == 1:
                one = bigs[0]
                now, total, gain = chain[one], acc[one] + (n - size[one]) / t, below[one]
            elif bigs or n >= least:
                now, total, gain = f"{level}:{tree[r]}:{fresh}", n / t, 0.0
                fresh += 1
                for i in bigs:
                    stability = acc[i] - size[i] / t
                    gain += max(stability, below[i])
                    out.append(("end", None, size[i], chain[i], now, stability, below[i], None))
            else:
                now, total, gain = None, 0.0, 0.0
            most = max(parts, key=lambda i: len(loose[i]))
            free = loose[most]
            for i in parts:
                if i != most:
                    free.extend(loose[i])
            if now is not None:
                out += [("in", name[i], None, now, None, None, None, t) for i in free]
                free = []
            size[r], chain[r], acc[r], below[r], loose[r] = n, now, total, gain, free
    for i in range(len(name)):
        if root[i] == i:
            out.append(("state", tree[i], size[i], chain[i], None, acc[i], below[i], None))
    return pa.table([list(c) for c in zip(*out)] if out else [[] for _ in _ARROW_MERGED], schema=_ARROW_MERGED)


class Clusters:
    """Clusters of a table of vectors, chosen by stability out of the condensed hierarchy.

    ``least`` is the size from which a component counts as a cluster. The hierarchy is read at every distinct weight of the
    forest; ``levels`` is only the least number of rounds in which that is done, beside the one for every ``BULK`` edges, and
    doesn't change the result. Vectors in no chosen cluster are left over.
    """

    def __init__(self, vectors: DataFrame, min_samples: int = 5, least: int = 8, most: float = 0.16, levels: int = 1, key: str = "vec_id", embedding: str = "embedding"):
        self.vectors = vectors.filter(usable(F.col(embedding))).select(F.col(key).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
        forest, labels = boruvka(neighbour_graph(vectors, min_samples, most, key, embedding))
        # distances of 0 have no density; they count as the smallest step that rounding leaves
        self.forest = cut(forest.select(F.col("a").alias("x"), F.col("b").alias("y"), F.greatest("w", F.lit(1e-6)).alias("t")))
        self.labels = cut(labels)
        self._read(least, levels)

    def _rounds(self, total: int, levels: int) -> list[tuple[float, bool]]:
        """(distance, tie): rounds up to a distance with about ``BULK`` edges at most, or of one distance that more edges have."""
        ties = {r.t for r in self.forest.groupBy("t").count().filter(F.col("count") > BULK).collect()}  # at most total / BULK
        n = max(levels, -(-total // BULK))
        cuts = self.forest.approxQuantile("t", [(k + 1) / n for k in range(n - 1)], 0.2 / n) if n > 1 else []
        top = self.forest.agg(F.max("t")).first()[0]
        out = []
        for t in sorted({*cuts, *ties, top}):
            out += [(np.nextafter(t, 0), False), (t, True)] if t in ties else [(t, False)]
        return [(float(t), tie) for t, tie in out]

    def _read(self, least: int, levels: int) -> None:
        """Climb the hierarchy: contract, carry the cluster of each component, close clusters where two of them meet."""
        spark = self.vectors.sparkSession
        total = self.forest.count()
        steps = self._rounds(total, levels) if total else []
        verts = self.labels.select("v")
        # comps: component, size, its cluster (null while too small), the sum of 1/distance at which members came in, best of its parts
        comps = verts.select(F.col("v").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("chain"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("below"))
        open_ = verts.select("v", F.col("v").alias("c"))
        edges = self.forest
        joined, closed = [], []
        for k, (t, tie) in enumerate(steps):
            last = k == len(steps) - 1
            now = edges.filter(F.col("t") <= t)
            if now.isEmpty():
                continue
            roots = self.labels if last else cut(components(now, "x", "y"))
            to = roots.select(F.col("v").alias("c"), F.col("root").alias("r"))
            read = self._tie if tie else self._range
            comps, ended, came = read(comps, open_, now, to, k, t, least, total)
            closed.append(ended)
            joined.append(came)
            if not last:
                open_ = cut(open_.join(came.select("v"), "v", "left_anti").join(to, "c", "left").select("v", F.coalesce("r", "c").alias("c")))
                left = edges.filter(F.col("t") > t).join(to.select(F.col("c").alias("x"), F.col("r").alias("p")), "x", "left").join(to.select(F.col("c").alias("y"), F.col("r").alias("q")), "y", "left")
                edges = cut(left.select(F.coalesce("p", "x").alias("x"), F.coalesce("q", "y").alias("y"), "t"))
        top = steps[-1][0] if steps else 1.0
        rest = comps.filter("chain is not null").select("chain", F.lit(None).cast("string").alias("parent"), "n", (F.col("acc") - F.col("n") / top).alias("stability"), "below")
        for c in closed:
            rest = rest.union(c)
        chains = cut(rest.withColumn("own", F.col("stability") >= F.col("below")))
        # the topmost chosen ancestor of every cluster, by doubling the steps up
        up = chains.select("chain", "parent", F.when(F.col("own"), F.col("chain")).alias("best"))
        while not up.filter("parent is not null").isEmpty():
            above = up.select(F.col("chain").alias("parent"), F.col("parent").alias("next"), F.col("best").alias("higher"))
            up = cut(up.join(above, "parent", "left").select("chain", F.col("next").alias("parent"), F.coalesce("higher", "best").alias("best")))
        rows = joined[0] if joined else spark.createDataFrame([], "v long, chain string, t double")
        for j in joined[1:]:
            rows = rows.union(j)
        chosen = cut(rows.join(up.select("chain", "best"), "chain").filter("best is not null").select("v", "best", "t"))
        name = chosen.groupBy("best").agg(F.min("v").alias("cluster"), F.count(F.lit(1)).alias("size"), F.min("t").alias("t0"))
        self._chosen = cut(chosen.join(name, "best").select(F.col("v").alias("vec_id"), "cluster", "size", "t", F.round(F.col("t0") / F.col("t"), 6).alias("persistence"), F.col("best").alias("chain")))
        self._stability = chains.select("chain", "stability")

    @staticmethod
    def _range(comps: DataFrame, open_: DataFrame, now: DataFrame, to: DataFrame, k: int, t: float, least: int, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Components, ended clusters and members after all distances up to ``t``; a task gets whole trees of this round alone."""
        bucket = F.pmod(F.xxhash64("r"), F.lit(-(-total // GROUP))).alias("g")
        e = now.join(to.select(F.col("c").alias("x"), "r"), "x").select(bucket, "x", "y", "t")
        nodes = comps.join(to, "c").select(bucket, "c", "n", "chain", "acc", "below", "r")
        out = cut(e.groupBy("g").cogroup(nodes.groupBy("g")).applyInArrow(lambda a, b: merge_level(a, b, k, least), _MERGED))
        state = out.filter("kind = 'state'").select("c", "n", "chain", "acc", "below")
        ended = out.filter("kind = 'end'").select("chain", "parent", "n", F.col("acc").alias("stability"), "below")
        came = open_.join(out.filter("kind = 'in'").select("c", "chain", "t"), "c").select("v", "chain", "t")
        return cut(comps.join(to, "c", "left_anti").union(state)), ended, cut(came)

    @staticmethod
    def _tie(comps: DataFrame, open_: DataFrame, now: DataFrame, to: DataFrame, k: int, t: float, least: int, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same for edges that all have the length ``t``, by joins and aggregations, as one tree may hold any number of them."""
        moved = cut(comps.join(to, "c", "left").withColumn("r", F.coalesce("r", "c")))
        per = moved.groupBy("r").agg(F.sum("n").alias("n"), F.count("chain").alias("big"), F.min("chain").alias("one"), F.sum("acc").alias("acc"), F.sum(F.when(F.col("chain").isNotNull(), F.col("n")).otherwise(0)).alias("inside"))
        # clusters that meet others here end: members leave them at this level
        ends = moved.filter("chain is not null").join(per.filter("big > 1").select("r"), "r")
        ended = cut(ends.select("chain", F.concat(F.lit(f"{k}:"), F.col("r")).alias("parent"), "n", (F.col("acc") - F.col("n") / t).alias("stability"), "below"))
        gained = ended.groupBy("parent").agg(F.sum(F.greatest("stability", "below")).alias("gain"))
        fresh = F.concat(F.lit(f"{k}:"), F.col("r"))
        named = per.withColumn("chain", F.when(F.col("big") == 1, F.col("one")).when((F.col("big") > 1) | (F.col("n") >= least), fresh))
        below = moved.filter("chain is not null").groupBy("chain").agg(F.max("below").alias("old"))
        state = named.join(gained, named.chain == gained.parent, "left").drop("parent").join(below, "chain", "left")
        comps = cut(state.select(F.col("r").alias("c"), "n", "chain", F.when(F.col("chain").isNull(), 0.0).when(F.col("big") == 1, F.col("acc") + (F.col("n") - F.col("inside")) / t).otherwise(F.col("n") / t).alias("acc"), F.coalesce("gain", "old", F.lit(0.0)).alias("below")))
        at = open_.join(to, "c", "left").select("v", F.coalesce("r", "c").alias("c"))
        came = cut(at.join(comps.select("c", "chain"), "c").filter("chain is not null").select("v", "chain", F.lit(t).alias("t")))
        return comps, ended, came

    def members(self) -> DataFrame:
        """(vec_id, cluster, persistence): every usable vector; cluster is its smallest member, null for those left over.

        Persistence is 1 for the members that the cluster holds at its closest and falls with the distance at which a
        member came in.
        """
        return self.vectors.join(self._chosen.select("vec_id", "cluster", "persistence"), "vec_id", "left")

    def summary(self, typical: int = 3) -> DataFrame:
        """(cluster, size, stability, exemplars): the ``typical`` most persistent members, smaller ids first among equals."""
        from pyspark.sql import Window

        w = Window.partitionBy("cluster").orderBy(F.col("persistence").desc(), "vec_id")
        best = self._chosen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
        few = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"]).alias("exemplars"))
        sizes = self._chosen.groupBy("cluster").agg(F.max("size").alias("size"), F.min("chain").alias("chain"))
        return sizes.join(self._stability, "chain").join(few, "cluster").select("cluster", "size", F.round("stability", 4).alias("stability"), "exemplars")
