import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.llm import density, neighbors
from stratavec.llm.graph import Graph

SCHEMA = "vec_id long, embedding array<float>, distance string"


def made(n_clusters=12, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c in range(n_clusters):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(3, 25))):
            v = centre + rng.normal(size=64) * 0.03
            rows.append((k, v.astype(np.float32)))
            k += 1
    for _ in range(60):
        rows.append((k, rng.normal(size=64).astype(np.float32)))
        k += 1
    for _ in range(15):  # copies, more than k + 1
        rows.append((k, rows[0][1]))
        k += 1
    return rows


def frame(spark, rows):
    bad = [(9000, [0.0] * 64), (9001, [float("nan")] * 64), (9002, [1.0] * 63), (9003, [1.0] * 65), (9004, []), (9005, None), (9006, [None] + [1.0] * 63), (None, [1.0] * 64)]
    return spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in rows] + [(i, v, "x") for i, v in bad] + [(0, [float(x) for x in rows[0][1]], "x")], SCHEMA)


def truth(rows):
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = np.round(np.clip((1 - x @ x.T) / 2, 0, 1), 8)
    return ids, d


def top(ids, d, k):
    out = {}
    for a in range(len(ids)):
        order = sorted((d[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[int(ids[a])] = {int(b) for _, b in order}
    return out


def test_nearest_equals_brute_force(spark):
    rows = made()
    ids, d = truth(rows)
    want = top(ids, d, 10)
    got = {}
    for r in neighbors.nearest(frame(spark, rows), 10).collect():
        got.setdefault(r.vec_a, set()).add(r.vec_b)
    assert set(got) == set(want)
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * sum(map(len, want.values()))
    at = {int(i): k for k, i in enumerate(ids)}
    near = [(a, b) for a in want for b in want[a] if d[at[a], at[b]] <= 0.08]
    assert sum(b in got[a] for a, b in near) >= 0.97 * len(near)
    assert got[0] == want[0]  # copies: the smallest ids


def test_query_set_and_split_shards(spark, monkeypatch):
    rows = made(seed=4)
    ids, d = truth(rows)
    want = top(ids, d, 5)
    df = frame(spark, rows)
    got = {}
    for r in neighbors.nearest(df, 5, asks=F.col("vec_id") % 10 == 0, per=40).collect():
        got.setdefault(r.vec_a, set()).add(r.vec_b)
    assert set(got) == {i for i in want if i % 10 == 0}
    assert sum(len(got[i] & want[i]) for i in got) >= 0.9 * 5 * len(got)
    monkeypatch.setattr(neighbors, "MOST", 50)
    whole = {(r.vec_a, r.vec_b) for r in neighbors.close_pairs(df).collect()}
    t10 = top(ids, d, 10)
    at = {int(i): k for k, i in enumerate(ids)}
    pairs = {(min(a, b), max(a, b)) for a in t10 for b in t10[a] if d[at[a], at[b]] <= 0.08}
    assert len(whole & pairs) >= 0.97 * len(pairs) and len(whole & pairs) >= 0.97 * len(whole)


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embedding_data.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float32)) for r in df.filter(neighbors.usable(F.col("embedding"))).dropDuplicates(["vec_id"]).collect()]
    ids, d = truth(rows)
    want = top(ids, d, 10)
    got = {}
    for r in neighbors.nearest(df, 10).collect():
        got.setdefault(r.vec_a, set()).add(r.vec_b)
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_exact_and_two_levels(spark):
    rows = made(40, seed=9)
    ids, d = truth(rows)
    df = frame(spark, rows)
    t10 = top(ids, d, 10)
    at = {int(i): k for k, i in enumerate(ids)}
    want = {(a, b) for a in t10 for b in t10[a] if d[at[a], at[b]] <= 0.08}
    for kw in ({"per": 40}, {"per": 10, "sample": 256}, {"per": 100_000}):  # one level of cells, two, a single shard
        assert {(r.vec_a, r.vec_b) for r in neighbors.nearest(df, 10, 0.08, exact=True, **kw).collect()} == want
    near = {(r.vec_a, r.vec_b) for r in neighbors.nearest(df, 10, 0.08, per=10, sample=256).collect()}
    assert len(near & want) >= 0.97 * len(want)
    from stratavec.llm.density import boruvka, neighbour_graph

    _, labels = boruvka(neighbour_graph(df, 1, 0.08, exact=True, per=10, sample=256))
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.root, set()).add(r.v)
    assert {(min(g), v) for g in groups.values() if len(g) >= 8 for v in g if v != min(g)} == linked(ids, d, 0.08, 8)


def test_graph_of_few_points():
    for n in (1, 2, 5):
        x = np.eye(8, dtype=np.float32)[:n]
        ids, dist = Graph(x).nearest(3)
        assert ids.shape == (n, 3) and ((ids < n).sum(axis=1) == min(3, n - 1)).all()


def test_empty_tables(spark):
    df = frame(spark, made())
    assert neighbors.nearest(df.limit(0)).count() == 0 and density.linked_groups(df.limit(0)).count() == 0
    assert neighbors.nearest(df.filter("vec_id >= 9000")).count() == 0


def linked(ids, d, within, least):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(d <= within, 1))):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(int(ids[k]))
    return {(min(g), v) for g in groups.values() if len(g) >= least for v in g if v != min(g)}


@pytest.mark.parametrize("most", [None, 60])
def test_linked_groups_equal_brute_force(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(neighbors, "MOST", most)
    rows = made(seed=2)
    ids, d = truth(rows)
    assert {tuple(r) for r in density.linked_groups(frame(spark, rows)).collect()} == linked(ids, d, 0.08, 8)


def test_forest_has_the_least_weight(spark):
    rng = np.random.default_rng(1)
    n = 60
    w = np.round(rng.random((n, n)), 3)
    edges = [(a, b, float(w[a, b])) for a in range(n) for b in range(a + 1, n) if w[a, b] < 0.3]
    forest, labels = density.boruvka(spark.createDataFrame(edges, "a long, b long, w double"))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = 0.0
    for a, b, x in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            want += x
    got = forest.collect()
    assert abs(sum(r.w for r in got) - want) < 1e-9 and len(got) == n - len({find(x) for x in range(n)})
    assert {r.v: r.root for r in labels.collect()} == {x: find(x) for x in range(n)}


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows, owner = [], {}
    for c in range(4):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(20):
            owner[len(rows)] = c
            rows.append((len(rows), (centre + rng.normal(size=64) * 0.03).astype(np.float32)))
    for _ in range(20):
        rows.append((len(rows), rng.normal(size=64).astype(np.float32)))
    c = density.Clusters(frame(spark, rows), levels=5)
    members = {r.vec_id: r.cluster for r in c.members().collect()}
    assert len(members) == 100 and all(members[k] is None for k in range(80, 100))
    assert len({members[k] for k in owner}) == 4 and all(members[k] == members[20 * owner[k]] for k in owner)
    summary = {r.cluster: r for r in c.summary().collect()}
    assert sorted(r["size"] for r in summary.values()) == [20] * 4 and all(len(r.exemplars) == 3 for r in summary.values())


def reach(ids, d, k, most):
    """Weights of the minimum spanning forest under mutual reachability, by brute force."""
    core = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    root, out = list(range(len(ids))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a, b = np.nonzero(np.triu(w <= most, 1))
    for k in np.argsort(w[a, b], kind="stable"):
        ra, rb = find(a[k]), find(b[k])
        if ra != rb:
            root[ra] = rb
            out.append(float(w[a[k], b[k]]))
    return out


@pytest.mark.parametrize("most", [None, 200])
def test_reachability_forest_equals_brute_force(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(neighbors, "MOST", most)
    rows = made(seed=6)
    rows += [(len(rows) + i, rows[30 + i // 2][1]) for i in range(8)]  # fewer copies than min_samples
    ids, d = truth(rows)
    forest, _ = density.boruvka(density.neighbour_graph(frame(spark, rows), 5, 0.16))
    got, want = sorted(r.w for r in forest.collect()), reach(ids, d, 5, 0.16)
    assert len(got) == len(want) and np.allclose(got, want, atol=2e-8)


def test_clusters_of_split_shards(spark, monkeypatch):
    df = frame(spark, made(seed=7))
    whole = {r.vec_id: r.cluster for r in density.Clusters(df).members().collect()}
    monkeypatch.setattr(neighbors, "MOST", 200)
    assert {r.vec_id: r.cluster for r in density.Clusters(df).members().collect()} == whole


def test_clusters_that_meet_soon_after_they_form(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []

    def group(centre, n, spread):
        for _ in range(n):
            rows.append((len(rows), (centre + rng.normal(size=64) * spread).astype(np.float32)))

    for _ in range(12):  # close ones, which hold nearly all weights of the forest
        c = rng.normal(size=64)
        group(c / np.linalg.norm(c), 20, 0.002)
    c, to = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    first = len(rows)
    group(c, 10, 0.02)
    group(c * np.cos(0.6) + to * np.sin(0.6), 10, 0.02)
    rows += [(len(rows) + i, rows[0][1]) for i in range(30)]
    df = frame(spark, rows)
    got = density.Clusters(df)
    members = {r.vec_id: (r.cluster, r.persistence) for r in got.members().collect()}
    assert [members[first + k][0] for k in range(20)] == [first] * 10 + [first + 10] * 10
    monkeypatch.setattr(density, "BULK", 25)  # many rounds, the copies in one of their own
    assert {r.vec_id: (r.cluster, r.persistence) for r in density.Clusters(df, levels=3).members().collect()} == members
