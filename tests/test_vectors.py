import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavec.functions import names, vectors
from stratavec.operators import search


def test_distance_clamp_and_special_values(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([2.0, 0.0], [2.0, 0.0]), ([float("nan"), 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(vectors.distance(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.0, 1.0, 0.0] and math.isnan(got[3]) and got[4] is None and got[5] is None


def test_normalize_zero_and_variants(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(vectors.normalize(F.col("v"))).collect()]
    assert got[0] == [0.6, 0.8] and all(math.isnan(x) for x in got[1]) and got[2] is None
    r = spark.range(1).select(vectors.pad_trim(F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")), 3), vectors.empty_embedding(2), vectors.random_normalized_embedding(8)).first()
    assert list(r[0]) == [1.0, 2.0, 0.0] and list(r[1]) == [0.0, 0.0] and abs(np.linalg.norm(r[2]) - 1) < 1e-6


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5, width=32), min_size=4, max_size=4).filter(lambda v: sum(x * x for x in v) > 1e-3), min_size=2, max_size=6))
def test_distance_laws(spark, vs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v array<float>").withColumn("v", vectors.normalize(F.col("v")))
    p = df.alias("a").join(df.alias("b"), F.lit(True)).select("a.i", F.col("b.i").alias("j"), vectors.distance(F.col("a.v"), F.col("b.v")).alias("d")).collect()
    d = {(r[0], r[1]): r[2] for r in p}
    assert all(0 <= x <= 1 for x in d.values()) and all(abs(d[i, j] - d[j, i]) < 1e-12 for i, j in d) and all(d[i, i] < 1e-6 for i in range(len(vs)))


def test_axis_points_tie_by_id(spark):
    e = np.eye(4)[:2]
    pts = [(f"Point/{k + 1}", k, v.tolist()) for k, v in enumerate([e[0], e[1], -e[0], -e[1]])]
    df = spark.createDataFrame(pts, "id string, vec_id long, embedding array<double>")
    got = search.nearest(df, [0.707, 0.707, 0.0, 0.0], 4, "vec_id").collect()
    assert [r[0] for r in got][:2] == [0, 1] and len(got) == 4
    assert search.nearest(df, [1.0, 0.0, 0.0, 0.0], 9).count() == 4


def test_duplicates_semantics(spark):
    def at(d):  # a unit vector at distance d from e1
        c = 1 - 2 * d
        return [c, math.sqrt(1 - c * c), 0.0]

    rows = [(0, [1.0, 0.0, 0.0]), (1, at(0.01)), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.i, r.j) for r in search.duplicates(df, 0.05).collect()}
    assert got == {(0, 1), (2, 3)}  # at most one j per i, from the two nearest; 3 finds 2 and itself
    assert search.duplicates(df).count() == 0
    assert {(r.i, r.j) for r in search.all_pairs_within(df, 0.05).collect()} == {(0, 1), (2, 3), (2, 4), (3, 4)}


def test_grid_blocks_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = {(r.i, r.j, r.rk) for r in search.nearest_all(df, df, 5).collect()}
    many = {(r.i, r.j, r.rk) for r in search.nearest_all(df, df, 5, block=13).collect()}
    assert one == many and len(one) == 300


def test_lsh_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    exact = {(r.i, r.j) for r in search.all_pairs_within(df, 0.3).collect()}
    near = {(r.i, r.j) for r in search.lsh_pairs_within(df, 0.3, tables=12, width=2.0).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_names(spark):
    r = spark.range(1).select(names.index_name(F.lit("a b/*~"), F.lit("c@1")).alias("n")).select("n", names.parse_index_name(F.col("n")).alias("p")).first()
    assert r.n == "a%20b%2F%2A~@c@1" and (r.p.domain, r.p.commit) == ("a b/*~", "c@1")
