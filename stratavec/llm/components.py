"""Connected components of an edge table, contracted round by round; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import cut


def four_steps(pointers: DataFrame) -> DataFrame:
    """(k, to) with every pointer followed four times; a pointer to what has none ends there."""

    def twice(p: DataFrame) -> DataFrame:
        q = p.select(F.col("k").alias("k2"), F.col("to").alias("to2"))
        return p.join(q, p["to"] == q["k2"], "left").select("k", F.coalesce("to2", "to").alias("to"))

    return twice(twice(pointers))


def follow(labels: DataFrame, steps: list[DataFrame], column: str = "c") -> DataFrame:
    """The labels after all rounds of contraction."""
    for s in steps:
        labels = labels.join(s, labels[column] == s["k"], "left").withColumn(column, F.coalesce("to", column)).drop("k", "to")
    return labels


def components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> DataFrame:
    """``(v, root)``: every vertex of an edge with the smallest vertex of its component.

    In each round a vertex points to the neighbour (or itself) with the smallest hash, pointers are followed four times and
    edges inside one label fall away; the expected number of rounds grows with the logarithm of the longest path. Rounds
    end when no edge is left, and each is checkpointed. Self-loops only name a vertex; null ends are left out; repeated
    edges don't matter. Vertices are of the type ``kind``, which must have an order.
    """
    pairs = edges.select(F.col(a).cast(kind).alias("x"), F.col(b).cast(kind).alias("y")).filter("x is not null and y is not null")
    labels = pairs.select(F.explode(F.array("x", "y")).alias("v")).distinct().withColumn("c", F.col("v"))
    rest = cut(pairs.filter("x <> y").distinct())
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        turn = len(steps)
        both = rest.select("x", "y").union(rest.select("y", "x"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c.alias("v"))  # noqa: B023, E731
        near = both.groupBy("x").agg(F.min(rank(F.col("y"))).alias("n"))
        near = cut(near.select(F.col("x").alias("k"), F.least("n", rank(F.col("x")))["v"].alias("to")))
        best = cut(four_steps(near))
        steps.append(best)
        left = rest.join(best, rest.x == best.k).select(F.col("to").alias("x"), "y")
        left = left.join(best, left.y == best.k).select("x", F.col("to").alias("y")).filter("x <> y")
        rest = cut(left.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    labels = follow(labels, steps)
    least = labels.groupBy("c").agg(F.min("v").alias("root"))
    return labels.join(least, "c").select("v", "root")
