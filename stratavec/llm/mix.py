"""Sources mixed to target weights by a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavec.llm.tokens import count_tokens
from stratavec.session import cut

MAX_SOURCES = 10_000
_PLAN = T.StructType([T.StructField("_source", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("_share", "_demand", "_size", "_tilt", "_total")] + [T.StructField("_copies", T.LongType())])


def plan_mix(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: float | None = None, strength: float = 0.5, tilt: dict[str, float] | None = None) -> list[tuple]:
    """Rows of (source, share, demand, size, tilt, total, copies) for the sources that can take part.

    The total is the largest at which no source is needed more than its cap of repeats times, or ``total`` if that is
    less. Sources without a share, a cap or any tokens take no part and the other shares are scaled to sum to 1.
    A source's weight at time t in [0, 1] is share * (1 + tilt * (2t - 1)); tilts default to larger sources first and
    satisfy sum(share * tilt) = 0, so the weights sum to 1 at any time.
    """
    live = {s: (w, r if r is not None else 1) for s, w, r in targets if s is not None and w and w > 0 and sizes.get(s) and (r is None or r >= 1)}
    whole = sum(w for w, _ in live.values())
    if not live:
        return []
    share = {s: w / whole for s, (w, _) in live.items()}
    most = min(live[s][1] * sizes[s] / share[s] for s in live)
    size = min(most, total) if total is not None else most
    mean = sum(w * w for w in share.values())
    spread = max(abs(mean - w) for w in share.values()) or 1.0
    tilts = tilt or {s: -strength * (mean - w) / spread for s, w in share.items()}
    off = sum(share[s] * tilts.get(s, 0.0) for s in share)
    tilts = {s: tilts.get(s, 0.0) - off for s in share}
    if any(abs(a) > 1 for a in tilts.values()):
        raise ValueError("a tilt beyond 1 makes a weight negative")
    return [(s, share[s], share[s] * size, float(sizes[s]), tilts[s], float(size), math.ceil(share[s] * size / sizes[s] - 1e-12)) for s in sorted(share)]


def _moment(done: Column) -> Column:
    """The time at which a source's demand reaches ``done`` (share of its demand): inverse of t + tilt (t^2 - t)."""
    a = F.col("_tilt")
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * done))
    return F.when(F.abs(a) < 1e-9, done).otherwise(2 * done / ((1 - a) + root))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, total: float | None = None, seed: int = 0, strength: float = 0.5, tilt: dict[str, float] | None = None, buckets: int = 4096) -> DataFrame:
    """The documents of the mix in training order: ``(position, doc_id, source, copy, n_tokens)``.

    ``position`` is the place in the token stream of the mix (0 to its total); ``copy`` counts a document's uses from 0.
    In each source, documents stand in the order of a hash; a source is passed through once or several times, the last
    pass up to the place where its demand ends (rounded to the nearest document). Running sums are taken in hash buckets
    and then over the bucket totals, so no source, however large, comes together in one task.

    Documents without source, without tokens (null or empty text) or of a source without target stay out. A repeated row
    (same doc_id) counts once. ``targets`` (source, target_share, max_repeats): null or non-positive shares stay out, a
    null cap is 1, a repeated row counts once, a source named twice has its shares added and the smaller cap. Empty tables give an empty mix.
    """
    goal = [tuple(r) for r in targets.select("source", "target_share", "max_repeats").distinct().groupBy("source").agg(F.sum("target_share"), F.min("max_repeats")).limit(MAX_SOURCES + 1).collect()]
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    named = [s for s, *_ in goal if s is not None]
    rows = documents.select("doc_id", "source", "text").filter(F.col("source").isin(named) if named else F.lit(False))
    counted = count_tokens(rows, "text", tokenizer=tokenizer).filter("n_tokens > 0").dropDuplicates(["doc_id"])
    placed = cut(counted.select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("_order")).withColumn("_bucket", F.pmod(F.shiftright("_order", 40), F.lit(buckets)).cast("int")))
    sizes = {r[0]: r[1] for r in placed.groupBy("source").agg(F.sum("n_tokens")).collect()}  # at most one row per target
    plan = documents.sparkSession.createDataFrame(plan_mix(goal, sizes, total, strength, tilt), _PLAN)

    per_bucket = placed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = per_bucket.select("source", "_bucket", (F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inner = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id")
    summed = placed.withColumn("_in", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).join(before, ["source", "_bucket"])
    mid = F.col("_before") + F.col("_in") + F.col("n_tokens") / 2

    # at most MAX_SOURCES rows of the plan are broadcast
    used = summed.join(F.broadcast(plan), summed.source == plan._source).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    at = F.col("copy") * F.col("_size") + mid
    kept = used.filter(at < F.col("_demand"))
    return kept.select((_moment(at / F.col("_demand")) * F.col("_total")).alias("position"), "doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens").orderBy("position", "source", "doc_id", "copy")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``(source, target_share, max_repeats, n_documents, n_uses, max_uses, n_tokens, actual_share)``."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("u"), F.sum("n_tokens").alias("t"))
    per = per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("u").alias("n_uses"), F.max("u").alias("max_uses"), F.sum("t").alias("n_tokens"))
    goal = targets.filter("source is not null").select("source", "target_share", "max_repeats").distinct().groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    out = goal.join(per, "source", "left").fillna(0, ["n_documents", "n_uses", "max_uses", "n_tokens"])
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row per target by now
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), whole), F.lit(0.0)), 6))
