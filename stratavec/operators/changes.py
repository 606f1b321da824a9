"""The change stream: validation, stream order, the latest operation per id and its application to an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("Inserted", "Changed", "Deleted", "Error")
ALIASES = {"Replaced": "Changed"}  # the documented name of an operation that is read as Changed
CHUNK = 100


def op_name() -> Column:
    op = F.col("op")
    for alias, name in ALIASES.items():
        op = F.when(op == alias, name).otherwise(op)
    return op


def problem() -> Column:
    """Why a row is no valid operation; null if it is one."""
    op = op_name()
    return (
        F.when(op.isNull() | ~op.isin(*OPS), F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null"))))
        .when(op.isin("Inserted", "Changed", "Deleted") & F.col("id").isNull(), "operation without id")
        .when(op.isin("Inserted", "Changed") & F.col("string").isNull(), "operation without string")
        .when((op == "Error") & F.col("message").isNull(), "error without message")
    )


def validated(ops: DataFrame, strict: bool = True) -> DataFrame:
    """Valid operations under their own names. ``strict`` fails the job at the first bad row, else bad rows are left out."""
    why = problem()
    if strict:
        return ops.withColumn("op", F.when(why.isNull(), op_name()).otherwise(F.raise_error(why).cast("string")))
    return ops.filter(why.isNull()).withColumn("op", op_name())


def chunks(ops: DataFrame, seq: str = "seq", size: int = CHUNK) -> DataFrame:
    """Rows per chunk of the stream: (chunk, n)."""
    return ops.groupBy(F.floor(F.col(seq) / size).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def latest(ops: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last operation of every id in stream order, without errors and rows without id.

    A max_by aggregation, so an id with many operations is reduced before the shuffle.
    """
    rows = ops.filter((F.col("op") != "Error") & F.col(key).isNotNull())
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def apply_changes(manifest: DataFrame, ops: DataFrame, key: str = "id", keep: tuple[str, ...] = ("seq",), allow_duplicate_ids: bool = False) -> DataFrame:
    """The manifest after the operations: ids with a later operation leave it, the inserted and changed ones enter.

    ``allow_duplicate_ids`` only adds, as an index without update and delete does.
    """
    if allow_duplicate_ids:
        new = ops.filter(F.col("op").isin("Inserted", "Changed") & F.col(key).isNotNull()).select(key, *keep)
        return manifest.select(key, *keep).unionByName(new)
    last = latest(ops, key)
    kept = manifest.select(key, *keep).join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("op <> 'Deleted'").select(key, *keep))


def with_seq(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """Contiguous numbers in file order (path, then place in the file) for rows just read from files.

    Rows per task are counted first and numbered from their sums, so no global sort or single task is needed.
    """
    at = lines.select("*", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.spark_partition_id().alias("_t"), F.monotonically_increasing_id().alias("_m"))
    parts = at.groupBy("_p", "_b", "_t").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    # one row per file split: small against the rows, as each stands for a block of them
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = at.join(before.select("_p", "_b", "_t", "_first", "_before"), ["_p", "_b", "_t"])
    return out.withColumn(seq, F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_b", "_t", "_m", "_first", "_before")
