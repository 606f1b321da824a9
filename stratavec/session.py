"""Session helpers: a tuned local session, table reading and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "stratavec") -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster use your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRATAVEC_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test or production table by name: ``{sf_dir}/{name}.parquet``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once per context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_stratavec_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratavec-"), "stratavec.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)  # copied to the driver's file server at once
    sc._stratavec_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a private one is set only where the session names none (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = conf or tempfile.mkdtemp(prefix="stratavec-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A checkpointed plan keeps the constraints, partitionings and statistics inferred for it; those of iterated joins
    multiply round by round until planning takes longer than running. So the checkpoint's rows are given a bare plan.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=eager)._jdf
    bare = spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    return DataFrame(bare, spark)
