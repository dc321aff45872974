"""Session, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "mossline", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; other settings through `conf` (dots as `__`)."""
    builder = SparkSession.builder.appName(app).master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small inputs keep all cores busy; large ones don't notice
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores; for Python stages over scans of few small files.

    Inputs of more partitions, as any large one has, are not shuffled. Plans with a shuffle are left alone too: their
    partitions are known only once it has run.
    """
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def importable_by_workers(spark: SparkSession) -> None:
    """On one machine, lets Python workers import this package from where the driver did; clusters have it installed."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.master.startswith("local[") and root not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, context.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, with times read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    importable_by_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below the cluster's spark.checkpoint.dir; only where that is unset (tests, one machine) a local one is made."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"mossline-{os.getpid()}"))
    return context.getCheckpointDir()


def table_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, for a table that is written and read again."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, limit_rows: int) -> bool:
    """Whether `df` has at most `limit_rows` rows, read no further than that; asked before rows are collected."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def micros(column) -> "F.Column":
    """Microseconds since 1970 of a timestamp with or without zone (UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))
