"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app_name: str = "claimwright",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build a session with the settings the library is written for.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a cluster both
    come from ``spark-submit`` and adaptive execution sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder, since there the driver
    and the executors are one process; it is removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="claimwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; with ``by`` in one
    folder per value of that column, so that a filter on it reads only its own files.

    This cuts the lineage (a lost executor re-reads files instead of recomputing joins),
    keeps column pruning and filter pushdown for the next steps, and gives Catalyst the
    true size of the table. Joins below therefore carry no broadcast hint: a small table
    is broadcast because its files are below ``spark.sql.autoBroadcastJoinThreshold``,
    and a large one falls back to a sort-merge join with skew handling.
    """
    path = shared_path(df.sparkSession, name)
    if not by:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    # Folder names cannot tell an empty value from none: a letter before the value can.
    # Rebalancing brings a value's rows together and still splits a hot value.
    marked = df.withColumn(by, F.concat(F.lit("="), F.col(by))).hint("rebalance", by)
    marked.write.partitionBy(by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.withColumn(by, F.expr(f"substring(`{by}`, 2)")).select(*df.columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Even out the rows over all cores before an iterative fit; by key hash, so a retried
    task gets the same rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
