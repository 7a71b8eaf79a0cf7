"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL = "file:///tmp/checkpoints"
#: Spark removes an execution's shuffle files at its end: what they held is in the table written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset only a session on one machine may go on."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and frees the shuffle files behind it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads, not even after a lost executor."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """rows with name, their place from 1 on in the order of their group, without one task for a group.

    Rows are dealt out by ranges of (group, order), so that each partition holds a stretch of it; a stretch begins after as many as the group has in the
    partitions before. order must tell all rows of a group apart.
    """
    place = F.monotonically_increasing_id()  # partition and place in it
    laid = materialize(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_m", place))
    laid = laid.withColumn("_at", F.shiftright("_m", 33))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = laid.groupBy(group, "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first")).select(group, "_at", (before + 1 - F.col("_first")).alias("_shift"))
    return laid.join(starts, [group, "_at"]).withColumn(name, F.col("_m") + F.col("_shift")).drop("_at", "_m", "_shift")
