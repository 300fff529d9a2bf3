"""The stored alerts: a table in a shared folder, in partitions by month, that streams merge into.

A batch is merged by alert id: alerts that the table has stay as they are (their status may have changed since), so that a batch that
is written again changes nothing. Only the partitions that a batch touches are read and rewritten.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.session import remove

MONTH = "month"


def _month(at: str) -> Column:
    return F.date_format(at, "yyyy-MM")


def read_alerts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {MONTH} string").option("basePath", folder).parquet(folder)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def months(spark: SparkSession, folder: str) -> list[str]:
    """The partitions that the table has."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName().removeprefix(f"{MONTH}=") for s in files.listStatus(path) if s.getPath().getName().startswith(f"{MONTH}="))


def _rewrite(rows: DataFrame, folder: str) -> None:
    """Replace the partitions that the rows belong to; one file each, as a month's alerts of a day's run are few."""
    rows.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(folder)


def merge_alerts(batch: DataFrame, folder: str, schema: str) -> None:
    """Add a batch's alerts. Equal ids of a batch count once; null times go to the partition of none."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["alert_id"]).withColumn(MONTH, _month("created_at"))
    touched = {r[0] for r in fresh.select(MONTH).distinct().collect()}
    known = [m for m in months(spark, folder) if m in touched or m.startswith("__HIVE")]
    if known:
        within = F.col(MONTH).isin([m for m in touched if m is not None])
        held = read_alerts(spark, folder, schema).where(within | F.col(MONTH).isNull() if None in touched else within)
        fresh = held.unionByName(fresh.join(held.select("alert_id"), "alert_id", "left_anti"))
    _rewrite(fresh, folder)


def mark_alerts(spark: SparkSession, folder: str, schema: str, before: str = "new", after: str = "read") -> int:
    """Give all alerts of one status another, and say how many there were. Partitions without any aren't rewritten."""
    table = read_alerts(spark, folder, schema)
    counts = {r[0]: r[1] for r in table.where(F.col("status") == before).groupBy(MONTH).count().collect()}
    if counts:
        touched = F.col(MONTH).isin([m for m in counts if m is not None])
        touched = touched | F.col(MONTH).isNull() if None in counts else touched
        _rewrite(table.where(touched).withColumn("status", F.when(F.col("status") == before, after).otherwise(F.col("status"))), folder)
    return sum(counts.values())


def expire_alerts(spark: SparkSession, folder: str, as_of: datetime, days: int) -> list[str]:
    """Drop the partitions that lie wholly before the last ``days`` days: no file is read. What is left of the oldest one is filtered by ``live_alerts``."""
    oldest = (as_of - timedelta(days=days)).strftime("%Y-%m")
    gone = [m for m in months(spark, folder) if m < oldest and not m.startswith("__HIVE")]
    for m in gone:
        remove(spark, f"{folder}/{MONTH}={m}")
    return gone


def live_alerts(spark: SparkSession, folder: str, schema: str, as_of: datetime, days: int) -> DataFrame:
    """The alerts of the last ``days`` days. The scan lists only partitions that can hold some."""
    since = as_of - timedelta(days=days)
    return read_alerts(spark, folder, schema).where((F.col(MONTH) >= since.strftime("%Y-%m")) & (F.col("created_at") >= F.lit(since)))
