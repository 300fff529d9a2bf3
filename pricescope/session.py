"""A session with the settings that the queries rely on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "pricescope", **settings: str) -> SparkSession:
    """UTC timestamps and adaptive execution; anything else stays the cluster's choice unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where it is unset, a session on one machine (master ``local``) gets a private one, gone at exit; a cluster has no folder
    that could be guessed, so that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there.")
        own = tempfile.mkdtemp(prefix="pricescope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
        named = context.getCheckpointDir()
    return named


#: Folders with the tables that results read; see ``drop_results``.
_results: set[str] = set()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_result(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_result(path: str) -> None:
    """Remember a table in the shared folder that a result reads."""
    _results.add(path)


def drop_results(spark: SparkSession) -> int:
    """Remove the tables that this session's results read, once the results are written or no longer wanted; how many there were."""
    gone = list(_results)
    for path in gone:
        remove(spark, path)
    return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _results.discard(path)
