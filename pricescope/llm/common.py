"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.session import keep_result, remove, shared_dir

#: Whitespace that separates words in most contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest number of text bytes that a Python worker expands into numpy arrays at once.
PIECE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    ``session.drop_results`` removes it when nothing reads it any more.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep_result(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes to the shared folder and removes when it reads them no more; ``session.drop_results`` removes the others."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back. A table of the same name stays until ``drop``."""
        paths = self.made.setdefault(name, [])
        path = f"{self.folder}/{name}-{len(paths)}"
        df.write.parquet(path)
        keep_result(path)
        paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Remove the tables of these names, but for the newest of each if ``but_last``."""
        for name in names:
            paths = self.made.get(name, [])
            gone = paths[:-1] if but_last else paths
            for path in gone:
                if path:
                    remove(self.spark, path)
            self.made[name] = [*[""] * len(gone), *paths[len(gone) :]]

    def keep(self, *names: str) -> None:
        """Remove all tables but the newest of each of these names."""
        self.drop(*[n for n in self.made if n not in names])
        self.drop(*names, but_last=True)


#: Keys with more rows than this are dealt to several tasks; the largest HOT_KEYS keys are known to every task.
HOT_ROWS, HOT_KEYS, HOT_PARTS = 1000, 10_000, 4096


def hot_keys(counted: DataFrame, key: list[str], scratch: Scratch) -> DataFrame | None:
    """The keys of ``counted`` (with rows in column n) that need several tasks, and ``__parts``, in how many; None if there are none."""
    parts = F.least(F.lit(HOT_PARTS), F.ceil(F.col("n") / HOT_ROWS)).cast("int")
    largest = counted.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), *key).limit(HOT_KEYS).select(*key, parts.alias("__parts"))
    found = scratch.table(largest, "hot")
    return None if found.isEmpty() else found


def spread_join(big: DataFrame, small: DataFrame, key: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """An equi-join on ``key`` whose hot keys are split: rows of ``big`` by a hash of column ``by``, rows of ``small`` repeated.

    ``hot`` has HOT_KEYS rows at most, so it is broadcast.
    """
    if hot is None:
        return big.join(small, key, how)
    part = F.coalesce(F.pmod(F.xxhash64(by), "__parts"), F.lit(0)).cast("int")
    left = big.join(F.broadcast(hot), key, "left").withColumn("__part", part).drop("__parts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*key, "__part"], how).drop("__part")


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (nulls as empty), and the n + 1 offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)
