"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone. One more shard takes rows only into itself:
no ring table is kept, and of n + 1 shards' rows one (n + 1)-th moves.

Defined cases: a null key is a key of its own (all such rows share a shard); a null text has no bytes and a null
checksum; repeated rows share a shard and get different slots; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots are counted in so many ranges of each shard; the table of their sizes has shards x SLOT_RANGES rows at most.
SLOT_RANGES = 256
#: That table is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_RANGES = 200_000

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys, for all keys at once."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = np.floor((shard[moving] + 1) * (float(1 << 31) / draw))
        inside = target < shards
        moving = moving[inside]
        shard[moving] = target[inside].astype(np.int64)
    return shard.astype(np.int32)


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long; equal in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a key column of any atomic type."""

    @F.arrow_udf(T.IntegerType())
    def jump(hashes: pa.Array) -> pa.Array:
        return pa.array(jump_hash(np.asarray(hashes.to_numpy(zero_copy_only=False), np.int64), shards), pa.int32())

    return jump(key_hash(key))


def with_slots(rows: DataFrame, shard: str, shards: int, order: Column, slot: str) -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    ``order`` is an even hash as lowercase hex text; a shard's rows are numbered by it. Rows are dealt by shard and
    leading hex digits, so that no task gets a whole shard; each range starts where the ranges before it end. The
    ranges' sizes are shards x SLOT_RANGES rows at most: they are broadcast if these are at most BROADCAST_RANGES.
    """
    digits = len(f"{SLOT_RANGES - 1:x}")
    ranged = rows.withColumn("__order", order).withColumn("__range", F.substring("__order", 1, digits))
    sizes = ranged.groupBy(F.col(shard).alias("__shard"), F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    starts = sizes.selectExpr("__shard", "__of", "sum(__n) OVER (PARTITION BY __shard ORDER BY __of) - __n AS __start")
    starts = F.broadcast(starts) if shards * SLOT_RANGES <= BROADCAST_RANGES else starts
    joined = ranged.join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__range") == F.col("__of")))
    numbered = joined.withColumn("__at", F.expr(f"row_number() OVER (PARTITION BY `{shard}`, __range ORDER BY __order)"))
    return numbered.withColumn(slot, (F.col("__start") + F.col("__at") - 1).cast("long")).drop("__order", "__range", "__shard", "__of", "__n", "__start", "__at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All rows and columns of ``docs`` and their shard, as column ``shard`` (a column of that name is replaced)."""
    return docs.withColumn("shard", shard_of(F.col("doc_id"), shards))


def shard_index(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One slim row for each row of ``docs``: its size, checksum, shard, slot there, and shard after growth by one.

    A row's size is its text's UTF-8 bytes plus 8 for the id.
    """
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = slim.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text_crc32").cast("string"), F.lit("")), "size").cast("binary"))
    return with_slots(placed, "shard", shards, order, "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
