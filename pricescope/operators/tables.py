"""Changes to tables as pure functions: the table before goes in, the table after comes out, to be written by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table and those incoming rows whose key it doesn't have, the first by ``order`` of equal keys; ``inserted`` marks them."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    fresh = first.join(table.select(*keys), keys, "left_anti")
    return table.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def upsert(table: DataFrame, incoming: DataFrame, key: str, on_insert: list[str], sticky: list[str]) -> DataFrame:
    """Rows by key: ``on_insert`` columns stay as they were first set, ``sticky`` flags stay true once true."""
    new = incoming.groupBy(key).agg(*[F.first(c, True).alias(f"new_{c}") for c in on_insert], *[F.bool_or(c).alias(f"new_{c}") for c in sticky])
    joined = table.join(new, key, "full_outer")
    kept = [F.coalesce(c, f"new_{c}").alias(c) for c in on_insert]
    flags = [(F.coalesce(c, F.lit(False)) | F.coalesce(f"new_{c}", F.lit(False))).alias(c) for c in sticky]
    return joined.select(key, *kept, *flags)


def delete_cascading(tables: dict[str, DataFrame], key: str, gone: DataFrame, kept: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table that has the key, without the rows that belong to what goes; ``kept`` names tables left alone."""
    return {name: t if name in kept or key not in t.columns else t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def affected(table: DataFrame, key: str, gone: DataFrame, of: str) -> DataFrame:
    """What has to be computed again: the distinct ``of`` among the rows that go."""
    return table.join(gone.select(key).distinct(), key, "left_semi").select(of).distinct()
