"""Tables laid out for the queries that read them again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store_by_source(observations: DataFrame, table: str, buckets: int) -> DataFrame:
    """Observations as a table of the warehouse, bucketed and sorted by source: what groups or orders them by source reads them without an exchange.

    ``buckets`` is the number of tasks that such a query has: give it so that one holds some hundred MB.
    """
    observations.repartition(buckets, "source_id").write.mode("overwrite").bucketBy(buckets, "source_id").sortBy("source_id", "scraped_at").saveAsTable(table)
    return observations.sparkSession.table(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
