"""Price-intelligence tables made of the sales tables (part, supplier, lineitem)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The moment that stands for "now" in queries over these tables.
AS_OF = "2001-11-05 00:00:00"


@dataclass
class Domain:
    """A part is a product, a supplier a store, a (part, supplier) pair a listing, a line item a price observation."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").cast("string").alias("size"),
            F.when(key % 5 != 0, F.lit("USD")).alias("currency"),
            F.when(key % 97 == 0, True).when(key % 89 == 0, None).otherwise(False).alias("is_demo"),
            F.expr(f"timestamp'{AS_OF}' - make_interval(0, 0, 0, cast(p_partkey % 400 AS int))").alias("last_checked_at"),
        )

    @cached_property
    def retailers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("retailer_id"),
            F.col("s_name").alias("retailer_name"),
            F.concat(F.lit("shop"), F.col("s_suppkey"), F.lit(".example.com")).alias("domain"),
            (F.col("s_suppkey") % 10 == 0).alias("is_brand_store"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        pairs = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("last"))
        placed = pairs.withColumn("sort_order", F.expr("row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1"))
        source_id = F.col("l_partkey") * 1000000 + F.col("l_suppkey")
        status = F.when(source_id % 17 == 0, "failed").when(source_id % 23 == 0, "pending").otherwise("success")
        return placed.select(
            source_id.alias("source_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("retailer_id"),
            F.concat(F.lit("https://shop"), F.col("l_suppkey"), F.lit(".example.com/p/"), F.col("l_partkey")).alias("url"),
            (F.col("sort_order") == 0).alias("is_own_store"),
            "sort_order",
            status.alias("scraping_status"),
            F.when((status == "failed") & (source_id % 2 == 0), F.lit("Timed out")).alias("last_error"),
            F.when(status != "pending", F.col("last")).alias("last_scraped_at"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        # One price a part: the side is as large as the part table, so Spark chooses how to join.
        prices = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        priced = self.table("lineitem").join(prices, "l_partkey")
        availability = F.when(F.col("l_returnflag") == "R", "out_of_stock").when(F.col("l_returnflag") == "A", "in_stock").otherwise("unknown")
        return priced.select(
            (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("source_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("retailer_id"),
            F.round(F.col("p_retailprice") * (1 - 2 * F.col("l_discount")) * (1 + 2 * F.col("l_tax")), 2).alias("price"),
            F.col("p_retailprice").alias("original_price"),
            F.when(F.col("l_linenumber") == 7, "EUR").when(F.col("l_linenumber") != 6, "USD").alias("currency"),
            availability.alias("availability"),
            F.col("l_shipdate").cast(T.TimestampType()).alias("scraped_at"),
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("order_line"),
        )
