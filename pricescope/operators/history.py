"""Price history: windows of time, what carries into them, and series on common timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricescope.functions.numeric import is_valid_price, percent_over

#: The ranges of days that can be asked for.
RANGES = [7, 30, 90, 182, 365]
POINT = ["product_id", "source_id", "price", "currency", "availability", "scraped_at"]


def carry_in(observations: DataFrame, since: datetime) -> DataFrame:
    """Each source's newest observation strictly before ``since``."""
    newest = F.max_by(F.struct(*[F.col(c) for c in POINT if c != "source_id"]), F.struct("scraped_at", "order_key", "order_line", "price"))
    before = observations.where(F.col("scraped_at") < F.lit(since).cast(T.TimestampType()))
    return before.groupBy("source_id").agg(newest.alias("o")).select(*[F.col("source_id") if c == "source_id" else F.col(f"o.{c}") for c in POINT])


def price_history(observations: DataFrame, since: datetime) -> DataFrame:
    """Valid prices from ``since`` on, and the one that each source carries in. One scan for either side."""
    inside = observations.where(F.col("scraped_at") >= F.lit(since).cast(T.TimestampType())).select(*POINT)
    rows = inside.withColumn("carried", F.lit(False)).unionByName(carry_in(observations, since).withColumn("carried", F.lit(True)))
    return rows.where(is_valid_price(F.col("price")))


def history_of_sources(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Every source with its number of points, first and last price; sources without points are kept."""
    first = F.min_by("price", F.struct("scraped_at", "price"))
    last = F.max_by("price", F.struct("scraped_at", "price"))
    points = history.groupBy("source_id").agg(F.count("*").alias("points"), first.alias("first_price"), last.alias("last_price"))
    return sources.select("product_id", "source_id").join(points, "source_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def step_rows(history: DataFrame, since: datetime, as_of: datetime) -> DataFrame:
    """Points for a step chart: the carried point moves to the start, and the last one is held until ``as_of``."""
    start = F.lit(since).cast(T.TimestampType())
    placed = history.withColumn("scraped_at", F.when(F.col("carried"), start).otherwise(F.col("scraped_at"))).select("source_id", "price", "scraped_at")
    last = placed.groupBy("source_id").agg(F.max_by("price", F.struct("scraped_at", "price")).alias("price"))
    held = last.select("source_id", "price", F.lit(as_of).cast(T.TimestampType()).alias("scraped_at"))
    return placed.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


def versus_own(history: DataFrame, own_sources: DataFrame) -> DataFrame:
    """At each time at which a product's own source has a price: how far every other price of that time lies from it.

    The own series is 0; times without an own price are left out, nothing is interpolated.
    """
    prices = history.where(~F.col("carried")).groupBy("product_id", "source_id", "scraped_at").agg(F.max("price").alias("price"))
    own = prices.join(own_sources, "source_id", "left_semi").select("product_id", "scraped_at", F.col("price").alias("own_price"), F.col("source_id").alias("own_id"))
    joined = prices.join(own, ["product_id", "scraped_at"])
    return joined.select("product_id", "source_id", "scraped_at", F.when(F.col("source_id") == F.col("own_id"), 0.0).otherwise(percent_over(F.col("price"), F.col("own_price"))).alias("versus_own"))
