"""Lists, counts and top entries: products, retailers, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricescope.session import checkpointed

#: The positions, in the order in which they are shown.
POSITIONS = ["UNDERPRICED", "SLIGHTLY_UNDERPRICED", "MARKET_ALIGNED", "SLIGHTLY_OVERPRICED", "OVERPRICED"]


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("product_id").agg(F.count("*").alias("source_count"))


def retailer_stats(retailers: DataFrame, sources: DataFrame) -> DataFrame:
    """Every retailer with products, last check, failures and successes, and its health; retailers without sources are idle.

    A product counts at the first of its sources at a store, found by sorting, which spills; distinct counts would hold all pairs of a
    store and a product in several hash tables of one task at once.
    """
    first = F.row_number().over(Window.partitionBy("retailer_id", "product_id").orderBy("product_id")) == 1
    stats = sources.withColumn("first", first & F.col("product_id").isNotNull()).groupBy("retailer_id").agg(
        F.count_if("first").alias("product_count"),
        F.max("last_scraped_at").alias("last_scraped_at"),
        F.count_if(F.col("scraping_status") == "failed").alias("failed"),
        F.count_if(F.col("scraping_status") == "success").alias("succeeded"),
    )
    joined = retailers.join(stats, "retailer_id", "left").fillna(0, ["product_count", "failed", "succeeded"])
    failed, good = F.col("failed"), F.col("succeeded")
    health = F.when(failed + good == 0, "idle").when(failed == 0, "healthy").when(good == 0, "failing").otherwise("degraded")
    return joined.withColumn("health", health)


def position_counts(analysis: DataFrame) -> DataFrame:
    """All five positions with their number of products and share; positions without any have 0."""
    counted = analysis.where("status = 'OK' AND position IS NOT NULL").groupBy("position").agg(F.count("*").alias("n"))
    every = analysis.sparkSession.createDataFrame([(p, i) for i, p in enumerate(POSITIONS)], "position string, place int")
    joined = every.join(counted, "position", "left").fillna(0, ["n"])
    return joined.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.expr("sum(n) OVER ()")), F.lit(0.0)))


def attention_list(analysis: DataFrame, products: DataFrame, n: int = 8) -> DataFrame:
    """The products farthest from their market, aligned ones left out: a top-n, never a full sort."""
    far = analysis.where("status = 'OK' AND position <> 'MARKET_ALIGNED'").orderBy(F.abs("gap_percentage").desc(), "product_id").limit(n)
    return far.join(products.select("product_id", "name"), "product_id")


def dashboard(products: DataFrame, retailers: DataFrame, analysis: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of counts."""
    under, over = ["UNDERPRICED", "SLIGHTLY_UNDERPRICED"], ["OVERPRICED", "SLIGHTLY_OVERPRICED"]
    counts = analysis.where("status = 'OK'").agg(
        F.count_if(F.col("position").isin(under)).alias("under"),
        F.count_if(F.col("position").isin(over)).alias("over"),
        F.count_if(F.col("position") == "MARKET_ALIGNED").alias("aligned"),
        F.count("position").alias("compared"),
    )
    # Each side is one row.
    return (
        products.agg(F.count("*").alias("products"))
        .join(retailers.agg(F.count("*").alias("competitors")))
        .join(counts)
        .join(alerts.agg(F.count_if(F.col("status") == "new").alias("new_alerts")))
    )


#: What products can be sorted by.
SORTS = {"name": "lower(name)", "gap": "gap_percentage", "price": "own_price", "checked": "last_checked_at", "median": "market_median"}


def product_list(products: DataFrame, analysis: DataFrame, counts: DataFrame, sort: str = "name", descending: bool = False, position: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of products. Ties go by id in the same direction; nulls come first ascending and last descending."""
    joined = products.join(analysis.select("product_id", "status", "position", "own_price", "market_median", "gap_percentage", "suggested_price"), "product_id", "left")
    if position:
        joined = joined.where(F.col("position") == position)
    keys: list[Column] = [F.expr(SORTS[sort]), F.col("product_id")]
    shown = joined.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]).offset((page - 1) * size).limit(size)
    return shown.join(counts, "product_id", "left").fillna(0, ["source_count"])


def page_summary(rows: DataFrame, size: int = 20) -> DataFrame:
    """The number of rows and of pages (at least one)."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)))


def page_numbers(current: Column, total: Column, radius: int = 1) -> Column:
    """The page numbers to show, as texts: first, last and those near the current one, with a dot sign where some are left out."""
    near = F.sequence(F.greatest(current - radius, F.lit(1)), F.least(current + radius, total))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), total), near)))
    gap = lambda n, i: (i > 0) & (F.get(shown, i - 1) < n - 1)
    return F.transform(shown, lambda n, i: F.concat(F.when(gap(n, i), "… ").otherwise(""), n.cast("string")))


def with_place(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` numbered from 1 in an order without ties, with no task that holds them all.

    Rows are dealt by ranges of the order and sorted there; a range starts where those before it end. The table of ranges has one
    row for each partition. The rows are written before they are dealt: ranges are found by a look at a sample, which would compute them twice.
    """
    ranged = checkpointed(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits count the rows of a partition, the bits above them the partitions.
    held = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    ranges = held.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count("*").alias("__n"))
    starts = ranges.selectExpr("__range", "sum(__n) OVER (ORDER BY __range) - __n AS __start")
    numbered = held.withColumn("__range", F.shiftright("__at", 33)).join(F.broadcast(starts), "__range")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn(name, place.cast("int")).drop("__at", "__range", "__start")
