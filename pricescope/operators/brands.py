"""How stores keep to a brand's official prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricescope.functions.numeric import is_valid_price, percent_over

#: Gaps within so many percent count as equal.
TOLERANCE = 0.05


def official_prices(listed: DataFrame) -> DataFrame:
    """Each product's official price: that of its last own source with a valid price, checked or not."""
    own = listed.where(F.col("is_own_store") & is_valid_price(F.col("price")))
    return own.groupBy("product_id").agg(F.max_by("price", F.struct("sort_order", "source_id")).alias("official_price"))


def store_compliance(listed: DataFrame, products: DataFrame, retailers: DataFrame) -> DataFrame:
    """For each brand and store that sells it: listings, stock-outs, and prices below and above the official one.

    The mean gap is rounded with halves toward positive infinity.
    """
    stores = retailers.select("retailer_id", "retailer_name", "domain", "is_brand_store")
    rows = listed.where(~F.col("is_own_store")).join(products.select("product_id", "brand"), "product_id").join(stores, "retailer_id")
    rows = rows.join(official_prices(listed), "product_id", "left")
    out = F.coalesce(F.col("availability") == "out_of_stock", F.lit(False))
    gap = F.when(is_valid_price(F.col("price")) & ~out, percent_over(F.col("price"), F.col("official_price")))
    grouped = rows.withColumn("gap", gap).withColumn("out", out).groupBy("brand", "retailer_id", "retailer_name", "domain", "is_brand_store")
    mean = F.try_divide(F.sum(F.col("gap").cast("decimal(18, 2)")).cast("double"), F.count("gap"))
    return grouped.agg(
        F.count("*").alias("listings"),
        F.count_if("out").alias("out_of_stock"),
        F.count_if(F.col("gap") < -TOLERANCE).alias("below_official"),
        F.count_if(F.col("gap") > TOLERANCE).alias("above_official"),
        (F.floor(mean * 100 + 0.5) / 100).alias("average_gap"),
    )


def brand_list(products: DataFrame, compliance: DataFrame, focus: list[str]) -> DataFrame:
    """One row for each brand: products, stores and sums over stores (brand stores included); focus brands first.

    Brands are numbered in one task, after all sums: they are a list that people look through, thousands at most.
    """
    counted = products.groupBy("brand").agg(F.count("*").alias("product_count"))
    sums = compliance.groupBy("brand").agg(
        F.count("*").alias("store_count"), *[F.sum(c).alias(c) for c in ("below_official", "above_official", "out_of_stock")]
    )
    joined = counted.join(sums, "brand", "left").fillna(0).withColumn("is_focus", F.col("brand").isin(focus))
    return joined.withColumn("place", F.expr("row_number() OVER (ORDER BY is_focus DESC, brand COLLATE UNICODE)"))


def compliance_report(compliance: DataFrame, n: int = 8) -> DataFrame:
    """The stores with most prices below the official one, brand stores left out."""
    below = compliance.where(~F.col("is_brand_store") & (F.col("below_official") > 0))
    return below.orderBy(F.col("below_official").desc(), "retailer_name", "brand").limit(n)


def selected_brand(requests: DataFrame, brands: DataFrame) -> DataFrame:
    """(request_id, selected): none for ``all``, the brand asked for in its known spelling, and the focus brand where none is asked for.

    ``brands`` has name and is_focus, those that have products; a brand that isn't known stays as it is written.
    """
    asked = requests.withColumn("asked", F.nullif(F.trim("brand"), F.lit("")))
    named = asked.join(brands.select("name", F.lower("name").alias("key")), F.lower("asked") == F.col("key"), "left")
    focus = brands.where("is_focus").agg(F.min("name").alias("focus"))
    chosen = F.when(F.lower("asked") == "all", None).when(F.col("asked").isNotNull(), F.coalesce("name", "asked")).otherwise(F.col("focus"))
    return named.join(focus).select("request_id", chosen.alias("selected"))
