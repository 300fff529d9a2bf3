"""Alert rules over consecutive observations of a source, and over consecutive gaps of a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions.numeric import is_valid_price, percent_over

#: The smallest change of a price that counts, and the gap beyond which a product is clearly off the market.
LEAST_CHANGE = 0.005
GAP_LIMIT = 10.0
ORDER = "scraped_at, order_key, order_line, price"


def with_previous(observations: DataFrame) -> DataFrame:
    """Each observation with the one before it of the same source: one shuffle by source."""
    over = f"OVER (PARTITION BY source_id ORDER BY {ORDER})"
    previous = F.expr(f"lag(struct(price, availability, currency)) {over}")
    return observations.withColumn("previous", previous).withColumn("step", F.expr(f"row_number() {over}"))


def _moved() -> Column:
    before, now = F.col("previous.price"), F.col("price")
    return F.col("previous").isNotNull() & is_valid_price(before) & is_valid_price(now) & (F.abs(now - before) >= LEAST_CHANGE)


def _went() -> Column:
    return F.col("previous").isNotNull() & (F.col("availability") == "out_of_stock") & ~F.col("previous.availability").eqNullSafe("out_of_stock")


def raised(pairs: DataFrame) -> DataFrame:
    """(type, product_id, source_id, step, change_percentage, scraped_at) of price changes and stock-outs: one read of the pairs for both."""
    kinds = F.array_compact(F.array(F.when(_moved(), "PRICE_CHANGE"), F.when(_went(), "OUT_OF_STOCK")))
    found = pairs.where(~F.col("is_own_store")).select("product_id", "source_id", "step", "price", F.col("previous.price").alias("before"), "scraped_at", F.explode(kinds).alias("type"))
    change = F.when(F.col("type") == "PRICE_CHANGE", percent_over(F.col("price"), F.col("before")))
    return found.select("type", "product_id", "source_id", "step", change.alias("change_percentage"), "scraped_at")


def price_changes(pairs: DataFrame) -> DataFrame:
    """Competitors' prices that moved: both valid, by at least half a cent."""
    before, now = F.col("previous.price"), F.col("price")
    return pairs.where(~F.col("is_own_store") & _moved()).select(
        F.lit("PRICE_CHANGE").alias("type"),
        "product_id",
        "source_id",
        "step",
        before.alias("previous_price"),
        now.alias("price"),
        percent_over(now, before).alias("change_percentage"),
        F.coalesce("currency", "previous.currency").alias("currency"),
        "scraped_at",
    )


def stock_outs(pairs: DataFrame) -> DataFrame:
    """Competitors' listings that went out of stock; a first observation is no transition."""
    return pairs.where(~F.col("is_own_store") & _went()).select(
        F.lit("OUT_OF_STOCK").alias("type"),
        "product_id",
        "source_id",
        "step",
        F.lit(None).cast("double").alias("previous_price"),
        "price",
        F.lit(None).cast("double").alias("change_percentage"),
        "currency",
        "scraped_at",
    )


def gap_alerts(gaps: DataFrame, limit: float = GAP_LIMIT) -> DataFrame:
    """Of (product_id, previous_gap, current_gap): those that crossed the limit upward or downward just now."""
    over = (F.col("current_gap") > limit) & ~F.coalesce(F.col("previous_gap") > limit, F.lit(False))
    under = (F.col("current_gap") < -limit) & ~F.coalesce(F.col("previous_gap") < -limit, F.lit(False))
    crossed = gaps.withColumn("type", F.when(over, "OVERPRICED").when(under, "UNDERPRICED"))
    return crossed.where(F.col("type").isNotNull()).select("type", "product_id", "previous_gap", "current_gap")


def with_own_flag(observations: DataFrame, sources: DataFrame) -> DataFrame:
    return observations.join(sources.select("source_id", "is_own_store"), "source_id")


def list_alerts(alerts: DataFrame, products: DataFrame, retailers: DataFrame, status: str = "active", kind: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of alerts, newest first, with names. ``active`` is all but dismissed, ``all`` has no filter. Names are joined after the limit."""
    wanted = F.lit(True) if status == "all" else F.col("status") != "dismissed" if status == "active" else F.col("status") == status
    if kind:
        wanted = wanted & (F.col("type") == kind)
    shown = alerts.where(wanted).orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).offset((page - 1) * size).limit(size)
    named = shown.join(products.select("product_id", F.col("name").alias("product_name")), "product_id", "left")
    return named.join(retailers.select("retailer_id", "retailer_name", "domain"), "retailer_id", "left")


def set_status(alerts: DataFrame, before: str, after: str) -> DataFrame:
    """The table after every alert of one status gets another, with a flag on those that changed."""
    changed = F.col("status") == before
    return alerts.withColumn("changed", changed).withColumn("status", F.when(changed, after).otherwise(F.col("status")))


def unexpired(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows created in the last ``days`` days."""
    return rows.where(F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))
