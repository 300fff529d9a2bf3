"""Where each product's price sits against its market, for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions.numeric import exact_mean, gap_position, is_valid_price, percent_over, round_money, round_percent

OBSERVED = ["price", "original_price", "currency", "availability", "scraped_at"]
#: What of the market's median is suggested in each position; an aligned price is kept.
SUGGESTED_SHARE = {"UNDERPRICED": 0.98, "SLIGHTLY_UNDERPRICED": 0.99, "SLIGHTLY_OVERPRICED": 1.0, "OVERPRICED": 1.02}


def latest_per_source(observations: DataFrame) -> DataFrame:
    """The newest observation of each source, by its own time: a late row never replaces a newer one.

    Ties go to the larger order key, line and price. A hash aggregation with partial results, without a sort.
    """
    return newest_rows(observations, OBSERVED)


def newest_rows(observations: DataFrame, columns: list[str]) -> DataFrame:
    """The newest observation of each source with the columns named; see ``latest_per_source``. With its keys it stands for all that are older."""
    newest = F.max_by(F.struct(*columns), F.struct("scraped_at", "order_key", "order_line", "price"))
    return observations.groupBy("source_id").agg(newest.alias("o")).select("source_id", "o.*")


def with_latest(sources: DataFrame, latest: DataFrame) -> DataFrame:
    """Every source and its newest observation, if any."""
    return sources.join(latest, "source_id", "left")


def pricing_inputs(listed: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """What of a listed source counts for pricing: price, currency and availability only after a successful check; and the columns ``also``."""
    success = (F.col("scraping_status") == "success") & F.col("scraped_at").isNotNull()
    kept = [F.when(F.col("success"), F.col(c)).alias(c) for c in ("price", "currency", "availability")]
    return listed.withColumn("success", F.coalesce(success, F.lit(False))).select("product_id", "source_id", "retailer_id", "is_own_store", "sort_order", "success", *kept, *also)


def select_market(inputs: DataFrame, include_out_of_stock: bool = False) -> DataFrame:
    """Each source with its product's own price, reference currency, and why it is left out of the market (null if not).

    The own source is the product's first own one, usable if checked and valid. The reference currency is the own one,
    or else the most frequent of the competitors checked, the first seen of equally frequent ones. All windows share the
    partitioning by product, so there is one shuffle; those by currency come first, so there is one
    sort; without the repartitioning the planner would shuffle for them by currency, too.
    """
    valid = is_valid_price(F.col("price"))
    own = F.expr("min(CASE WHEN is_own_store THEN struct(sort_order, source_id, success, price, currency) END) OVER (PARTITION BY product_id)")
    usable = F.col("own.success") & is_valid_price(F.col("own.price"))
    counted = F.col("success") & ~F.col("is_own_store") & F.col("currency").isNotNull()
    votes = inputs.repartition("product_id").withColumns(
        {
            "valid": valid,
            "votes": F.when(counted, F.expr("count_if(success AND NOT is_own_store) OVER (PARTITION BY product_id, currency)")),
            "seen": F.when(counted, F.expr("min(CASE WHEN success AND NOT is_own_store THEN sort_order END) OVER (PARTITION BY product_id, currency)")),
        }
    )
    leading = F.expr("max(CASE WHEN votes IS NOT NULL THEN struct(votes, -seen AS first, currency) END) OVER (PARTITION BY product_id)")
    judged = votes.withColumns({"leading": leading, "own": own}).select(
        *inputs.columns,
        "valid",
        F.when(usable, F.col("own.price")).alias("own_price"),
        F.coalesce(F.when(usable, F.col("own.currency")), F.col("leading.currency")).alias("reference_currency"),
    )
    return judged.withColumn("exclusion", exclusion(include_out_of_stock))


def exclusion(include_out_of_stock: bool = False) -> Column:
    """Own sources have none: they aren't part of the market."""
    out_of_stock = F.lit(False) if include_out_of_stock else F.coalesce(F.col("availability") == "out_of_stock", F.lit(False))
    ladder = (
        F.when(~F.col("success") | F.col("price").isNull(), "FAILED")
        .when(out_of_stock, "OUT_OF_STOCK")
        .when(~F.col("valid"), "INVALID_PRICE")
        .when(F.col("currency") != F.col("reference_currency"), "CURRENCY_MISMATCH")
    )
    return F.when(~F.col("is_own_store"), ladder)


def market_stats(market: DataFrame, *more: Column) -> DataFrame:
    """One row for each product: counts, and exact minimum, maximum, mean and median of the included competitors; and what ``more`` aggregates."""
    included = ~F.col("is_own_store") & F.col("exclusion").isNull()
    price = F.when(included, F.col("price"))
    return market.groupBy("product_id").agg(
        F.first("own_price").alias("own_price"),
        F.first("reference_currency").alias("currency"),
        F.count_if(~F.col("is_own_store")).alias("competitor_count"),
        F.count_if(included).alias("successful_competitor_count"),
        F.min(price).alias("raw_minimum"),
        F.max(price).alias("raw_maximum"),
        exact_mean(price).alias("raw_average"),
        F.median(price).alias("raw_median"),
        F.count_if(included & (F.col("price") < F.col("own_price"))).alias("cheaper"),
        F.count_if(included & (F.col("price") == F.col("own_price"))).alias("equal"),
        F.count_if(included & (F.col("price") > F.col("own_price"))).alias("more_expensive"),
        *more,
    )


def analyse(stats: DataFrame, low: float = 5.0, high: float = 10.0, also: tuple[str, ...] = ()) -> DataFrame:
    """Status, rounded market figures, gaps, position and suggestion; and the columns ``also``.

    Gaps compare with the unrounded market; the position is that of the rounded gap; the suggestion is a share of the
    rounded median.
    """
    own, currency, n = F.col("own_price"), F.col("currency"), F.col("successful_competitor_count")
    ok = own.isNotNull() & (n > 0)
    figures = stats.select(
        "product_id",
        "currency",
        F.when(ok, "OK").otherwise("INSUFFICIENT_DATA").alias("status"),
        F.when(own.isNull(), "NO_OWN_PRICE").when(n == 0, "NO_COMPETITOR_PRICES").alias("reason"),
        own.alias("own_price"),
        *[round_money(F.col(f"raw_{x}"), currency).alias(f"market_{x}") for x in ("minimum", "maximum", "average", "median")],
        *[F.when(ok, percent_over(own, F.col(f"raw_{x}"))).alias(f"versus_{x}") for x in ("minimum", "maximum", "average")],
        F.when(ok, percent_over(own, F.col("raw_median"))).alias("gap_percentage"),
        "competitor_count",
        "successful_competitor_count",
        *[F.when(ok, F.col(x)).alias(x) for x in ("cheaper", "equal", "more_expensive")],
        *also,
    )
    placed = figures.withColumn("position", gap_position(F.col("gap_percentage"), low, high))
    share = F.create_map(*[F.lit(x) for pair in SUGGESTED_SHARE.items() for x in pair])
    target = F.coalesce(F.col("market_median") * F.try_element_at(share, F.col("position")), own)
    suggested = placed.withColumn("suggested_price", F.when(F.col("status") == "OK", round_money(target, currency)))
    changed = suggested.withColumn("change_amount", round_money(F.col("suggested_price") - own, currency))
    return changed.withColumn("change_percentage", round_percent(F.try_divide(F.col("change_amount"), own) * 100)).withColumn(
        "basis", F.when(F.col("status") != "OK", None).when(F.col("position") == "MARKET_ALIGNED", "CURRENT_PRICE").otherwise("MARKET_MEDIAN")
    )


def analyse_products(sources: DataFrame, observations: DataFrame, include_out_of_stock: bool = False) -> DataFrame:
    """The whole slice, from observations to suggestions: one row for each product with sources."""
    return analyse_listed(with_latest(sources, latest_per_source(observations)), include_out_of_stock)


def analyse_listed(listed: DataFrame, include_out_of_stock: bool = False) -> DataFrame:
    """The slice from sources with their newest observations on; see ``with_latest``."""
    return analyse(market_stats(select_market(pricing_inputs(listed), include_out_of_stock)))


def comparison_rows(sources: DataFrame, retailers: DataFrame, market: DataFrame) -> DataFrame:
    """One row for each source of a known retailer: its price if checked and valid, its difference from the own price, and notes.

    Excluded rows show their difference as well. A missing currency is noted as assumed; a failed check has an error.
    """
    facts = market.select("source_id", "success", "valid", "price", "currency", "availability", "own_price", "reference_currency", "exclusion")
    joined = sources.join(retailers.select("retailer_id", "retailer_name", "domain"), "retailer_id").join(facts, "source_id")
    return joined.select("product_id", *[c.alias(name) for name, c in compared().items()])


def compared() -> dict[str, Column]:
    """The columns of a comparison row by name, of a source with its market selection and its retailer."""
    price = F.when(F.col("success") & F.col("valid"), F.col("price"))
    return {
        **{c: F.col(c) for c in ("source_id", "retailer_name", "is_own_store", "sort_order")},
        "price": price,
        "currency": F.coalesce("currency", "reference_currency"),
        "availability": F.when(F.col("success"), F.coalesce("availability", F.lit("unknown"))),
        "difference_percentage": F.when(~F.col("is_own_store"), percent_over(price, F.col("own_price"))),
        "exclusion": F.when(F.col("exclusion") != "FAILED", F.col("exclusion")),
        "currency_assumed": F.col("success") & F.col("currency").isNull() & F.col("reference_currency").isNotNull(),
        "error": F.when(F.col("scraping_status") == "failed", F.coalesce("last_error", F.lit("Scrape failed"))),
    }
