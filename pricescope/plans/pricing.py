"""Queries of the pricing rules: latest prices, market selection, analysis and comparison."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.functions.numeric import percent_over, round_half_up, round_money, round_percent
from pricescope.operators import pricing
from pricescope.operators.bundle import product_overviews
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, pct, r2, with_layers
from pricescope.session import checkpointed
from pricescope.sources.domain import AS_OF, Domain
from pricescope.sources.layout import drop_table, store_by_source

ANALYSIS_COLUMNS = (
    "product_id currency status reason own_price market_minimum market_maximum market_average market_median versus_minimum versus_maximum versus_average "
    "gap_percentage competitor_count successful_competitor_count cheaper equal more_expensive position suggested_price change_amount change_percentage basis"
).split()


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.latest_per_source(Domain(spark, sf_dir).observations)


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return pricing.pricing_inputs(pricing.with_latest(d.sources, pricing.latest_per_source(d.observations)))


def selection(spark: SparkSession, sf_dir: str, out_of_stock: bool = False) -> DataFrame:
    return pricing.select_market(inputs(spark, sf_dir), out_of_stock)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return pricing.analyse_products(d.sources, d.observations).select(*ANALYSIS_COLUMNS)


def p02_own_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).groupBy("product_id").agg(F.first("own_price").alias("own_price"), F.first("reference_currency").alias("reference_currency"))


def p03_market_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(spark, sf_dir).select("product_id", "source_id", "is_own_store", "price", "currency", "reference_currency", "exclusion")


def p04_market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pricing.market_stats(selection(spark, sf_dir))
    return stats.select("product_id", "competitor_count", "successful_competitor_count", *[round_money(F.col(f"raw_{x}"), F.col("currency")).alias(x) for x in ("minimum", "maximum", "average", "median")])


def p12_competitor_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection(spark, sf_dir).where(~F.col("is_own_store") & F.col("valid"))
    return rows.select("source_id", percent_over(F.col("price"), F.col("own_price")).alias("difference_percentage"))


def p13_comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return pricing.comparison_rows(d.sources, d.retailers, selection(spark, sf_dir))


def p14_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    fresh = pricing.analyse_products(d.sources, d.observations)
    return fresh.withColumnRenamed("currency", "market_currency").join(d.products.select("product_id", "currency"), "product_id").select(
        "product_id", F.coalesce("currency", "market_currency").alias("currency"), "status", "position", "suggested_price"
    )


def p18_with_out_of_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return pricing.analyse_products(d.sources, d.observations, include_out_of_stock=True).select(*ANALYSIS_COLUMNS)


def p16_due_for_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products last checked at least 30 seconds before the moment asked for."""
    as_of = F.to_timestamp(F.lit("2001-10-01 00:00:10"))
    due = F.col("last_checked_at").isNull() | (F.col("last_checked_at") <= as_of - F.expr("INTERVAL 30 SECONDS"))
    return Domain(spark, sf_dir).products.select("product_id", due.alias("due"))


def m01_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") / F.col("l_quantity")
    rows = Domain(spark, sf_dir).table("lineitem").withColumn("currency", F.element_at(F.array(*[F.lit(c) for c in ("USD", "JPY", "KWD")]), (F.col("l_linenumber") % 3 + 1).cast("int")))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "currency", round_money(x, F.col("currency")).alias("amount"), round_percent(x / 3).alias("percent"), round_half_up(x).alias("whole"))


def p17_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's document, its lists as text: sources with prices in cents, and the newest five points of each source in the last year."""
    d = Domain(spark, sf_dir)
    whole = product_overviews(d.products, d.retailers, d.sources, d.observations, datetime.fromisoformat(AS_OF) - timedelta(days=365), newest=5, shown=["price", "exclusion"])
    cents = lambda price: F.coalesce(F.round(price * 100).cast("bigint").cast("string"), F.lit("-"))
    row = lambda r: F.concat_ws(":", r["source_id"], cents(r["price"]), F.coalesce(r["exclusion"], F.lit("-")))
    point = lambda x: F.concat_ws(":", x["source_id"], F.unix_seconds(x["scraped_at"]), cents(x["price"]))
    return whole.select(
        "product_id",
        "product.name",
        "analysis.status",
        "analysis.position",
        "analysis.suggested_price",
        F.array_join(F.transform("rows", row), ",").alias("rows"),
        F.array_join(F.transform("history", point), ",").alias("history"),
    )


def d01_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest observations from a table stored by source."""
    table = f"observations_{uuid.uuid4().hex}"
    stored = store_by_source(Domain(spark, sf_dir).observations, table, buckets=8)
    newest = checkpointed(pricing.latest_per_source(stored))
    drop_table(spark, table)
    return newest


QUERIES = {
    "p17_overview": p17_overview,
    "d01_stored_by_source": d01_stored,
    "d01_latest_observation": latest,
    "p01_source_inputs": inputs,
    "p02_own_source": p02_own_source,
    "p03_market_selection": p03_market_selection,
    "p04_market_stats": p04_market_stats,
    "p05_p11_analysis": analysis,
    "p12_competitor_difference": p12_competitor_difference,
    "p13_comparison_rows": p13_comparison_rows,
    "p14_recompute": p14_recompute,
    "p16_due_for_refresh": p16_due_for_refresh,
    "p18_with_out_of_stock": p18_with_out_of_stock,
    "m01_m02_m03_rounding": m01_rounding,
}

_MARKET = (DOMAIN, LATEST, market())
_SINCE = f"TIMESTAMP '{datetime.fromisoformat(AS_OF) - timedelta(days=365)}'"
_X = "(l_extendedprice / l_quantity)"

ORACLES = {
    "p17_overview": with_layers(
        *_MARKET, ANALYSIS,
        f"""points AS (
  SELECT product_id, source_id, price, scraped_at FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY scraped_at DESC, price DESC) AS place FROM (
      SELECT product_id, source_id, price, scraped_at FROM observations WHERE scraped_at >= {_SINCE} AND price > 0
      UNION ALL SELECT product_id, source_id, price, scraped_at FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY scraped_at DESC, order_key DESC, order_line DESC, price DESC) AS rn FROM observations WHERE scraped_at < {_SINCE}) WHERE rn = 1 AND price > 0))
  WHERE place <= 5)""",
        select="""SELECT p.product_id, name, status, position, suggested_price, coalesce(r.rows, '') AS rows, coalesce(h.history, '') AS history
          FROM products p LEFT JOIN analysis a USING (product_id)
          LEFT JOIN (SELECT product_id, string_agg(source_id || ':' || coalesce(CAST(CAST(round(p * 100) AS BIGINT) AS VARCHAR), '-') || ':' || coalesce(x, '-'), ',' ORDER BY sort_order, source_id) AS rows FROM (
            SELECT product_id, source_id, sort_order, CASE WHEN success AND valid THEN price END AS p, CASE WHEN exclusion <> 'FAILED' THEN exclusion END AS x FROM market JOIN retailers USING (retailer_id)) GROUP BY 1) r USING (product_id)
          LEFT JOIN (SELECT product_id, string_agg(source_id || ':' || CAST(epoch(scraped_at) AS BIGINT) || ':' || CAST(round(price * 100) AS BIGINT), ',' ORDER BY source_id, scraped_at, price) AS history FROM points GROUP BY 1) h USING (product_id)""",
    ),
    "d01_stored_by_source": with_layers(DOMAIN, LATEST, select="SELECT * FROM latest"),
    "d01_latest_observation": with_layers(DOMAIN, LATEST, select="SELECT * FROM latest"),
    "p01_source_inputs": with_layers(*_MARKET, select="SELECT product_id, source_id, retailer_id, is_own_store, sort_order, success, price, currency, availability FROM inputs"),
    "p02_own_source": with_layers(*_MARKET, select="SELECT product_id, any_value(own_price) AS own_price, any_value(reference_currency) AS reference_currency FROM market GROUP BY product_id"),
    "p03_market_selection": with_layers(*_MARKET, select="SELECT product_id, source_id, is_own_store, price, currency, reference_currency, exclusion FROM market"),
    "p04_market_stats": with_layers(
        *_MARKET, select=f"SELECT product_id, competitor_count, n AS successful_competitor_count, {r2('mn')} AS minimum, {r2('mx')} AS maximum, {r2('av')} AS average, {r2('md')} AS median FROM stats"
    ),
    "p05_p11_analysis": with_layers(*_MARKET, ANALYSIS, select="SELECT * FROM analysis"),
    "p12_competitor_difference": with_layers(*_MARKET, select=f"SELECT source_id, {pct('price', 'own_price')} AS difference_percentage FROM market WHERE NOT is_own_store AND valid"),
    "p13_comparison_rows": with_layers(
        *_MARKET,
        select=f"""SELECT s.product_id, s.source_id, retailer_name, s.is_own_store, s.sort_order, p AS price, coalesce(m.currency, reference_currency) AS currency,
          CASE WHEN success THEN coalesce(m.availability, 'unknown') END AS availability, CASE WHEN NOT s.is_own_store THEN {pct("p", "own_price")} END AS difference_percentage,
          CASE WHEN exclusion <> 'FAILED' THEN exclusion END AS exclusion, success AND m.currency IS NULL AND reference_currency IS NOT NULL AS currency_assumed,
          CASE WHEN scraping_status = 'failed' THEN coalesce(last_error, 'Scrape failed') END AS error
        FROM sources s JOIN retailers USING (retailer_id) JOIN (SELECT *, CASE WHEN success AND valid THEN price END AS p FROM market) m USING (source_id)""",
    ),
    "p14_recompute": with_layers(
        *_MARKET, ANALYSIS, select="SELECT product_id, coalesce(p.currency, a.currency) AS currency, status, position, suggested_price FROM analysis a JOIN products p USING (product_id)"
    ),
    "p16_due_for_refresh": with_layers(DOMAIN, select="SELECT product_id, last_checked_at IS NULL OR last_checked_at <= TIMESTAMP '2001-10-01 00:00:10' - INTERVAL 30 SECOND AS due FROM products"),
    "p18_with_out_of_stock": with_layers(DOMAIN, LATEST, market(True), ANALYSIS, select="SELECT * FROM analysis"),
    "m01_m02_m03_rounding": f"""SELECT l_orderkey, l_linenumber, l_suppkey, currency, CASE currency WHEN 'USD' THEN {r2(_X)} WHEN 'JPY' THEN {r2(_X, 0)} ELSE {r2(_X, 3)} END AS amount,
        {r2(f"({_X} / 3)")} AS percent, CAST(floor({_X} + 0.5) AS BIGINT) AS whole
      FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' ELSE 'KWD' END AS currency FROM lineitem)""",
}
