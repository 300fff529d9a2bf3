"""Price sheets: planning, import, drift against live prices, and audits against store data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions import text, web
from pricescope.functions.numeric import is_valid_price, round_half_up

#: Moves above half are for review; audits allow a cent.
MOST_CHANGE, CENT = 0.5, 0.01


def plan_sheet(stores: DataFrame, cells: DataFrame) -> DataFrame:
    """(row_id, store key, place, outcome, ...) of every filled cell.

    Stores go own first, then as listed. A cell with a price but no address, or with an address that is none, is skipped
    with its reason; a cell without either is nothing. Stores are the columns of a sheet (some hundred at most): they are numbered in one task.
    """
    place = F.expr("row_number() OVER (ORDER BY is_own_store DESC, listed) - 1")
    ordered = stores.withColumn("sort_order", place)
    price = F.when(is_valid_price(F.col("price")), F.col("price"))
    joined = cells.join(ordered, "store_key").withColumn("price", price)
    outcome = F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.when(F.col("price").isNotNull(), "MISSING_URL")).when(web.is_scrapable(F.col("url")), "SOURCE").otherwise("INVALID_URL")
    planned = joined.withColumn("outcome", outcome).where("outcome IS NOT NULL")
    return planned.select("row_id", "store_key", "is_own_store", "sort_order", "outcome", "url", text.domain_of(F.col("url")).alias("domain"), "price", F.when(F.col("out_of_stock"), "out_of_stock").otherwise("unknown").alias("availability"))


def sheet_errors(stores: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """What forbids an import: not exactly one own store, unknown stores, names given twice (regardless of case)."""
    own = stores.agg(F.count_if("is_own_store").alias("n")).where("n <> 1").select(F.lit("OWN_STORES").alias("error"), F.col("n").cast("string").alias("detail"))
    unknown = cells.join(stores, "store_key", "left_anti").select(F.lit("UNKNOWN_STORE").alias("error"), F.col("store_key").alias("detail")).distinct()
    twice = rows.groupBy(F.lower(F.trim("name")).alias("detail")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_NAME").alias("error"), "detail")
    return own.unionByName(unknown).unionByName(twice)


def new_sources(planned: DataFrame, sources: DataFrame) -> DataFrame:
    """Planned sources that the product doesn't have yet, with the status that they start in."""
    fresh = planned.where("outcome = 'SOURCE'").join(sources.select("row_id", "url"), ["row_id", "url"], "left_anti")
    observed = F.col("price").isNotNull() | (F.col("availability") == "out_of_stock")
    return fresh.withColumn("scraping_status", F.when(observed, "success").otherwise("pending")).withColumn("observed_price", F.when(observed, F.coalesce("price", F.lit(0.0))))


def sheet_price(price: Column) -> Column:
    return round_half_up(price * 100) / 100


def drift(cells: DataFrame, live: DataFrame, currency: str) -> DataFrame:
    """Each cell's live price against the sheet: failed, wrong_currency, unchanged, review (a large move) or changed."""
    joined = cells.join(live, "url")
    now, then = sheet_price(F.col("live_price")), F.col("price")
    verdict = (
        F.when(~F.col("success"), "failed")
        .when(F.col("live_currency") != currency, "wrong_currency")
        .when(then.isNotNull() & (now == sheet_price(then)), "unchanged")
        .when(then.isNotNull() & (F.abs(now - then) / then > MOST_CHANGE), "review")
        .otherwise("changed")
    )
    return joined.withColumn("verdict", verdict).withColumn("new_price", F.when(verdict == "changed", now).otherwise(then))


def write_back(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """The sheet's cells with the new prices (url, new_price) of their addresses, in whole cents; others stay."""
    known = prices.groupBy("url").agg(F.max("new_price").alias("new_price"))
    return cells.join(known, "url", "left").withColumn("price", F.coalesce(sheet_price(F.col("new_price")), "price")).drop("new_price")


def keep_status(before: DataFrame, after: DataFrame, transient: list[str]) -> DataFrame:
    """After a failed check for a passing reason, a source that had a price keeps its former status."""
    joined = after.join(before.select("source_id", F.col("scraping_status").alias("status_before")), "source_id", "left")
    keep = (F.col("scraping_status") == "failed") & F.col("error_code").isin(transient) & (F.col("status_before") == "success")
    return joined.withColumn("scraping_status", F.when(keep, "success").otherwise(F.col("scraping_status"))).drop("status_before")


def audit(scraped: DataFrame, truth: DataFrame) -> DataFrame:
    """Each scraped source against the store's own data."""
    joined = scraped.join(truth, "source_id", "left")
    in_stock = F.when(F.col("availability") != "unknown", F.col("availability") != "out_of_stock")
    verdict = (
        F.when(~F.col("success"), "scrape-failed")
        .when(F.col("true_price").isNull(), "unverified")
        .when(F.abs(F.col("true_price") - F.col("price")) > CENT, "price-mismatch")
        .when(in_stock != F.col("truly_in_stock"), "stock-mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("verdict", verdict)
