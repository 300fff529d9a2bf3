"""The grid of products and stores, in long form; columns are pivoted only for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions.numeric import is_valid_price, percent_over

#: The position names shown to readers.
POSITION_LABELS = {
    "UNDERPRICED": "Underpriced",
    "SLIGHTLY_UNDERPRICED": "Slightly underpriced",
    "MARKET_ALIGNED": "Market aligned",
    "SLIGHTLY_OVERPRICED": "Slightly overpriced",
    "OVERPRICED": "Overpriced",
}
MAX_PRODUCTS = 500
#: Titles of the CSV export's fields before and after its stores.
CSV_FIRST = ["Product", "Brand", "Size", "Currency"]
CSV_LAST = ["Market median", "Gap vs median (%)", "Position", "Suggested price"]


def cell_state() -> Column:
    """A failed source keeps its last price as stale; without one it is failed, or pending if never checked."""
    failed = F.coalesce(F.col("scraping_status") == "failed", F.lit(False))
    seen = F.col("scraped_at").isNotNull()
    return (
        F.when(seen & ~failed & (F.col("availability") == "out_of_stock"), "out_of_stock")
        .when(seen & ~failed, "current")
        .when(seen, "stale")
        .when(failed, "failed")
        .otherwise("pending")
    )


def select_products(products: DataFrame, text: str | None = None, brand: str | None = None, category: str | None = None, demo: bool = True) -> DataFrame:
    """Products whose name or brand contains ``text``, of a brand and category (all regardless of case)."""
    wanted = F.lit(True) if demo else ~F.coalesce(F.col("is_demo"), F.lit(False))
    if text:
        wanted = wanted & (F.contains(F.lower("name"), F.lower(F.lit(text))) | F.coalesce(F.contains(F.lower("brand"), F.lower(F.lit(text))), F.lit(False)))
    if brand:
        wanted = wanted & (F.lower("brand") == F.lower(F.lit(brand)))
    if category:
        wanted = wanted & (F.lower("category") == F.lower(F.lit(category)))
    return products.where(wanted)


def build_cells(products: DataFrame, listed: DataFrame, retailers: DataFrame, analysis: DataFrame) -> DataFrame:
    """One row for each product and store. The first source by sort order wins a cell.

    The lowest current prices of a product are flagged if at least two are current. Differences compare with the product's
    analysed own price. Windows share the partitioning by product.
    """
    known = listed.join(retailers.select("retailer_id", "retailer_name", "domain", "is_brand_store"), "retailer_id")
    facts = analysis.select("product_id", F.col("own_price").alias("stored_own"), F.col("currency").alias("analysed_currency"))
    product = products.select("product_id", "name", F.col("currency").alias("product_currency"))
    joined = known.join(product.join(facts, "product_id", "left"), "product_id")
    first = joined.withColumn("place", F.expr("row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY sort_order, source_id)")).where("place = 1").drop("place")
    price = F.when(is_valid_price(F.col("price")), F.col("price"))
    cells = first.withColumn("state", cell_state()).withColumn("price", price)
    eligible = (F.col("state") == "current") & F.col("price").isNotNull()
    lowest = cells.withColumn("open_price", F.when(eligible, F.col("price"))).withColumns(
        {"lowest": F.expr("min(open_price) OVER (PARTITION BY product_id)"), "open": F.expr("count(open_price) OVER (PARTITION BY product_id)")}
    )
    own = F.when(is_valid_price(F.col("stored_own")), F.col("stored_own"))
    return lowest.select(
        "product_id",
        "retailer_id",
        "retailer_name",
        "is_brand_store",
        "source_id",
        "is_own_store",
        "sort_order",
        "state",
        "price",
        F.coalesce("currency", "analysed_currency", "product_currency").alias("currency"),
        F.when(~F.col("is_own_store"), percent_over(F.col("price"), own)).alias("difference_percentage"),
        F.coalesce((F.col("open") >= 2) & (F.col("open_price") == F.col("lowest")), F.lit(False)).alias("is_lowest"),
        F.when(F.col("state").isin("failed", "stale"), F.coalesce("last_error", F.lit("Last price check failed"))).alias("error"),
    )


def build_columns(cells: DataFrame) -> DataFrame:
    """One row for each store: own stores first, then by mean sort order, then by name.

    Stores are numbered in one task, after all counts: they are the columns of a grid, thousands at most.
    """
    stores = cells.groupBy("retailer_id", "retailer_name", "is_brand_store").agg(
        F.bool_or("is_own_store").alias("is_own_store"), F.count("*").alias("product_count"), F.avg("sort_order").alias("mean_order")
    )
    return stores.withColumn("place", F.expr("row_number() OVER (ORDER BY is_own_store DESC, mean_order, retailer_name COLLATE UNICODE, retailer_id)"))


def sort_categories(categories: DataFrame, first: list[str]) -> DataFrame:
    """(category, place): the lines in ``first`` (upper case) in their order, then the others by name regardless of case."""
    known = F.array_position(F.array(*[F.lit(c) for c in first]), F.upper("category"))
    ranked = categories.withColumn("line", F.when(known > 0, known).otherwise(999))
    return ranked.withColumn("place", F.expr("row_number() OVER (ORDER BY line, category COLLATE UNICODE_CI, category)")).drop("line")


def csv_text(value: Column) -> Column:
    """Empty for null; a leading apostrophe where a spreadsheet would see a formula; quotes where needed."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike('[",\\r\\n]'), quoted).otherwise(safe), F.lit(""))


def csv_number(value: Column) -> Column:
    """The shortest decimal form, without a trailing ``.0``."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(""))


def csv_cell(state: Column, price: Column) -> Column:
    return F.when(state == "out_of_stock", "Out of stock").when(state.isin("current", "stale"), csv_number(price)).otherwise("")


def csv_export(products: DataFrame, cells: DataFrame, analysis: DataFrame) -> DataFrame:
    """(place, line): the header at place 0, then a line for each product by name, with a column for every store of the cells.

    ``products`` are those shown (at most ``MAX_PRODUCTS``), ``cells`` theirs. Stores are never pivoted: a product's texts are
    kept by their column's place, and spread over the number of columns.
    """
    columns = build_columns(cells)
    kind = F.when(F.col("is_brand_store"), " (official price)").otherwise(" (your price)")
    title = csv_text(F.when(F.col("is_own_store"), F.concat("retailer_name", kind)).otherwise(F.col("retailer_name")))
    head = columns.agg(F.count("*").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", title.alias("title")))), lambda c: c["title"]).alias("titles"))
    first, last = (F.array(*[F.lit(x) for x in titles]) for titles in (CSV_FIRST, CSV_LAST))
    header = head.select(F.lit(0).alias("place"), F.array_join(F.concat(first, "titles", last), ",").alias("line"))
    texts = cells.join(columns.select("retailer_id", "place"), "retailer_id").groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("place", csv_cell(F.col("state"), F.col("price"))))).alias("texts")
    )
    facts = analysis.select("product_id", F.col("currency").alias("analysed"), "market_median", "gap_percentage", "position", "suggested_price")
    joined = products.join(texts, "product_id", "left").join(facts, "product_id", "left").crossJoin(F.broadcast(head.select("n")))
    spread = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.try_element_at("texts", i), F.lit("")))
    before, after = csv_ends()
    lines = joined.withColumn("place", F.expr("row_number() OVER (ORDER BY lower(name), product_id)"))
    return header.unionByName(lines.select("place", F.array_join(F.concat(F.array(*before), spread, F.array(*after)), ",").alias("line")))


def csv_ends() -> tuple[list[Column], list[Column]]:
    """A line's fields before and after its stores."""
    labels = F.create_map(*[F.lit(x) for pair in POSITION_LABELS.items() for x in pair])
    before = [csv_text(F.col("name")), csv_text(F.col("brand")), csv_text(F.col("size")), csv_text(F.coalesce("analysed", "currency"))]
    after = [csv_number(F.col("market_median")), csv_number(F.col("gap_percentage")), csv_text(F.try_element_at(labels, F.col("position"))), csv_number(F.col("suggested_price"))]
    return before, after
