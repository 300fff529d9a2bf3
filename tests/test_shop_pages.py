"""Sales that pages show against structured prices, and runs that fail."""

from pyspark.sql import functions as F

from pricescope.operators import pages, runs
from pricescope.operators.page_prices import analyze_pages

BLOCK = '<div class="product__block--price">{}</div>'
LD = '<script type="application/ld+json">{{"@type": "Product", "offers": {{"price": "{}", "priceCurrency": "USD", "availability": "InStock"}}}}</script>'
CASES = [
    # A sale with its former price, which is the structured one.
    (1, LD.format(100) + BLOCK.format('<div class="price--on-sale"><s>$100.00</s><b class="price-item--sale">$80.00</b></div>'), 80.0, 100.0),
    # A former price that isn't the structured one: nothing is known.
    (2, LD.format(100) + BLOCK.format('<s>$150.00</s><ins>$80.00</ins>'), 100.0, None),
    # An explicit sale without a former price.
    (3, LD.format(100) + BLOCK.format('<b class="price-item--sale">$80.00</b>'), 80.0, 100.0),
    # The same in an <ins> alone isn't explicit.
    (4, LD.format(100) + BLOCK.format("<ins>$80.00</ins>"), 100.0, None),
    # Other products' cards and drawers don't count.
    (5, LD.format(100) + '<div class="related">' + BLOCK.format('<b class="price-item--sale">$80.00</b>') + "</div>", 100.0, None),
    # The structured price is the sale.
    (6, LD.format(80) + '<p class="summary"><span class="price"><del>$100</del> <ins>$80</ins></span></p>', 80.0, 100.0),
    # Former prices are five times the sale at most, and never below it.
    (7, LD.format(80) + BLOCK.format("<del>$1000</del><del>$10</del><del>$90</del><ins>$80</ins>"), 80.0, 90.0),
    (8, LD.format(100) + BLOCK.format('<b class="price-item--sale price-was">$80.00</b>'), 100.0, None),
    (9, LD.format(100) + "<div><ins>$80", 100.0, None),
]


def test_displayed_sales(spark):
    rows = spark.createDataFrame([(i, "https://shop.com/" + str(i), f"<html><head><title>Oil</title></head><body><h1>A good oil</h1>{h}</body></html>") for i, h, _, _ in CASES], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["price"], r["original_price"]) for r in analyze_pages(pages.snapshots(rows)).collect()}
    assert got == {i: (price, former) for i, _, price, former in CASES}


def test_pages_of_nothing(spark):
    rows = spark.createDataFrame([(1, "https://a.com", None, None), (2, None, "", 500), (3, "https://a.com", "<p>some words that are no price</p>", 200)], "page_id bigint, url string, html string, http_status int")
    got = {r["page_id"]: r["problem"] for r in analyze_pages(pages.snapshots(rows)).collect()}
    assert got[2] == "UNAVAILABLE" and got[3] == "PRICE_NOT_FOUND" and set(got) == {1, 2, 3}
    assert analyze_pages(pages.snapshots(rows.limit(0))).count() == 0
    assert pages.product_info(pages.snapshots(rows)).count() == 3


def test_a_run_without_success(spark):
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    products = spark.createDataFrame([(1, "Oil", None, "USD", False), (2, "Demo", "B", None, True)], "product_id bigint, name string, brand string, currency string, is_demo boolean")
    sources = spark.createDataFrame([(10, 1, 5, True, 0, "success"), (11, 1, 6, False, 1, "success"), (20, 2, 5, True, 0, "pending")], "source_id bigint, product_id bigint, retailer_id bigint, is_own_store boolean, sort_order int, scraping_status string")
    sources = sources.withColumns({"last_error": F.lit(None).cast("string"), "last_scraped_at": at})
    observations = spark.createDataFrame([(10, 1, 5, 9.0), (11, 1, 6, 10.0)], "source_id bigint, product_id bigint, retailer_id bigint, price double")
    observations = observations.withColumns({"original_price": F.lit(None).cast("double"), "currency": F.lit("USD"), "availability": F.lit("in_stock"), "scraped_at": at, "order_key": F.lit(1).cast("bigint"), "order_line": F.lit(1)})
    found = spark.createDataFrame([(i, False) for i in (10, 11, 20)], "source_id bigint, success boolean")
    empty = {c: F.lit(None).cast(k) for c, k in (("price", "double"), ("original_price", "double"), ("currency", "string"), ("availability", "string"), ("brand", "string"), ("image_url", "string"))}
    run = runs.compare_run(products, sources, observations, found.withColumns(empty).withColumns({"error": F.lit("Timed out"), "error_code": F.lit("TIMEOUT"), "scraped_at": at}))
    assert [tuple(r) for r in run.counts.collect()] == [(1, 2, 0, 2, 0)]
    assert run.observations.count() == 2
    assert {r["source_id"]: (r["scraping_status"], r["last_error"]) for r in run.sources.collect()} == {10: ("failed", "Timed out"), 11: ("failed", "Timed out"), 20: ("pending", None)}
    assert {r["product_id"]: (r["brand"], r["currency"]) for r in run.products.collect()} == {1: (None, "USD"), 2: ("B", None)}
