"""Queries of the product and store grid, lists, dashboard, brands and opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.operators import brands, listing, matrix, opportunities, pricing
from pricescope.plans import history
from pricescope.plans.history import _PAIRS
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, pct, with_layers
from pricescope.session import checkpointed
from pricescope.sources.domain import Domain

FOCUS = ["Brand#23"]


def _listed(d: Domain) -> DataFrame:
    return pricing.with_latest(d.sources, pricing.latest_per_source(d.observations))


def _analysis(d: Domain) -> DataFrame:
    return pricing.analyse_products(d.sources, d.observations)


def _cells(d: Domain) -> DataFrame:
    return matrix.build_cells(d.products, _listed(d), d.retailers, _analysis(d))


def q07_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(Domain(spark, sf_dir)).drop("is_brand_store")


def q06_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(Domain(spark, sf_dir)).groupBy(matrix.cell_state().alias("state")).agg(F.count("*").alias("n"))


def q08_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.build_columns(_cells(Domain(spark, sf_dir))).drop("mean_order")


def q09_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = matrix.select_products(Domain(spark, sf_dir).products, text="a", demo=False)
    capped = chosen.orderBy(F.lower("name"), "product_id").limit(matrix.MAX_PRODUCTS + 1)
    return capped.select("product_id", "name", "brand")


def g03_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = matrix.select_products(Domain(spark, sf_dir).products, demo=False).limit(matrix.MAX_PRODUCTS + 1)
    return chosen.agg(F.least(F.count("*"), F.lit(matrix.MAX_PRODUCTS)).alias("shown"), (F.count("*") > matrix.MAX_PRODUCTS).alias("truncated"))


def g05_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sort_categories(Domain(spark, sf_dir).products.select("category").distinct(), ["STANDARD", "ECONOMY"])


def x01_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole CSV export: header and lines of the products shown (the first 500 by name), with all their stores."""
    d = Domain(spark, sf_dir)
    shown = matrix.select_products(d.products, demo=False).orderBy(F.lower("name"), "product_id").limit(matrix.MAX_PRODUCTS)
    analysis = _analysis(d)
    return matrix.csv_export(shown, matrix.build_cells(shown, _listed(d), d.retailers, analysis), analysis)


def q10_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return listing.product_list(d.products, _analysis(d), listing.source_counts(d.sources), sort="gap", descending=True, page=3).drop("last_checked_at")


def b12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_summary(matrix.select_products(Domain(spark, sf_dir).products, brand="brand#12"))


def d02_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.source_counts(Domain(spark, sf_dir).sources)


def q11_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of one product, with its store and newest observation."""
    d = Domain(spark, sf_dir)
    rows = _listed(d).where("product_id = 7").join(d.retailers, "retailer_id")
    return rows.select("product_id", "source_id", "retailer_name", "domain", "sort_order", "price", "availability", "scraped_at")


def q12_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return listing.dashboard(d.products, d.retailers, _analysis(d), history.alert_table(spark, sf_dir))


def d05_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.position_counts(_analysis(Domain(spark, sf_dir)))


def g02_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return listing.attention_list(_analysis(d), d.products).select("product_id", "name", "gap_percentage", "position")


def q13_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return listing.retailer_stats(d.retailers, d.sources)


def r01_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.official_prices(_listed(Domain(spark, sf_dir)))


def _compliance(d: Domain, listed: DataFrame | None = None) -> DataFrame:
    shown = matrix.select_products(d.products, demo=False)
    return brands.store_compliance(_listed(d) if listed is None else listed, shown, d.retailers)


def r02_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compliance(Domain(spark, sf_dir))


def r03_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return brands.brand_list(matrix.select_products(d.products, demo=False), _compliance(d), FOCUS)


def r04_brand_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of one brand."""
    d = Domain(spark, sf_dir)
    chosen = matrix.select_products(d.products, brand="BRAND#23", demo=False)
    return matrix.build_cells(chosen, _listed(d), d.retailers, _analysis(d)).select("product_id", "retailer_id", "state", "price", "difference_percentage", "is_lowest")


def v05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.compliance_report(_compliance(Domain(spark, sf_dir))).select("brand", "retailer_id", "below_official", "listings")


def _listings(d: Domain, listed: DataFrame | None = None) -> DataFrame:
    return opportunities.resolve_listings(_listed(d) if listed is None else listed, d.products, d.retailers, d.sources)


def _shelf(d: Domain, listed: DataFrame | None = None) -> opportunities.Shelf:
    """Listings are written once: what is made of a shelf reads them several times."""
    return opportunities.build_shelf(checkpointed(_listings(d, listed)), d.products)


def o01_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listings(Domain(spark, sf_dir))


def o02_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return opportunities.reference_retailers(d.sources, d.products, d.retailers)


def o04_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shelf(Domain(spark, sf_dir)).stock


def o05_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's brands, one row each (thousands at most), numbered in one task."""
    counted = Domain(spark, sf_dir).products.groupBy("brand").agg(F.count("*").alias("product_count"))
    return counted.withColumn("is_focus", F.col("brand").isin(FOCUS)).withColumn("place", F.expr("row_number() OVER (ORDER BY is_focus DESC, brand COLLATE UNICODE)"))


def o08_restocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.restocks(_shelf(Domain(spark, sf_dir)))


def o09_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New listings: counted by brand, store and tone, as there are as many as gaps in the grid."""
    groups = opportunities.pitch_groups(_shelf(Domain(spark, sf_dir)))
    return groups.groupBy("brand", "retailer_id", "tone").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("in_stock_stores")).alias("in_stock_stores"))


def o09_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of new listings, cut to its first 200."""
    d = Domain(spark, sf_dir)
    return opportunities.first_pitches(_shelf(d), d.products, d.retailers).select("brand", "retailer_id", "product_id", "tone", "in_stock_stores", "store_missing")


def o10_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.store_briefs(_shelf(Domain(spark, sf_dir)))


def o11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.summary(_shelf(Domain(spark, sf_dir)))


def g07_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return opportunities.rank_opportunities(opportunities.restocks(_shelf(d)), d.products, d.retailers).select("product_id", "retailer_id", "rank", "in_stock_stores")


def e10_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.store_cards(opportunities.restocks(_shelf(Domain(spark, sf_dir)))).select("brand", "retailer_id", "product_id", "place")


def o06_unopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.unopened_products(_shelf(Domain(spark, sf_dir))).select("product_id", "brand")


def o07_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All doors; the overview shows the first of them."""
    return opportunities.every_door(_shelf(Domain(spark, sf_dir))).select("brand", "retailer_id", "catalog_size", "other_brand_listings")


def g08_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All briefs in the order in which they are shown."""
    d = Domain(spark, sf_dir)
    return opportunities.ordered_briefs(_shelf(d), d.retailers).select("place", "brand", "retailer_id", "covered")


def o13_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return opportunities.overview(_shelf(d), d.products, d.retailers)


QUERIES = {
    "q06_cell_states": q06_states,
    "q07_e01_e03_matrix_cells": q07_cells,
    "q08_g06_matrix_columns": q08_columns,
    "q09_b02_matrix_products": q09_select,
    "g03_truncation": g03_truncation,
    "g05_a04_categories": g05_categories,
    "x01_x03_csv_export": x01_csv,
    "q10_g01_product_list": q10_products,
    "b12_b03_page_summary": b12_pages,
    "d02_source_counts": d02_source_counts,
    "q11_c01_product_detail": q11_detail,
    "q12_a03_dashboard": q12_dashboard,
    "d05_q15_position_counts": d05_positions,
    "g02_attention_list": g02_attention,
    "q13_d03_d04_retailers": q13_retailers,
    "r01_official_price": r01_official,
    "r02_d11_store_compliance": r02_compliance,
    "r03_d12_brand_list": r03_brands,
    "r04_brand_detail": r04_brand_detail,
    "v05_compliance_report": v05_report,
    "o01_o03_e02_listings": o01_listings,
    "o02_reference_retailers": o02_reference,
    "o04_shelf": o04_shelf,
    "o05_g18_brand_catalog": o05_catalog,
    "o06_unopened_products": o06_unopened,
    "o07_unopened_doors": o07_doors,
    "o08_restocks": o08_restocks,
    "o09_c07_pitches": o09_pitches,
    "o09_first_pitches": o09_first,
    "g08_brief_order": g08_briefs,
    "o13_overview": o13_overview,
    "o10_store_briefs": o10_briefs,
    "o11_summary": o11_summary,
    "g07_g09_ranked_restocks": g07_ranked,
    "e10_store_cards": e10_cards,
}

_ALL = (DOMAIN, LATEST, market(), ANALYSIS)
_STATE = """CASE WHEN scraped_at IS NOT NULL AND scraping_status <> 'failed' THEN CASE WHEN availability = 'out_of_stock' THEN 'out_of_stock' ELSE 'current' END
  WHEN scraped_at IS NOT NULL THEN 'stale' WHEN scraping_status = 'failed' THEN 'failed' ELSE 'pending' END"""
_CELLS = f"""
cells AS (
  SELECT product_id, retailer_id, retailer_name, is_brand_store, source_id, is_own_store, sort_order, state, price, currency,
    CASE WHEN NOT is_own_store THEN {pct("price", "own_price")} END AS difference_percentage,
    coalesce(count(op) OVER (PARTITION BY product_id) >= 2 AND op = min(op) OVER (PARTITION BY product_id), FALSE) AS is_lowest,
    CASE WHEN state IN ('failed', 'stale') THEN coalesce(last_error, 'Last price check failed') END AS error
  FROM (SELECT *, CASE WHEN state = 'current' AND price IS NOT NULL THEN price END AS op FROM (
    SELECT l.product_id, l.retailer_id, retailer_name, is_brand_store, source_id, is_own_store, sort_order, last_error, {_STATE} AS state,
      CASE WHEN l.price > 0 THEN l.price END AS price, coalesce(l.currency, a.currency, p.currency) AS currency, CASE WHEN a.own_price > 0 THEN a.own_price END AS own_price,
      row_number() OVER (PARTITION BY l.product_id, l.retailer_id ORDER BY sort_order, source_id) AS rn
    FROM listed l JOIN retailers USING (retailer_id) JOIN products p ON p.product_id = l.product_id LEFT JOIN analysis a ON a.product_id = l.product_id) WHERE rn = 1))"""
_COMPLIANCE = f"""
official AS (
  SELECT product_id, max_by(price, (sort_order, source_id)) AS official_price FROM listed WHERE is_own_store AND price > 0 GROUP BY product_id),
compliance AS (
  SELECT brand, retailer_id, retailer_name, domain, is_brand_store, count(*) AS listings, count(*) FILTER (o) AS out_of_stock,
    count(*) FILTER (gap < -0.05) AS below_official, count(*) FILTER (gap > 0.05) AS above_official,
    floor(CAST(sum(CAST(gap AS DECIMAL(18, 2))) AS DOUBLE) / nullif(count(gap), 0) * 100 + 0.5) / 100 AS average_gap
  FROM (SELECT *, CASE WHEN price > 0 AND NOT o THEN {pct("price", "official_price")} END AS gap FROM (
    SELECT brand, r.*, price, official_price, coalesce(availability = 'out_of_stock', FALSE) AS o
    FROM listed l JOIN products p USING (product_id) JOIN retailers r USING (retailer_id) LEFT JOIN official USING (product_id)
    WHERE NOT is_own_store AND NOT coalesce(is_demo, FALSE)))
  GROUP BY ALL)"""
_SHELF = """
reference AS (
  SELECT retailer_id FROM retailers LEFT JOIN (SELECT retailer_id, bool_and(is_own_store) AS all_own FROM sources GROUP BY retailer_id) USING (retailer_id) WHERE is_brand_store OR coalesce(all_own, FALSE)),
resolved AS (
  SELECT product_id, retailer_id, brand, state, price, official FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY CASE state WHEN 'in_stock' THEN 2 WHEN 'out_of_stock' THEN 1 ELSE 0 END DESC, price IS NOT NULL DESC, sort_order, source_id) AS rn
    FROM (SELECT product_id, retailer_id, source_id, sort_order, brand, CASE WHEN price > 0 THEN price END AS price, is_own_store OR retailer_id IN (SELECT retailer_id FROM reference) AS official,
        CASE WHEN scraped_at IS NULL OR scraping_status = 'failed' THEN 'unknown' WHEN availability = 'out_of_stock' THEN 'out_of_stock'
          WHEN price > 0 OR availability IN ('in_stock', 'limited') THEN 'in_stock' ELSE 'unknown' END AS state
      FROM listed JOIN products USING (product_id))) WHERE rn = 1),
stock AS (
  SELECT product_id, count(*) FILTER (state = 'in_stock') AS in_stock_stores,
    count(*) FILTER (official AND state = 'out_of_stock') > 0 AND count(*) FILTER (official AND state = 'in_stock') = 0 AS official_out FROM resolved GROUP BY product_id),
partners AS (SELECT brand, retailer_id, count(*) AS listed FROM resolved WHERE NOT official GROUP BY ALL),
sized AS (SELECT * FROM partners JOIN (SELECT brand, count(*) AS catalog_size FROM products GROUP BY brand) USING (brand)),
restocks AS (
  SELECT brand, retailer_id, product_id, in_stock_stores, CASE WHEN in_stock_stores = 0 THEN 'supply_gap' WHEN official_out THEN 'confirm_supply' ELSE 'ready' END AS tone,
    CASE WHEN in_stock_stores = 0 THEN 0 WHEN official_out THEN 1 ELSE 2 END AS rank, catalog_size - listed AS store_missing
  FROM resolved JOIN stock USING (product_id) JOIN sized USING (brand, retailer_id) WHERE NOT official AND state = 'out_of_stock'),
pitches AS (
  SELECT brand, retailer_id, product_id, in_stock_stores, CASE WHEN official_out THEN 'confirm_supply' ELSE 'ready' END AS tone
  FROM sized JOIN products USING (brand) JOIN stock USING (product_id)
  WHERE in_stock_stores > 0 AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.product_id = products.product_id AND r.retailer_id = sized.retailer_id)),
briefs AS (
  SELECT brand, retailer_id, catalog_size, listed, in_stock, out_of_stock, catalog_size - listed AS missing, coalesce(n, 0) AS pitches, coalesce(act, 0) AS actionable_restocks,
    CAST(floor(listed / catalog_size * 100 + 0.5) AS BIGINT) AS coverage_percentage, out_of_stock = 0 AND coalesce(n, 0) = 0 AS covered
  FROM sized JOIN (SELECT brand, retailer_id, count(*) FILTER (state = 'in_stock') AS in_stock, count(*) FILTER (state = 'out_of_stock') AS out_of_stock FROM resolved WHERE NOT official GROUP BY ALL) USING (brand, retailer_id)
  LEFT JOIN (SELECT brand, retailer_id, count(*) AS n FROM pitches GROUP BY ALL) USING (brand, retailer_id)
  LEFT JOIN (SELECT brand, retailer_id, count(*) AS act FROM restocks WHERE tone <> 'supply_gap' GROUP BY ALL) USING (brand, retailer_id)),
unopened AS (
  SELECT product_id, brand FROM products JOIN stock USING (product_id) WHERE in_stock_stores > 0 AND product_id NOT IN (SELECT product_id FROM resolved WHERE NOT official))"""
_S = (DOMAIN, LATEST, _SHELF)
_DOORS = """
doors AS (
  SELECT brand, retailer_id, retailer_name, catalog_size, other_brand_listings FROM (SELECT retailer_id, CAST(sum(listed) AS BIGINT) AS other_brand_listings FROM partners GROUP BY 1) s
    JOIN retailers USING (retailer_id), (SELECT brand, count(*) AS catalog_size FROM products GROUP BY brand) c
  WHERE NOT EXISTS (SELECT 1 FROM partners p WHERE p.brand = c.brand AND p.retailer_id = s.retailer_id))"""
_LISTS = """
first_restocks AS (
  SELECT *, row_number() OVER (ORDER BY rank DESC, in_stock_stores DESC, store_missing DESC, lower(name), retailer_name, product_id, retailer_id) AS place
  FROM restocks JOIN (SELECT product_id, name FROM products) USING (product_id) JOIN (SELECT retailer_id, retailer_name FROM retailers) USING (retailer_id)),
first_pitches AS (
  SELECT *, row_number() OVER (ORDER BY tone DESC, in_stock_stores DESC, store_missing DESC, lower(name), retailer_name, product_id, retailer_id) AS place
  FROM pitches JOIN (SELECT brand, retailer_id, catalog_size - listed AS store_missing FROM sized) USING (brand, retailer_id)
    JOIN (SELECT product_id, name FROM products) USING (product_id) JOIN (SELECT retailer_id, retailer_name FROM retailers) USING (retailer_id)),
placed_briefs AS (
  SELECT *, row_number() OVER (ORDER BY covered, actionable_restocks DESC, pitches DESC, out_of_stock DESC, retailer_name, brand) AS place FROM briefs JOIN (SELECT retailer_id, retailer_name FROM retailers) USING (retailer_id))"""
_OVERVIEW = """
SELECT CASE WHEN covered THEN 'covered_stores' ELSE 'stores' END AS list, row_number() OVER (PARTITION BY covered ORDER BY place) AS place, brand, retailer_id, NULL AS product_id, NULL AS tone,
  CASE WHEN covered THEN catalog_size ELSE pitches END AS value FROM placed_briefs
UNION ALL SELECT 'restocks', place, brand, retailer_id, product_id, tone, in_stock_stores FROM first_restocks WHERE place <= 200
UNION ALL SELECT 'new_listings', place, brand, retailer_id, product_id, tone, in_stock_stores FROM first_pitches WHERE place <= 200
UNION ALL SELECT * FROM (SELECT 'unopened_products', row_number() OVER (ORDER BY lower(name), brand, product_id) AS n, brand, NULL, product_id, NULL, NULL FROM unopened JOIN (SELECT product_id, name FROM products) USING (product_id)) WHERE n <= 12
UNION ALL SELECT * FROM (SELECT 'unopened_doors', row_number() OVER (ORDER BY other_brand_listings DESC, retailer_name, brand) AS n, brand, retailer_id, NULL, NULL, other_brand_listings FROM doors) WHERE n <= 20
UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, * FROM (
  SELECT 'restocks', count(*) FROM restocks UNION ALL SELECT 'new_listings', count(*) FROM pitches UNION ALL SELECT 'stores_with_gaps', count(*) FROM briefs WHERE NOT covered
  UNION ALL SELECT 'unopened_products', count(*) FROM unopened UNION ALL SELECT 'unopened_doors', count(*) FROM doors UNION ALL SELECT 'products', count(*) FROM products
  UNION ALL SELECT 'partner_stores', count(DISTINCT retailer_id) FROM partners
  UNION ALL SELECT 'restocks_truncated', CAST(count(*) > 200 AS BIGINT) FROM restocks UNION ALL SELECT 'new_listings_truncated', CAST(count(*) > 200 AS BIGINT) FROM pitches)"""
_C = (DOMAIN, LATEST, _COMPLIANCE)
_T = "coalesce(regexp_replace(CAST({0} AS VARCHAR), '\\.0$', ''), '')"

ORACLES = {
    "q06_cell_states": with_layers(DOMAIN, LATEST, select=f"SELECT {_STATE} AS state, count(*) AS n FROM listed GROUP BY 1"),
    "q07_e01_e03_matrix_cells": with_layers(*_ALL, _CELLS, select="SELECT * EXCLUDE (is_brand_store) FROM cells"),
    "q08_g06_matrix_columns": with_layers(
        *_ALL,
        _CELLS,
        select="""SELECT retailer_id, retailer_name, is_brand_store, is_own_store, product_count, row_number() OVER (ORDER BY is_own_store DESC, m, retailer_name, retailer_id) AS place
          FROM (SELECT retailer_id, retailer_name, is_brand_store, bool_or(is_own_store) AS is_own_store, count(*) AS product_count, avg(sort_order) AS m FROM cells GROUP BY ALL)""",
    ),
    "q09_b02_matrix_products": with_layers(
        DOMAIN, select="SELECT product_id, name, brand FROM products WHERE NOT coalesce(is_demo, FALSE) AND (contains(lower(name), 'a') OR contains(lower(brand), 'a')) ORDER BY lower(name), product_id LIMIT 501"
    ),
    "g03_truncation": with_layers(DOMAIN, select="SELECT least(count(*), 500) AS shown, count(*) > 500 AS truncated FROM products WHERE NOT coalesce(is_demo, FALSE)"),
    "g05_a04_categories": with_layers(DOMAIN, select="SELECT category, row_number() OVER (ORDER BY CASE upper(category) WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 999 END, lower(category), category) AS place FROM (SELECT DISTINCT category FROM products)"),
    "x01_x03_csv_export": with_layers(
        *_ALL,
        _CELLS,
        "shown AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY lower(name), product_id) AS line_place FROM products WHERE NOT coalesce(is_demo, FALSE)) WHERE line_place <= 500)",
        "shown_cells AS (SELECT * FROM cells WHERE product_id IN (SELECT product_id FROM shown))",
        """stores AS (SELECT *, row_number() OVER (ORDER BY own DESC, m, retailer_name, retailer_id) AS column_place
          FROM (SELECT retailer_id, retailer_name, is_brand_store, bool_or(is_own_store) AS own, avg(sort_order) AS m FROM shown_cells GROUP BY ALL))""",
        f"""texts AS (SELECT product_id, string_agg(coalesce(t, ''), ',' ORDER BY column_place) AS t FROM (SELECT s.product_id, column_place,
            CASE WHEN state = 'out_of_stock' THEN 'Out of stock' WHEN state IN ('current', 'stale') THEN {_T.format("price")} ELSE '' END AS t
          FROM shown s CROSS JOIN stores LEFT JOIN shown_cells c ON c.product_id = s.product_id AND c.retailer_id = stores.retailer_id) GROUP BY product_id)""",
        select=f"""SELECT 0 AS place, 'Product,Brand,Size,Currency,' || string_agg(retailer_name || CASE WHEN NOT own THEN '' WHEN is_brand_store THEN ' (official price)' ELSE ' (your price)' END, ',' ORDER BY column_place)
            || ',Market median,Gap vs median (%),Position,Suggested price' AS line FROM stores
          UNION ALL SELECT line_place, concat_ws(',', coalesce(name, ''), coalesce(brand, ''), coalesce(size, ''), coalesce(a.currency, p.currency, ''), t,
            {_T.format("market_median")}, {_T.format("gap_percentage")},
            CASE position WHEN 'UNDERPRICED' THEN 'Underpriced' WHEN 'SLIGHTLY_UNDERPRICED' THEN 'Slightly underpriced' WHEN 'MARKET_ALIGNED' THEN 'Market aligned'
              WHEN 'SLIGHTLY_OVERPRICED' THEN 'Slightly overpriced' WHEN 'OVERPRICED' THEN 'Overpriced' ELSE '' END, {_T.format("suggested_price")})
          FROM shown p LEFT JOIN analysis a USING (product_id) LEFT JOIN texts USING (product_id)""",
    ),
    "q10_g01_product_list": with_layers(
        *_ALL,
        select="""SELECT p.product_id, name, brand, category, size, p.currency, is_demo, status, position, own_price, market_median, gap_percentage, suggested_price, source_count
          FROM products p LEFT JOIN analysis a USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS source_count FROM sources GROUP BY 1) USING (product_id)
          ORDER BY gap_percentage DESC NULLS LAST, product_id DESC LIMIT 20 OFFSET 40""",
    ),
    "b12_b03_page_summary": with_layers(DOMAIN, select="SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 20) AS BIGINT), 1) AS pages FROM products WHERE lower(brand) = 'brand#12'"),
    "d02_source_counts": with_layers(DOMAIN, select="SELECT product_id, count(*) AS source_count FROM sources GROUP BY 1"),
    "q11_c01_product_detail": with_layers(DOMAIN, LATEST, select="SELECT product_id, source_id, retailer_name, domain, sort_order, price, availability, scraped_at FROM listed JOIN retailers USING (retailer_id) WHERE product_id = 7"),
    "q12_a03_dashboard": with_layers(
        *_ALL,
        _PAIRS,
        select="""SELECT (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM retailers) AS competitors, count(*) FILTER (position IN ('UNDERPRICED', 'SLIGHTLY_UNDERPRICED')) AS under,
            count(*) FILTER (position IN ('OVERPRICED', 'SLIGHTLY_OVERPRICED')) AS over, count(*) FILTER (position = 'MARKET_ALIGNED') AS aligned, count(position) AS compared,
            (SELECT count(*) FROM alerts WHERE status = 'new') AS new_alerts FROM analysis WHERE status = 'OK'""",
    ),
    "d05_q15_position_counts": with_layers(
        *_ALL,
        select="""SELECT position, place, coalesce(n, 0) AS n, coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (), 0), 0) AS share
          FROM (VALUES ('UNDERPRICED', 0), ('SLIGHTLY_UNDERPRICED', 1), ('MARKET_ALIGNED', 2), ('SLIGHTLY_OVERPRICED', 3), ('OVERPRICED', 4)) e(position, place)
          LEFT JOIN (SELECT position, count(*) AS n FROM analysis WHERE status = 'OK' GROUP BY 1) USING (position)""",
    ),
    "g02_attention_list": with_layers(
        *_ALL,
        select="""SELECT product_id, name, gap_percentage, position FROM analysis JOIN products USING (product_id) WHERE status = 'OK' AND position <> 'MARKET_ALIGNED' ORDER BY abs(gap_percentage) DESC, product_id LIMIT 8""",
    ),
    "q13_d03_d04_retailers": with_layers(
        DOMAIN,
        select="""SELECT retailer_id, retailer_name, domain, is_brand_store, coalesce(product_count, 0) AS product_count, last AS last_scraped_at, coalesce(failed, 0) AS failed, coalesce(succeeded, 0) AS succeeded,
            CASE WHEN coalesce(failed + succeeded, 0) = 0 THEN 'idle' WHEN failed = 0 THEN 'healthy' WHEN succeeded = 0 THEN 'failing' ELSE 'degraded' END AS health
          FROM retailers LEFT JOIN (SELECT retailer_id, count(DISTINCT product_id) AS product_count, max(last_scraped_at) AS last, count(*) FILTER (scraping_status = 'failed') AS failed,
            count(*) FILTER (scraping_status = 'success') AS succeeded FROM sources GROUP BY 1) USING (retailer_id)""",
    ),
    "r01_official_price": with_layers(*_C, select="SELECT * FROM official"),
    "r02_d11_store_compliance": with_layers(*_C, select="SELECT * FROM compliance"),
    "r03_d12_brand_list": with_layers(
        *_C,
        select="""SELECT *, brand = 'Brand#23' AS is_focus, row_number() OVER (ORDER BY brand = 'Brand#23' DESC, brand) AS place FROM (
            SELECT brand, product_count, coalesce(store_count, 0) AS store_count, coalesce(b, 0) AS below_official, coalesce(a, 0) AS above_official, coalesce(o, 0) AS out_of_stock
            FROM (SELECT brand, count(*) AS product_count FROM products WHERE NOT coalesce(is_demo, FALSE) GROUP BY 1)
            LEFT JOIN (SELECT brand, count(*) AS store_count, CAST(sum(below_official) AS BIGINT) AS b, CAST(sum(above_official) AS BIGINT) AS a, CAST(sum(out_of_stock) AS BIGINT) AS o FROM compliance GROUP BY 1) USING (brand))""",
    ),
    "r04_brand_detail": with_layers(
        *_ALL, _CELLS, select="SELECT product_id, retailer_id, state, price, difference_percentage, is_lowest FROM cells JOIN products USING (product_id) WHERE lower(brand) = 'brand#23' AND NOT coalesce(is_demo, FALSE)"
    ),
    "v05_compliance_report": with_layers(
        *_C, select="SELECT brand, retailer_id, below_official, listings FROM compliance WHERE NOT is_brand_store AND below_official > 0 ORDER BY below_official DESC, retailer_name, brand LIMIT 8"
    ),
    "o01_o03_e02_listings": with_layers(*_S, select="SELECT * FROM resolved"),
    "o02_reference_retailers": with_layers(*_S, select="SELECT * FROM reference"),
    "o04_shelf": with_layers(*_S, select="SELECT * FROM stock"),
    "o05_g18_brand_catalog": with_layers(
        DOMAIN, select="SELECT *, brand = 'Brand#23' AS is_focus, row_number() OVER (ORDER BY brand = 'Brand#23' DESC, brand) AS place FROM (SELECT brand, count(*) AS product_count FROM products GROUP BY 1)"
    ),
    "o06_unopened_products": with_layers(*_S, select="SELECT * FROM unopened"),
    "o07_unopened_doors": with_layers(
        *_S,
        _DOORS,
        select="SELECT brand, retailer_id, catalog_size, other_brand_listings FROM doors",
    ),
    "o08_restocks": with_layers(*_S, select="SELECT * FROM restocks"),
    "o09_c07_pitches": with_layers(*_S, select="SELECT brand, retailer_id, tone, count(*) AS n, CAST(sum(in_stock_stores) AS BIGINT) AS in_stock_stores FROM pitches GROUP BY ALL"),
    "o09_first_pitches": with_layers(*_S, _LISTS, select="SELECT brand, retailer_id, product_id, tone, in_stock_stores, store_missing FROM first_pitches WHERE place <= 200"),
    "g08_brief_order": with_layers(*_S, _LISTS, select="SELECT place, brand, retailer_id, covered FROM placed_briefs"),
    "o13_overview": with_layers(*_S, _DOORS, _LISTS, select=_OVERVIEW),
    "o10_store_briefs": with_layers(*_S, select="SELECT * FROM briefs"),
    "o11_summary": with_layers(
        *_S,
        select="""SELECT (SELECT count(*) FROM products) AS products, (SELECT count(DISTINCT retailer_id) FROM partners) AS partner_stores, (SELECT count(*) FROM restocks) AS restocks,
          (SELECT count(*) FROM pitches) AS new_listings, (SELECT count(*) FROM briefs WHERE NOT covered) AS stores_with_gaps, (SELECT count(*) FROM unopened) AS unopened_products""",
    ),
    "g07_g09_ranked_restocks": with_layers(
        *_S,
        select="""SELECT product_id, retailer_id, rank, in_stock_stores FROM restocks JOIN (SELECT product_id, name FROM products) USING (product_id) JOIN (SELECT retailer_id, retailer_name FROM retailers) USING (retailer_id)
          ORDER BY rank DESC, in_stock_stores DESC, store_missing DESC, lower(name), retailer_name, product_id, retailer_id LIMIT 200""",
    ),
    "e10_store_cards": with_layers(
        *_S,
        select="""SELECT * FROM (SELECT brand, retailer_id, product_id, row_number() OVER (PARTITION BY brand, retailer_id ORDER BY rank DESC, in_stock_stores DESC, store_missing DESC, product_id) AS place FROM restocks) WHERE place <= 5""",
    ),
}
