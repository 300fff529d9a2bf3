"""Queries of page extraction, imports, audits, table changes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.operators import imports, page_prices, pages, pricing, reports, tables
from pricescope.operators.matrix import select_products
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, with_layers
from pricescope.sources import shop_pages
from pricescope.sources.domain import Domain


def h16_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = pages.page_copy(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return copy.select("page_id", "title", "language", F.size("h1").alias("h1"), F.size("h2").alias("h2"), F.size("bullets").alias("bullets"), F.length("description").alias("description_length"), "images", "with_alt")


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.snapshots(shop_pages.product_pages(spark, sf_dir))


def h13_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product page: offers, sales shown, currency, stock, warnings, or why it can't be used."""
    return page_prices.analyze_pages(_shown(spark, sf_dir))


def h17_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.product_info(_shown(spark, sf_dir))


def h06_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.displayed_sales(shop_pages.product_pages(spark, sf_dir))


def a13_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = pages.snapshots(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return shown.select("page_id", "final_url", "title", F.length("visible_text").alias("text_length"), F.sha2("visible_text", 256).alias("text_hash"))


def n03_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet prices are the observed ones; live prices come from the part table. One listing of each product."""
    d = Domain(spark, sf_dir)
    cells = pricing.with_latest(d.sources, pricing.latest_per_source(d.observations)).where("is_own_store").select("product_id", "url", "price")
    part = F.col("p_partkey")
    live = d.table("part").select(
        part.alias("pid"), (F.col("p_retailprice") * F.when(part % 5 == 0, 2.5).when(part % 5 == 1, 1.0).otherwise(0.9)).alias("live_price"), F.when(part % 7 == 0, "EUR").otherwise("USD").alias("live_currency"), (part % 11 != 0).alias("success")
    )
    live = d.sources.where("is_own_store").select("url", "product_id").join(live, F.col("product_id") == F.col("pid")).drop("product_id", "pid")
    return imports.drift(cells, live, "USD").select("product_id", "verdict", "new_price")


def n04_keep_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a round of checks in which every seventh source fails, for passing and for lasting reasons."""
    sources = Domain(spark, sf_dir).sources.select("source_id", "scraping_status")
    code = F.when(F.col("source_id") % 2 == 0, "TIMEOUT").otherwise("UNAVAILABLE")
    failed = F.col("source_id") % 7 == 0
    after = sources.withColumns({"error_code": F.when(failed, code), "scraping_status": F.when(failed, "failed").otherwise("success")})
    return imports.keep_status(sources, after, ["BLOCKED", "TIMEOUT", "RENDER_FAILURE", "EMPTY_PAGE"]).groupBy("scraping_status", "error_code").agg(F.count("*").alias("n"))


def n05_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest observations audited against list prices, counted by store and verdict."""
    d = Domain(spark, sf_dir)
    listed = pricing.with_latest(d.sources, pricing.latest_per_source(d.observations))
    scraped = listed.select("source_id", "retailer_id", "price", "availability", (F.col("scraping_status") == "success").alias("success"))
    truth = listed.where("source_id % 3 <> 0").select("source_id", F.when(F.col("source_id") % 2 == 0, F.col("price")).otherwise(F.col("original_price")).alias("true_price"), (F.col("source_id") % 5 < 3).alias("truly_in_stock"))
    return imports.audit(scraped, truth).groupBy("retailer_id", "verdict").agg(F.count("*").alias("n"))


def a06_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts 1 to 100 are there; line items bring others, and some again."""
    parts = Domain(spark, sf_dir).table("part").where("p_partkey <= 100").select(F.col("p_partkey").alias("k"), F.lit("old").alias("origin"), F.lit(0).cast("bigint").alias("seen"))
    incoming = Domain(spark, sf_dir).table("lineitem").select(F.col("l_partkey").alias("k"), F.lit("new").alias("origin"), F.col("l_orderkey").alias("seen"))
    return tables.insert_if_absent(parts, incoming, ["k"], "seen").groupBy("origin", "inserted").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))


def a07_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    table = d.retailers.where("retailer_id % 2 = 0").select("domain", F.col("retailer_name").alias("name"), "is_brand_store")
    incoming = d.retailers.where("retailer_id % 3 = 0").select("domain", F.lit("Renamed").alias("name"), (F.col("retailer_id") % 9 == 0).alias("is_brand_store"))
    return tables.upsert(table, incoming, "domain", ["name"], ["is_brand_store"])


def a09_delete_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    gone = d.products.where("brand = 'Brand#11'").select("product_id")
    after = tables.delete_cascading({"products": d.products, "sources": d.sources, "observations": d.observations}, "product_id", gone)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in after.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def a10_delete_retailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store's end leaves behind: the analysis of the products that it had, computed again."""
    d = Domain(spark, sf_dir)
    gone = d.retailers.where("retailer_id IN (3, 4)").select("retailer_id")
    after = tables.delete_cascading({"sources": d.sources, "observations": d.observations}, "retailer_id", gone)
    again = tables.affected(d.sources, "retailer_id", gone, "product_id")
    fresh = pricing.analyse_products(after["sources"].join(again, "product_id", "left_semi"), after["observations"].join(again, "product_id", "left_semi"))
    return fresh.select("product_id", "status", "market_median", "gap_percentage", "competitor_count")


def v01_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return reports.decisions(pricing.analyse_products(d.sources, d.observations), select_products(d.products, demo=False))


def v10_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.price_actions(v01_decisions(spark, sf_dir)).select("product_id", "direction", "priority", "rank")


def v11_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.headline(reports.price_actions(v01_decisions(spark, sf_dir)))


def h03_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price of every page that tells one, however it was answered."""
    return page_prices.page_prices(_shown(spark, sf_dir))


QUERIES = {
    "h03_h04_page_prices": h03_prices,
    "h13_h03_h04_h07_page_analysis": h13_analysis,
    "h17_product_info": h17_info,
    "h06_displayed_sales": h06_sales,
    "a13_page_snapshots": a13_snapshots,
    "h16_page_copy": h16_copy,
    "n03_drift": n03_drift,
    "n04_keep_status": n04_keep_status,
    "n05_c13_d19_audit": n05_audit,
    "a06_insert_if_absent": a06_insert,
    "a07_upsert": a07_upsert,
    "a09_delete_product": a09_delete_product,
    "a10_delete_retailer": a10_delete_retailer,
    "v01_v04_decisions": v01_decisions,
    "v10_g13_price_actions": v10_actions,
    "v11_headline": v11_headline,
}

_ALL = (DOMAIN, LATEST, market(), ANALYSIS)
_DECIDED = """
decided AS (
  SELECT product_id, name, gap_percentage, CASE WHEN gap_percentage > 0 THEN 'lower' ELSE 'raise' END AS direction, suggested_price - own_price AS price_change
  FROM analysis JOIN products USING (product_id) WHERE status = 'OK' AND abs(gap_percentage) > 10 AND NOT coalesce(is_demo, FALSE) ORDER BY abs(gap_percentage) DESC, name, product_id LIMIT 12),
actions AS (
  SELECT product_id, direction, priority, row_number() OVER (ORDER BY priority, CASE WHEN direction = 'lower' THEN place ELSE 100 END) AS rank
  FROM (SELECT *, CASE WHEN direction = 'lower' AND abs(gap_percentage) >= 25 THEN 'high' ELSE 'medium' END AS priority,
    row_number() OVER (PARTITION BY direction ORDER BY abs(gap_percentage) DESC, name, product_id) AS place FROM decided)
  WHERE (direction = 'lower' AND place <= 2) OR (direction = 'raise' AND place = 1))"""
_BODY = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>', ' ', 'g')"


def _inner(tag: str) -> str:
    return f"len(list_filter(list_transform(regexp_extract_all(b, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), lambda x: trim(regexp_replace(replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))), lambda x: x <> ''))"


_TEXT_OF = "html"
for _tag in ("head", "title"):
    _TEXT_OF = f"regexp_replace({_TEXT_OF}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
for _tag in ("script", "style", "noscript", "template"):
    _TEXT_OF = f"regexp_replace({_TEXT_OF}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_TEXT_OF = f"regexp_replace(regexp_replace({_TEXT_OF}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


def _plain_html(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


ORACLES = {
    "h13_h03_h04_h07_page_analysis": "WITH " + shop_pages.ANALYSIS_SQL + "\nSELECT * EXCLUDE (kind_known) FROM analysed",
    "h17_product_info": shop_pages.INFO_SQL,
    "h03_h04_page_prices": "WITH " + shop_pages.ANALYSIS_SQL.replace("problem IS NULL", "kind NOT IN (8, 9)") + "\nSELECT page_id, strategy, price, currency FROM analysed WHERE kind_known",
    "h06_displayed_sales": "WITH " + shop_pages.ANALYSIS_SQL + "\nSELECT page_id, sale AS sale_price, 'USD' AS sale_currency, price AS compare_at, kind = 5 AS explicit FROM told WHERE kind IN (5, 6)",
    "a13_page_snapshots": f"""SELECT page_id, url AS final_url, {_plain_html("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, length({_plain_html(_TEXT_OF)}) AS text_length, sha256({_plain_html(_TEXT_OF)}) AS text_hash FROM pages""",
    "h16_page_copy": f"""SELECT page_id, title, language, {_inner("h1")} AS h1, {_inner("h2")} AS h2, least(30, {_inner("li")}) AS bullets,
        list_max(list_filter(list_transform(list_transform(regexp_extract_all(b, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(
          replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))),
          lambda x: length(x)), lambda n: n BETWEEN 40 AND 15000)) AS description_length,
        len(regexp_extract_all(b, '(?i)<img\\b')) AS images, len(regexp_extract_all(b, '(?i)<img\\b[^>]*\\balt=["''][^"'']+["'']')) AS with_alt
      FROM (SELECT page_id, {_BODY} AS b,
        nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
        nullif(lower(regexp_extract(html, '(?i)<html[^>]*\\blang=["'']([A-Za-z-]+)', 1)), '') AS language FROM pages)""",
    "n03_drift": with_layers(
        DOMAIN,
        LATEST,
        select="""SELECT product_id, verdict, CASE WHEN verdict = 'changed' THEN live ELSE price END AS new_price FROM (
          SELECT product_id, price, live, CASE WHEN product_id % 11 = 0 THEN 'failed' WHEN product_id % 7 = 0 THEN 'wrong_currency' WHEN price IS NOT NULL AND live = floor(price * 100 + 0.5) / 100 THEN 'unchanged'
              WHEN price IS NOT NULL AND abs(live - price) / price > 0.5 THEN 'review' ELSE 'changed' END AS verdict
          FROM (SELECT l.product_id, l.price, floor(p_retailprice * CASE WHEN p_partkey % 5 = 0 THEN 2.5::DOUBLE WHEN p_partkey % 5 = 1 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END * 100 + 0.5) / 100 AS live
                FROM listed l JOIN part ON p_partkey = l.product_id WHERE is_own_store))""",
    ),
    "n04_keep_status": with_layers(
        DOMAIN,
        select="""SELECT CASE WHEN source_id % 7 <> 0 OR (source_id % 2 = 0 AND scraping_status = 'success') THEN 'success' ELSE 'failed' END AS scraping_status,
            CASE WHEN source_id % 7 = 0 THEN CASE WHEN source_id % 2 = 0 THEN 'TIMEOUT' ELSE 'UNAVAILABLE' END END AS error_code, count(*) AS n FROM sources GROUP BY ALL""",
    ),
    "n05_c13_d19_audit": with_layers(
        DOMAIN,
        LATEST,
        select="""SELECT retailer_id, verdict, count(*) AS n FROM (
          SELECT retailer_id, CASE WHEN scraping_status <> 'success' THEN 'scrape-failed' WHEN source_id % 3 = 0 OR t IS NULL THEN 'unverified' WHEN abs(t - price) > 0.01 THEN 'price-mismatch'
              WHEN availability <> 'unknown' AND (availability <> 'out_of_stock') <> (source_id % 5 < 3) THEN 'stock-mismatch' ELSE 'ok' END AS verdict
          FROM (SELECT *, CASE WHEN source_id % 2 = 0 THEN price ELSE original_price END AS t FROM listed)) GROUP BY ALL""",
    ),
    "a06_insert_if_absent": """SELECT origin, inserted, count(*) AS n, CAST(sum(seen) AS BIGINT) AS seen FROM (
        SELECT p_partkey AS k, 'old' AS origin, 0 AS seen, FALSE AS inserted FROM part WHERE p_partkey <= 100
        UNION ALL SELECT l_partkey, 'new', min(l_orderkey), TRUE FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey <= 100) GROUP BY l_partkey) GROUP BY 1, 2""",
    "a07_upsert": with_layers(
        DOMAIN,
        select="""SELECT domain, CASE WHEN retailer_id % 2 = 0 THEN retailer_name ELSE 'Renamed' END AS name, (retailer_id % 2 = 0 AND is_brand_store) OR retailer_id % 9 = 0 AS is_brand_store
          FROM retailers WHERE retailer_id % 2 = 0 OR retailer_id % 3 = 0""",
    ),
    "a09_delete_product": with_layers(
        DOMAIN,
        select="""SELECT 'products' AS name, count(*) AS n FROM products WHERE brand <> 'Brand#11' UNION ALL SELECT 'sources', count(*) FROM sources JOIN products USING (product_id) WHERE brand <> 'Brand#11'
          UNION ALL SELECT 'observations', count(*) FROM observations JOIN products USING (product_id) WHERE brand <> 'Brand#11'""",
    ),
    "a10_delete_retailer": with_layers(
        DOMAIN.replace("sources AS (", "every_source AS (").replace("observations AS (", "every_observation AS ("),
        "again AS (SELECT DISTINCT product_id FROM every_source WHERE retailer_id IN (3, 4))",
        "sources AS (SELECT * FROM every_source WHERE retailer_id NOT IN (3, 4) AND product_id IN (SELECT product_id FROM again))",
        "observations AS (SELECT * FROM every_observation WHERE retailer_id NOT IN (3, 4) AND product_id IN (SELECT product_id FROM again))",
        LATEST,
        market(),
        ANALYSIS,
        select="SELECT product_id, status, market_median, gap_percentage, competitor_count FROM analysis",
    ),
    "v01_v04_decisions": with_layers(*_ALL, _DECIDED, select="SELECT * FROM decided"),
    "v10_g13_price_actions": with_layers(*_ALL, _DECIDED, select="SELECT * FROM actions"),
    "v11_headline": with_layers(
        *_ALL,
        _DECIDED,
        select="""SELECT count(*) AS actions, count(*) FILTER (priority = 'high') AS urgent, CASE WHEN count(*) FILTER (priority = 'high') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'attention' ELSE 'healthy' END AS status FROM actions""",
    ),
}
