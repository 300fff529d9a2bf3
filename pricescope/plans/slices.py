"""Queries of report slices, campaign and content lists, chart helpers, markup reviews and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.functions import lexicon, text
from pricescope.operators import content, opportunities, pricing, reviews
from pricescope.operators.listing import with_place
from pricescope.plans import grid, ingest
from pricescope.plans import text as text_plans
from pricescope.plans.grid import _S, _analysis, _shelf
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, with_layers
from pricescope.plans.text import _GOOD, _VERSIONS, _of_pages, _over, _themes
from pricescope.session import checkpointed, keep_result, shared_dir
from pricescope.sources import written
from pricescope.sources.domain import Domain

#: The sections of each audience's report, in order, and names of content fields.
SECTIONS = {
    "ceo": ["decisions", "priceChanges", "brandCompliance"],
    "sales": ["storeBriefs", "restocks", "storeCompliance", "outOfStock", "newListings", "unopenedDoors"],
    "marketing": ["contentHealth", "contentChanges", "campaignInsights"],
    "all": ["decisions", "priceChanges", "brandCompliance", "storeBriefs", "restocks", "storeCompliance", "outOfStock", "newListings", "unopenedDoors", "contentHealth", "contentChanges", "campaignInsights"],
}
FIELD_LABELS = {"title": "title", "metaDescription": "meta description", "description": "description", "headings": "headings", "bullets": "bullet points", "faqQuestions": "FAQ"}


def p09_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each suggestion's reason in words. Its sentences."""
    rows = _analysis(Domain(spark, sf_dir)).where("status = 'OK'")
    gap = F.col("gap_percentage")
    where = F.when(gap == 0, F.lit("equal to")).otherwise(F.concat(F.regexp_replace(F.format_number(F.abs(gap), 2), ",", ""), F.when(gap < 0, "% below").otherwise("% above")))
    share = F.create_map(*[F.lit(x) for pair in pricing.SUGGESTED_SHARE.items() for x in pair])
    percent = F.round(F.try_element_at(share, F.col("position")) * 100).cast("int")
    target = F.when(percent == 100, "the market median").otherwise(F.concat(percent.cast("string"), F.lit("% of the market median")))
    kept = F.concat(F.lit("Your price is "), where, F.lit(" the market median, within the market-aligned band. Keep the current price."))
    moved = F.concat(F.lit("Your price is "), where, F.lit(" the market median ("), F.lower(F.replace("position", F.lit("_"), F.lit(" "))), F.lit("). Suggested price is "), target, F.lit("."))
    return rows.select("product_id", F.when(F.col("position") == "MARKET_ALIGNED", kept).otherwise(moved).alias("explanation"))


def v06_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six store briefs with most to do."""
    briefs = opportunities.store_briefs(_shelf(Domain(spark, sf_dir))).where("NOT covered")
    return briefs.orderBy((F.col("out_of_stock") + F.col("pitches")).desc(), "retailer_id", "brand").limit(6).select("brand", "retailer_id", "out_of_stock", "pitches")


def v07_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five captured pages that score lowest among those below the good mark."""
    weak = text_plans.t14_scores(spark, sf_dir).where(F.col("score") < lexicon.GOOD_SCORE)
    return weak.orderBy("score", "product_id").limit(5).select("product_id", "score", "fails", "warnings")


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, subject, priority) of all rules. Reviews are counted once, and the counts written: they are a row for each theme of a brand, and for each store with complaints."""
    counts = checkpointed(reviews.brand_counts(text_plans._reviews(spark, sf_dir)))
    themes = reviews.brand_theme_insights(counts).select("type", F.concat_ws(":", "brand", "theme").alias("subject"), "priority")
    stores = reviews.store_issues(counts).select(F.lit("our_weakness").alias("type"), F.concat_ws(":", F.lit("store"), "brand", "retailer_id").alias("subject"), "priority")
    rivals = reviews.competitor_weaknesses(counts, "Brand A").select("type", F.col("theme").alias("subject"), "priority")
    return themes.unionByName(stores).unionByName(rivals)


def _urgency() -> list[Column]:
    return [F.col("priority").desc(), F.col("type"), F.col("subject")]


def u17_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All insights of all rules as one list, the most urgent first."""
    return with_place(_insights(spark, sf_dir), *_urgency())


def d17_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u17_campaign(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.collect_list("place").alias("places")).select("type", "n", F.array_join(F.array_sort("places"), ",").alias("places"))


def u06_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clamped page of filtered reviews, with the number of pages; the page asked for lies beyond the end."""
    found = reviews.find_reviews(text_plans._reviews(spark, sf_dir), sentiment="negative")
    size, asked = 10, 99
    pages = max(1, -(-found.count() // size))
    return found.orderBy("review_id").offset((min(asked, pages) - 1) * size).limit(size).select("review_id", F.lit(pages).cast("bigint").alias("pages"))


def d16_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = text_plans._reviews(spark, sf_dir).where("usable")
    return used.agg(F.countDistinct("product_id").alias("products"), F.countDistinct("retailer_id").alias("stores"), F.countDistinct(F.concat_ws(":", "product_id", "retailer_id", "body")).alias("reviews"))


def e11_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each equal text."""
    return text_plans.documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


def g15_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that anyone mentions: those the own page lacks first, then by competitors."""
    rows = content.attribute_table(text_plans._pages(spark, sf_dir)).where("own OR competitors_with > 0")
    label = F.create_map(*[F.lit(x) for name, label, _ in lexicon.ATTRIBUTES for x in (name, label)])
    ranked = rows.withColumn("label", F.try_element_at(label, F.col("attribute")))
    place = F.expr("row_number() OVER (PARTITION BY product_id ORDER BY (own IS NULL OR own), competitors_with DESC, label)")
    return ranked.withColumn("place", place).select("product_id", "attribute", F.col("own").cast("int").alias("own"), "competitors_with", "place")


def g19_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks as shown: failures, warnings, notes, passes."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("fail", "warn", "info", "pass")]), F.col("status"))
    rows = content.check_table(text_plans._pages(spark, sf_dir)).withColumn("rank", rank)
    return rows.withColumn("shown", F.expr("row_number() OVER (PARTITION BY product_id ORDER BY rank, place)")).select("product_id", "check", "shown")


def k05_content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each new version of a competitor's page, with the fields that changed in words."""
    found = content.versions(written.snapshots(spark, sf_dir).where("NOT is_own_store")).where("size(changed) > 0")
    labels = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    named = text.english_list(F.transform("changed", lambda f: F.try_element_at(labels, f)))
    return found.select(F.lit("CONTENT_CHANGE").alias("type"), "source_id", "version", named.alias("fields"))


def v18_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the brands' and products' pages."""
    rows = Domain(spark, sf_dir).products
    link = F.concat(F.lit("https://app.example.com/products?brand="), F.url_encode("brand"), F.lit("&sort=gap&order=desc"))
    return rows.select("product_id", link.alias("link"))


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep_result(path)
    return path


def a16_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole export written as one text file, its header first and marked as UTF-8, and read back (which drops the mark). It has 501 lines at most."""
    lines = grid.x01_csv(spark, sf_dir).repartition(1).sortWithinPartitions("place")
    folder = _folder(spark, "matrix-csv")
    lines.select(F.when(F.col("place") == 0, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")).alias("line")).write.option("lineSep", "\r\n").text(folder)
    return spark.read.option("lineSep", "\r\n").text(folder).agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("characters"))


def a17_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit written as JSON and read back with its schema."""
    rows = ingest.n05_audit(spark, sf_dir)
    folder = _folder(spark, "audit-json")
    rows.write.json(folder)
    return spark.read.schema(rows.schema).json(folder)


def a05_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one table of observations; what is newest comes from both."""
    rows = Domain(spark, sf_dir).observations
    folder = _folder(spark, "observations")
    rows.where("order_key % 2 = 0").write.mode("append").parquet(folder)
    rows.where("order_key % 2 = 1").write.mode("append").parquet(folder)
    return pricing.latest_per_source(spark.read.schema(rows.schema).parquet(folder))


QUERIES = {
    "p09_explanations": p09_explanation,
    "v06_store_slices": v06_slices,
    "v07_content_slice": v07_content,
    "u17_i02_campaign": u17_campaign,
    "d17_q16_insight_counts": d17_counts,
    "u06_review_page": u06_overview,
    "d16_distinct_counts": d16_distinct,
    "e11_i05_first_copies": e11_first,
    "g15_attribute_coverage": g15_attributes,
    "g19_check_order": g19_checks,
    "k05_content_changes": k05_content_changes,
    "v18_links": v18_links,
    "a05_append": a05_append,
    "a16_csv_sink": a16_csv_sink,
    "a17_json_sink": a17_json_sink,
}

_CAMPAIGN = f"""
insights AS (
  SELECT CASE WHEN positive >= 2 AND positive > negative THEN 'strength' ELSE 'our_weakness' END AS type, brand || ':' || theme AS subject,
    CASE WHEN positive >= 2 AND positive > negative THEN 60 + 3 * positive ELSE 72 + 4 * negative END AS priority
  FROM ({_themes("brand", _GOOD)}) WHERE (positive >= 2 AND positive > negative) OR (negative >= 1 AND negative >= positive)
  UNION ALL SELECT 'our_weakness', 'store:' || brand || ':' || retailer_id, 68 + 5 * count(*) FROM r WHERE usable AND store_issue AND sentiment = 'negative' GROUP BY brand, retailer_id
  UNION ALL SELECT 'competitor_weakness', theme, 78 + 3 * b.negative FROM ({_themes("brand = 'Brand A' AS ours", _GOOD)}) a JOIN ({_themes("brand = 'Brand A' AS ours", _GOOD)}) b USING (theme)
    WHERE a.ours AND NOT b.ours AND a.positive >= 1 AND b.negative >= 1),
campaign AS (SELECT *, row_number() OVER (ORDER BY priority DESC, type, subject) AS place FROM insights)"""


def _with_campaign(select: str) -> str:
    return _over("SELECT 1").removesuffix("\nSELECT 1") + "," + _CAMPAIGN + "\n" + select


ORACLES = {
    "p09_explanations": with_layers(
        DOMAIN,
        LATEST,
        market(),
        ANALYSIS,
        select="""SELECT product_id, 'Your price is ' || CASE WHEN gap_percentage = 0 THEN 'equal to' ELSE format('{:.2f}', abs(gap_percentage)) || CASE WHEN gap_percentage < 0 THEN '% below' ELSE '% above' END END || ' the market median' ||
          CASE position WHEN 'MARKET_ALIGNED' THEN ', within the market-aligned band. Keep the current price.' WHEN 'UNDERPRICED' THEN ' (underpriced). Suggested price is 98% of the market median.'
            WHEN 'SLIGHTLY_UNDERPRICED' THEN ' (slightly underpriced). Suggested price is 99% of the market median.' WHEN 'SLIGHTLY_OVERPRICED' THEN ' (slightly overpriced). Suggested price is the market median.'
            ELSE ' (overpriced). Suggested price is 102% of the market median.' END AS explanation FROM analysis WHERE status = 'OK'""",
    ),
    "v06_store_slices": with_layers(*_S, select="SELECT brand, retailer_id, out_of_stock, pitches FROM briefs WHERE NOT covered ORDER BY out_of_stock + pitches DESC, retailer_id, brand LIMIT 6"),
    "v07_content_slice": _of_pages("SELECT product_id, score, fails, warnings FROM overview WHERE score < 85 ORDER BY score, product_id LIMIT 5"),
    "u17_i02_campaign": _with_campaign("SELECT * FROM campaign"),
    "d17_q16_insight_counts": _with_campaign("SELECT type, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM campaign GROUP BY 1"),
    "u06_review_page": _over(
        """SELECT review_id, pages FROM (SELECT review_id, row_number() OVER (ORDER BY review_id) AS n, greatest(CAST(ceil(count(*) OVER () / 10) AS BIGINT), 1) AS pages FROM r WHERE sentiment = 'negative')
           WHERE n > (least(99, pages) - 1) * 10 AND n <= least(99, pages) * 10"""
    ),
    "d16_distinct_counts": _over("SELECT count(DISTINCT product_id) AS products, count(DISTINCT retailer_id) AS stores, count(DISTINCT product_id || ':' || retailer_id || ':' || body) AS reviews FROM r WHERE usable"),
    "e11_i05_first_copies": "SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1",
    "g15_attribute_coverage": _of_pages(
        f"""SELECT product_id, attribute, CAST(own AS INTEGER) AS own, competitors_with, row_number() OVER (PARTITION BY product_id ORDER BY (own IS NULL OR own), competitors_with DESC, label) AS place FROM (
             SELECT p.product_id, a.attribute, label, CASE WHEN own.found IS NOT NULL THEN list_contains(own.found, a.attribute) END AS own,
               (SELECT count(*) FROM pages2 c WHERE c.product_id = p.product_id AND NOT is_own_store AND list_contains(c.found, a.attribute)) AS competitors_with
             FROM (SELECT DISTINCT product_id FROM pages2) p, (VALUES {", ".join(f"('{n}', '{x}')" for n, x, _ in lexicon.ATTRIBUTES)}) a(attribute, label) LEFT JOIN own ON own.product_id = p.product_id)
           WHERE own OR competitors_with > 0"""
    ),
    "g19_check_order": _of_pages(
        """SELECT product_id, "check", row_number() OVER (PARTITION BY product_id ORDER BY CASE status WHEN 'fail' THEN 1 WHEN 'warn' THEN 2 WHEN 'info' THEN 3 ELSE 4 END, place) AS shown FROM checks"""
    ),
    "k05_content_changes": "WITH "
    + ",".join(_VERSIONS)
    + """
SELECT 'CONTENT_CHANGE' AS type, source_id, version, CASE len(f) WHEN 1 THEN f[1] WHEN 2 THEN f[1] || ' and ' || f[2] ELSE f[1] || ', ' || f[2] || ', and ' || f[3] END AS fields
FROM (SELECT *, string_split(replace(changed, 'bullets', 'bullet points'), ',') AS f FROM versions WHERE NOT is_own_store AND changed <> '')""",
    "v18_links": with_layers(DOMAIN, select="SELECT product_id, 'https://app.example.com/products?brand=' || replace(brand, '#', '%23') || '&sort=gap&order=desc' AS link FROM products"),
    "a05_append": with_layers(DOMAIN, LATEST, select="SELECT * FROM latest"),
    "a16_csv_sink": f"SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM ({grid.ORACLES['x01_x03_csv_export']})",
    "a17_json_sink": ingest.ORACLES["n05_c13_d19_audit"],
}
