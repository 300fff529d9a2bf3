"""Reports by audience: the entries of all twelve sections, in order, with the pages that they lead to."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricescope.functions import text
from pricescope.operators import alerts, brands, content, opportunities, pricing, reports
from pricescope.operators.links import page_link
from pricescope.operators.matrix import select_products
from pricescope.plans import grid, history, ingest, runs, slices
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, with_layers
from pricescope.plans.text import _VERSIONS, _of_pages
from pricescope.session import checkpointed
from pricescope.sources import written
from pricescope.sources.domain import AS_OF, Domain

APP = "https://app.example.com/"
#: Days that a report looks back.
PERIOD = 30
#: Entries of each section; brands are all shown.
LIMITS = {
    "decisions": 12,
    "priceChanges": 10,
    "outOfStock": 10,
    "contentChanges": 10,
    "restocks": 8,
    "newListings": 8,
    "storeBriefs": 6,
    "storeCompliance": 8,
    "unopenedDoors": 6,
    "contentHealth": 5,
    "campaignInsights": 6,
}
#: Alerts of a type that are looked at before the period counts, and products that a brief's talking points name.
ALERT_PAGE, TALKING_POINTS = 100, 4


class Tables:
    """What several sections read, each written once when the first of them asks for it: sources, sources with their newest observations, listings,
    compliance and alerts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.d = spark, sf_dir, Domain(spark, sf_dir)

    @cached_property
    def sourced(self) -> Domain:
        self.d.sources = checkpointed(self.d.sources)
        return self.d

    @cached_property
    def listed(self) -> DataFrame:
        return checkpointed(grid._listed(self.sourced))

    @cached_property
    def shelf(self) -> opportunities.Shelf:
        return grid._shelf(self.sourced, self.listed)

    @cached_property
    def compliance(self) -> DataFrame:
        return checkpointed(grid._compliance(self.sourced, self.listed))

    @cached_property
    def alerts(self) -> DataFrame:
        return checkpointed(history.alert_table(self.spark, self.sf_dir, self.sourced))

    @property
    def names(self) -> DataFrame:
        return self.d.products.select("product_id", F.col("name").alias("product_name"), F.col("brand").alias("product_brand"))


def _entries(rows: DataFrame, section: str, order: list[Column], subject: Column, link: Column, brand: Column | None = None, store: Column | None = None, value: Column | None = None, note: Column | None = None) -> DataFrame:
    """The section's entries, numbered: they are as many as LIMITS says, or one a brand."""
    limit = LIMITS.get(section)
    shown = rows.orderBy(*order).limit(limit) if limit else rows
    text_of = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return shown.select(
        F.lit(section).alias("section"),
        F.row_number().over(Window.orderBy(*order)).alias("entry"),
        subject.cast("string").alias("subject"),
        text_of(brand).alias("brand"),
        text_of(store).alias("store"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        text_of(note).alias("note"),
        link.alias("link"),
    )


def decisions(t: Tables) -> DataFrame:
    chosen = reports.decisions(pricing.analyse_listed(t.listed), select_products(t.d.products, demo=False), LIMITS["decisions"]).join(t.names, "product_id")
    order = [F.abs("gap_percentage").desc(), F.col("name"), F.col("product_id")]
    return _entries(chosen, "decisions", order, F.col("name"), page_link(APP, "product", F.col("product_id")), F.col("product_brand"), value=F.col("gap_percentage"), note=F.col("direction"))


def _alerts(t: Tables, section: str, rows: DataFrame, page: str, order: list[Column]) -> DataFrame:
    """Of the newest alerts, those of the period, with their products' and stores' names."""
    newest = rows.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(ALERT_PAGE)
    named = alerts.unexpired(newest, AS_OF, PERIOD).join(t.names, "product_id", "left").join(t.d.retailers.select("retailer_id", "retailer_name"), "retailer_id", "left")
    return _entries(named, section, [*order, F.col("created_at").desc(), F.col("alert_id").desc()], F.col("product_name"), page_link(APP, page, F.col("product_id")), store=F.col("retailer_name"), value=F.col("change_percentage"), note=F.col("alert_id"))


def price_changes(t: Tables) -> DataFrame:
    rows = t.alerts.where("type = 'PRICE_CHANGE'")
    return _alerts(t, "priceChanges", rows, "product", [F.abs(F.coalesce("change_percentage", F.lit(0.0))).desc()])


def out_of_stock(t: Tables) -> DataFrame:
    return _alerts(t, "outOfStock", t.alerts.where("type = 'OUT_OF_STOCK'"), "product", [])


def content_changes(t: Tables) -> DataFrame:
    """New versions of competitors' pages; the alert's text says which fields changed."""
    found = content.versions(written.snapshots(t.spark, t.sf_dir).where("NOT is_own_store")).where("size(changed) > 0")
    labels = F.create_map(*[F.lit(x) for pair in slices.FIELD_LABELS.items() for x in pair])
    fields = text.english_list(F.transform("changed", lambda f: F.try_element_at(labels, f)))
    rows = found.select(
        F.concat_ws("-", "source_id", "version", F.lit("CONTENT_CHANGE"), fields).alias("alert_id"),
        F.col("source_id").alias("product_id"),
        F.lit(None).cast("bigint").alias("retailer_id"),
        F.lit(None).cast("double").alias("change_percentage"),
        F.col("since").alias("created_at"),
    )
    return _alerts(t, "contentChanges", rows, "product_content", [])


def brand_compliance(t: Tables) -> DataFrame:
    """Every brand, with its partner stores' prices below and above the official one."""
    partners = t.compliance.where("NOT is_brand_store")
    listed = brands.brand_list(select_products(t.d.products, demo=False), partners, grid.FOCUS)
    note = F.concat_ws("/", "above_official", "out_of_stock", "product_count", "store_count")
    return _entries(listed, "brandCompliance", [F.col("place")], F.col("brand"), page_link(APP, "brand", F.col("brand")), F.col("brand"), value=F.col("below_official"), note=note)


def store_compliance(t: Tables) -> DataFrame:
    rows = brands.compliance_report(t.compliance, LIMITS["storeCompliance"])
    order = [F.col("below_official").desc(), F.col("retailer_name"), F.col("brand")]
    note = F.concat_ws("/", "listings", "out_of_stock", F.coalesce(F.format_number("average_gap", 2), F.lit("-")))
    return _entries(rows, "storeCompliance", order, F.col("retailer_name"), page_link(APP, "brand", F.col("brand")), F.col("brand"), F.col("domain"), F.col("below_official"), note)


def store_briefs(t: Tables) -> DataFrame:
    """The stores with most to do, and what to say first: their restocks, then their pitches, as many as a card shows."""
    briefs = opportunities.store_briefs(t.shelf).where("NOT covered").join(t.d.retailers.select("retailer_id", "retailer_name", "domain"), "retailer_id")
    to_do = F.col("out_of_stock") + F.col("pitches")
    order = [to_do.desc(), F.collate("retailer_name", "UNICODE"), F.col("actionable_restocks").desc(), F.col("pitches").desc(), F.collate("brand", "UNICODE"), F.col("retailer_id")]
    first = checkpointed(briefs.orderBy(*order).limit(LIMITS["storeBriefs"]))
    pairs = F.broadcast(first.select("brand", "retailer_id"))
    every = ["brand", "retailer_id", "product_id", "rank", "in_stock_stores", "store_missing"]
    refill = opportunities.restocks(t.shelf).join(pairs, ["brand", "retailer_id"]).select(F.lit(0).alias("kind"), *every)
    offer = opportunities.pitches_of(t.shelf, opportunities.pitch_groups(t.shelf).join(pairs, ["brand", "retailer_id"])).select(F.lit(1).alias("kind"), *every)
    best = [F.col("rank").desc(), F.col("in_stock_stores").desc(), F.col("store_missing").desc(), F.collate("product_name", "UNICODE"), F.col("product_id")]
    placed = refill.unionByName(offer).join(t.names, "product_id").withColumn("at", F.row_number().over(Window.partitionBy("brand", "retailer_id", "kind").orderBy(*best))).where(F.col("at") <= opportunities.CARD_LIMIT)
    points = placed.groupBy("brand", "retailer_id").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "product_name"))).alias("points"))
    named = F.array_join(F.transform(F.slice("points", 1, TALKING_POINTS), lambda p: p["product_name"]), "; ")
    joined = first.join(points, ["brand", "retailer_id"], "left")
    return _entries(joined, "storeBriefs", order, F.col("retailer_name"), page_link(APP, "opportunities", brand=F.col("brand"), view=F.lit("stores")), F.col("brand"), F.col("domain"), to_do, named)


def _opportunities(t: Tables, section: str, view: str, rows: DataFrame) -> DataFrame:
    order = [F.col("rank").desc(), F.col("in_stock_stores").desc(), F.col("store_missing").desc(), F.collate("name", "UNICODE"), F.collate("retailer_name", "UNICODE"), F.col("product_id"), F.col("retailer_id")]
    return _entries(rows, section, order, F.col("name"), page_link(APP, "opportunities", brand=F.col("brand"), view=F.lit(view)), F.col("brand"), F.col("retailer_name"), F.col("in_stock_stores"), F.col("tone"))


def restocks(t: Tables) -> DataFrame:
    """Those with supply at hand, among the list's first."""
    listed = opportunities.rank_opportunities(opportunities.restocks(t.shelf), t.d.products, t.d.retailers)
    return _opportunities(t, "restocks", "restock", listed.where("tone = 'ready'"))


def new_listings(t: Tables) -> DataFrame:
    return _opportunities(t, "newListings", "listings", opportunities.first_pitches(t.shelf, t.d.products, t.d.retailers, LIMITS["newListings"]))


def unopened_doors(t: Tables) -> DataFrame:
    rows = opportunities.first_doors(t.shelf, t.d.retailers).join(t.d.retailers.select("retailer_id", "domain"), "retailer_id")
    order = [F.col("other_brand_listings").desc(), F.collate("retailer_name", "UNICODE"), F.col("retailer_id"), F.collate("brand", "UNICODE")]
    return _entries(rows, "unopenedDoors", order, F.col("retailer_name"), page_link(APP, "opportunities", brand=F.col("brand"), view=F.lit("stores")), F.col("brand"), F.col("domain"), F.col("other_brand_listings"))


def content_health(t: Tables) -> DataFrame:
    rows = slices.v07_content(t.spark, t.sf_dir).join(written.review_products(t.spark, t.sf_dir).select("product_id", "name"), "product_id")
    return _entries(rows, "contentHealth", [F.col("score"), F.col("product_id")], F.col("name"), page_link(APP, "product_content", F.col("product_id")), value=F.col("score"), note=F.concat_ws("/", "fails", "warnings"))


def campaign_insights(t: Tables) -> DataFrame:
    return _entries(runs.v08_campaign(t.spark, t.sf_dir), "campaignInsights", [F.col("place")], F.col("subject"), page_link(APP, "campaigns", type=F.col("type")), value=F.col("priority"), note=F.col("type"))


#: How each section is loaded.
LOADERS: dict[str, Callable[[Tables], DataFrame]] = {
    "decisions": decisions,
    "priceChanges": price_changes,
    "brandCompliance": brand_compliance,
    "storeBriefs": store_briefs,
    "restocks": restocks,
    "storeCompliance": store_compliance,
    "outOfStock": out_of_stock,
    "newListings": new_listings,
    "unopenedDoors": unopened_doors,
    "contentHealth": content_health,
    "contentChanges": content_changes,
    "campaignInsights": campaign_insights,
}


def assemble(tables: Tables, wanted: dict[str, list[str]], loaders: dict[str, Callable[[Tables], DataFrame]] = LOADERS) -> DataFrame:
    """(audience, place, section, entry, subject, brand, store, value, note, link): each audience's sections with their entries.

    Only sections that an audience asks for are loaded, each once; one without a loader is an error. A section without entries
    has one row, with no entry.
    """
    used = sorted({s for sections in wanted.values() for s in sections})
    unknown = [s for s in used if s not in loaders]
    if unknown:
        raise ValueError(f"No way to load: {', '.join(unknown)}")
    loaded = reduce(DataFrame.unionByName, [loaders[s](tables) for s in used])
    rows = [(a, i, s) for a, sections in wanted.items() for i, s in enumerate(sections)]
    shown = tables.spark.createDataFrame(rows, "audience string, place int, section string")
    # Entries are some dozens, and one for each brand.
    return shown.join(loaded, "section", "left")


def v15_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all four audiences."""
    return assemble(Tables(spark, sf_dir), slices.SECTIONS)


def v15_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of three audiences' reports with their numbers of entries."""
    wanted = {a: sections for a, sections in slices.SECTIONS.items() if a != "all"}
    return assemble(Tables(spark, sf_dir), wanted).groupBy("audience", "place", "section").agg(F.count("entry").alias("entries"))


def v18_report_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of link, for each product: (product_id, page, link). Spaces and signs of names are escaped."""
    d = Domain(spark, sf_dir)
    rows = d.products.join(pricing.analyse_products(d.sources, d.observations).select("product_id", "position"), "product_id", "left")
    brand, product, position = F.concat_ws(" & ", "brand", "name"), F.col("product_id"), F.col("position")
    links = {
        "dashboard": page_link(APP, "dashboard"),
        "product": page_link(APP, "product", product),
        "product_content": page_link(APP, "product_content", product),
        "products_by_gap": page_link(APP, "products_by_gap"),
        "products_by_position": page_link(APP, "products_by_position", position=position),
        "alerts": page_link(APP, "alerts", type=F.lit("PRICE_CHANGE")),
        "all_alerts": page_link(APP, "alerts"),
        "brand": page_link(APP, "brand", F.col("brand")),
        "brands": page_link(APP, "brands"),
        "opportunities": page_link(APP, "opportunities", brand=brand, view=F.lit("restock")),
        "every_opportunity": page_link(APP, "opportunities", brand=F.lit("all")),
        "content": page_link(APP, "content", band=F.lit("needs_work")),
        "campaigns": page_link(APP, "campaigns", type=F.lit("price_value")),
        "matrix": page_link(APP, "matrix", position=position),
    }
    listed = F.array(*[F.struct(F.lit(page).alias("page"), link.alias("link")) for page, link in links.items()])
    return rows.select("product_id", F.inline(listed))


QUERIES = {"v15_report_entries": v15_report, "v15_report_assembly": v15_counts, "v18_report_links": v18_report_links}

_APP = "https://app.example.com"


def _encode(x: str) -> str:
    for escaped, char in {"%21": "!", "%27": "''", "%28": "(", "%29": ")", "%2A": "*"}.items():
        x = f"replace({x}, '{escaped}', '{char}')" if "url_encode" in x else f"replace(url_encode({x}), '{escaped}', '{char}')"
    return x


_S = (DOMAIN, LATEST, grid._SHELF, grid._DOORS, grid._LISTS)
_P = f"""
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, alert_id DESC) AS rn FROM alerts) WHERE rn <= {ALERT_PAGE} AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {PERIOD} DAY),
named AS (SELECT n.*, p.name, retailer_name FROM newest n LEFT JOIN products p USING (product_id) LEFT JOIN retailers USING (retailer_id))"""
_OPPORTUNITY = "'{0}/opportunities?brand=' || {1} || '&view={2}'"
_BRIEFS = f"""
six AS (SELECT *, out_of_stock + pitches AS to_do FROM briefs JOIN (SELECT retailer_id, retailer_name, domain FROM retailers) USING (retailer_id) WHERE NOT covered
  ORDER BY out_of_stock + pitches DESC, retailer_name, actionable_restocks DESC, pitches DESC, brand LIMIT 6),
cards AS (
  SELECT 0 AS kind, brand, retailer_id, name, row_number() OVER (PARTITION BY brand, retailer_id ORDER BY place) AS spot FROM first_restocks SEMI JOIN six USING (brand, retailer_id)
  UNION ALL SELECT 1, brand, retailer_id, name, row_number() OVER (PARTITION BY brand, retailer_id ORDER BY place) FROM first_pitches SEMI JOIN six USING (brand, retailer_id)),
points AS (SELECT brand, retailer_id, string_agg(name, '; ' ORDER BY kind, spot) AS note FROM (
  SELECT *, row_number() OVER (PARTITION BY brand, retailer_id ORDER BY kind, spot) AS n FROM cards WHERE spot <= 5) WHERE n <= 4 GROUP BY ALL)"""
#: Each section as (entry, subject, brand, store, value, note, link).
SECTION_SQL = {
    "decisions": with_layers(
        DOMAIN, LATEST, market(), ANALYSIS, ingest._DECIDED,
        select=f"SELECT row_number() OVER (ORDER BY abs(gap_percentage) DESC, name, product_id) AS entry, name AS subject, brand, NULL AS store, gap_percentage AS value, direction AS note, '{_APP}/products/' || product_id AS link FROM decided JOIN (SELECT product_id, brand FROM products) USING (product_id)",
    ),
    "priceChanges": with_layers(
        DOMAIN, history._PAIRS, _P,
        select=f"SELECT * FROM (SELECT row_number() OVER (ORDER BY abs(coalesce(change_percentage, 0)) DESC, created_at DESC, alert_id DESC) AS entry, name, NULL, retailer_name, change_percentage, alert_id, '{_APP}/products/' || product_id FROM named WHERE type = 'PRICE_CHANGE') WHERE entry <= 10",
    ),
    "brandCompliance": with_layers(
        DOMAIN, LATEST, grid._COMPLIANCE,
        select=f"""SELECT row_number() OVER (ORDER BY brand = 'Brand#23' DESC, brand), brand, brand, NULL, CAST(coalesce(b, 0) AS DOUBLE), coalesce(a, 0) || '/' || coalesce(o, 0) || '/' || product_count || '/' || coalesce(n, 0), '{_APP}/brands/' || {_encode("brand")}
          FROM (SELECT brand, count(*) AS product_count FROM products WHERE NOT coalesce(is_demo, FALSE) GROUP BY 1)
          LEFT JOIN (SELECT brand, count(*) AS n, CAST(sum(below_official) AS BIGINT) AS b, CAST(sum(above_official) AS BIGINT) AS a, CAST(sum(out_of_stock) AS BIGINT) AS o FROM compliance WHERE NOT is_brand_store GROUP BY 1) USING (brand)""",
    ),
    "storeBriefs": with_layers(
        *_S, _BRIEFS,
        select=f"SELECT row_number() OVER (ORDER BY to_do DESC, retailer_name, actionable_restocks DESC, pitches DESC, brand), retailer_name, brand, domain, to_do, note, {_OPPORTUNITY.format(_APP, _encode('brand'), 'stores')} FROM six LEFT JOIN points USING (brand, retailer_id)",
    ),
    "restocks": with_layers(*_S, select=f"SELECT * FROM (SELECT row_number() OVER (ORDER BY place) AS entry, name, brand, retailer_name, in_stock_stores, tone, {_OPPORTUNITY.format(_APP, _encode('brand'), 'restock')} FROM first_restocks WHERE tone = 'ready' AND place <= 200) WHERE entry <= 8"),
    "storeCompliance": with_layers(
        DOMAIN, LATEST, grid._COMPLIANCE,
        select=f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY below_official DESC, retailer_name, brand) AS entry, retailer_name, brand, domain, below_official, listings || '/' || out_of_stock || '/' || coalesce(format('{{:,.2f}}', average_gap), '-'), '{_APP}/brands/' || {_encode("brand")}
          FROM compliance WHERE NOT is_brand_store AND below_official > 0) WHERE entry <= 8""",
    ),
    "outOfStock": with_layers(
        DOMAIN, history._PAIRS, _P,
        select=f"SELECT * FROM (SELECT row_number() OVER (ORDER BY created_at DESC, alert_id DESC) AS entry, name, NULL, retailer_name, change_percentage, alert_id, '{_APP}/products/' || product_id FROM named WHERE type = 'OUT_OF_STOCK') WHERE entry <= 10",
    ),
    "newListings": with_layers(*_S, select=f"SELECT place, name, brand, retailer_name, in_stock_stores, tone, {_OPPORTUNITY.format(_APP, _encode('brand'), 'listings')} FROM first_pitches WHERE place <= 8"),
    "unopenedDoors": with_layers(
        *_S,
        select=f"SELECT * FROM (SELECT row_number() OVER (ORDER BY other_brand_listings DESC, retailer_name, brand) AS entry, retailer_name, brand, domain, other_brand_listings, NULL, {_OPPORTUNITY.format(_APP, _encode('brand'), 'stores')} FROM doors JOIN (SELECT retailer_id, domain FROM retailers) USING (retailer_id)) WHERE entry <= 6",
    ),
    "contentHealth": _of_pages(
        f"SELECT * FROM (SELECT row_number() OVER (ORDER BY score, product_id) AS entry, name, NULL, NULL, score, fails || '/' || warnings, '{_APP}/products/' || product_id || '?tab=content' FROM overview JOIN (SELECT p_partkey AS product_id, p_name || ' ' || p_partkey AS name FROM part) USING (product_id) WHERE score < 85) WHERE entry <= 5"
    ),
    "contentChanges": "WITH "
    + ",".join(_VERSIONS)
    + f""",
changes AS (SELECT source_id || '-' || version || '-CONTENT_CHANGE-' || CASE len(f) WHEN 1 THEN f[1] WHEN 2 THEN f[1] || ' and ' || f[2] ELSE f[1] || ', ' || f[2] || ', and ' || f[3] END AS alert_id, source_id AS product_id, since AS created_at
  FROM (SELECT *, string_split(replace(changed, 'bullets', 'bullet points'), ',') AS f FROM versions WHERE NOT is_own_store AND changed <> '')),
newest AS (SELECT * FROM (SELECT * FROM changes ORDER BY created_at DESC, alert_id DESC LIMIT {ALERT_PAGE}) WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {PERIOD} DAY)
SELECT * FROM (SELECT row_number() OVER (ORDER BY created_at DESC, alert_id DESC) AS entry, p_name, NULL, NULL, NULL, alert_id, '{_APP}/products/' || product_id || '?tab=content' FROM newest LEFT JOIN part ON p_partkey = product_id) WHERE entry <= 10""",
    "campaignInsights": slices._with_campaign(f"SELECT place, subject, NULL, NULL, priority, type, '{_APP}/campaigns?type=' || type FROM campaign WHERE place <= 6"),
}
_ENTRIES = "\nUNION ALL ".join(
    f"SELECT '{s}' AS section, CAST(entry AS INTEGER) AS entry, subject, brand, store, CAST(value AS DOUBLE) AS value, note, link FROM ({sql}) t(entry, subject, brand, store, value, note, link)" for s, sql in SECTION_SQL.items()
)
_WANTED = ", ".join(f"('{a}', {i}, '{s}')" for a, sections in slices.SECTIONS.items() for i, s in enumerate(sections))
_POSITION = "CASE WHEN position IS NULL THEN '' ELSE '{0}position=' || position END"

ORACLES = {
    "v15_report_entries": f"SELECT w.*, e.* EXCLUDE (section) FROM (VALUES {_WANTED}) w(audience, place, section) LEFT JOIN ({_ENTRIES}) e USING (section)",
    "v15_report_assembly": f"SELECT audience, place, section, count(entry) AS entries FROM (VALUES {_WANTED}) w(audience, place, section) LEFT JOIN ({_ENTRIES}) e USING (section) WHERE audience <> 'all' GROUP BY ALL",
    "v18_report_links": with_layers(
        DOMAIN, LATEST, market(), ANALYSIS,
        f"""pages AS (SELECT product_id, unnest([('dashboard', '/dashboard'), ('product', '/products/' || product_id), ('product_content', '/products/' || product_id || '?tab=content'), ('products_by_gap', '/products?sort=gap&order=desc'),
          ('products_by_position', '/products?' || {_POSITION.format("")} || CASE WHEN position IS NULL THEN '' ELSE '&' END || 'sort=gap&order=desc'), ('alerts', '/alerts?type=PRICE_CHANGE'), ('all_alerts', '/alerts'),
          ('brand', '/brands/' || {_encode("brand")}), ('brands', '/brands'), ('opportunities', '/opportunities?brand=' || {_encode("brand || ' & ' || name")} || '&view=restock'), ('every_opportunity', '/opportunities?brand=all'),
          ('content', '/content?band=needs_work'), ('campaigns', '/campaigns?type=price_value'), ('matrix', '/matrix' || {_POSITION.format("?")})]) AS page FROM products LEFT JOIN analysis USING (product_id))""",
        select=f"SELECT product_id, page[1] AS page, '{_APP}' || page[2] AS link FROM pages",
    ),
}
