"""Where a brand can sell more: shelves to refill, products to list, stores to open."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pricescope.functions.numeric import is_valid_price, round_half_up
from pricescope.operators.listing import with_place
from pricescope.session import checkpointed

#: How many entries lists and cards show.
LIST_LIMIT, CARD_LIMIT, PRODUCT_LIMIT, DOOR_LIMIT = 200, 5, 12, 20


def listing_state() -> Column:
    """What a source says of a shelf. A failed or missing check says nothing."""
    known = F.col("scraped_at").isNotNull() & ~F.coalesce(F.col("scraping_status") == "failed", F.lit(False))
    stocked = is_valid_price(F.col("price")) | F.coalesce(F.col("availability").isin("in_stock", "limited"), F.lit(False))
    return F.when(~known, "unknown").when(F.col("availability") == "out_of_stock", "out_of_stock").when(stocked, "in_stock").otherwise("unknown")


def reference_retailers(listed: DataFrame, products: DataFrame, retailers: DataFrame) -> DataFrame:
    """Stores that aren't partners: brand stores, own stores, and those all of whose sources are own ones."""
    of_products = listed.join(products.select("product_id"), "product_id", "left_semi")
    all_own = of_products.groupBy("retailer_id").agg(F.bool_and("is_own_store").alias("all_own"))
    joined = retailers.join(all_own, "retailer_id", "left")
    return joined.where(F.coalesce("is_brand_store", F.lit(False)) | F.coalesce("all_own", F.lit(False))).select("retailer_id")


def resolve_listings(listed: DataFrame, products: DataFrame, retailers: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The best source for each product and store: in stock over out of stock over unknown, priced first, then by order.

    ``sources`` are those of ``listed`` without observations, where there is such a table: who owns a store needs no prices.
    """
    reference = reference_retailers(listed if sources is None else sources, products, retailers).withColumn("is_reference", F.lit(True))
    price = F.when(is_valid_price(F.col("price")), F.col("price"))
    rows = listed.join(products.select("product_id", "brand"), "product_id").join(retailers.select("retailer_id"), "retailer_id", "left_semi").join(reference, "retailer_id", "left")
    state = listing_state()
    rank = F.when(state == "in_stock", 2).when(state == "out_of_stock", 1).otherwise(0)
    rows = rows.withColumns({"state": state, "rank": rank}).withColumn("price", price).withColumn("priced", F.col("price").isNotNull())
    best = F.expr("row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY rank DESC, priced DESC, sort_order, source_id)")
    chosen = rows.withColumn("place", best).where("place = 1")
    is_reference = F.coalesce("is_reference", F.lit(False))
    return chosen.select("product_id", "retailer_id", "brand", "state", "price", (F.col("is_own_store") | is_reference).alias("official"))


@dataclass
class Shelf:
    """Facts that all opportunities share: written or cached once by the caller if they are read often."""

    listings: DataFrame
    catalog: DataFrame
    stock: DataFrame
    partners: DataFrame


def build_shelf(listings: DataFrame, products: DataFrame) -> Shelf:
    """stock: by product, stores in stock and whether the official ones are out. partners: by brand and store, products on the shelf."""
    catalog = products.select("product_id", "name", "brand")
    stock = listings.groupBy("product_id").agg(
        F.count_if(F.col("state") == "in_stock").alias("in_stock_stores"),
        (F.coalesce(F.bool_or(F.col("official") & (F.col("state") == "out_of_stock")), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("official") & (F.col("state") == "in_stock")), F.lit(False))).alias("official_out"),
    )
    partners = listings.where(~F.col("official")).groupBy("brand", "retailer_id").agg(F.count("*").alias("listed"))
    return Shelf(listings, catalog, stock, partners)


def _with_catalog_size(shelf: Shelf) -> DataFrame:
    sizes = shelf.catalog.groupBy("brand").agg(F.count("*").alias("catalog_size"))
    return shelf.partners.join(sizes, "brand")


def restocks(shelf: Shelf) -> DataFrame:
    """Partners' listings that are out of stock, and whether supply is at hand."""
    rows = shelf.listings.where(~F.col("official") & (F.col("state") == "out_of_stock")).join(shelf.stock, "product_id").join(_with_catalog_size(shelf), ["brand", "retailer_id"])
    tone = F.when(F.col("in_stock_stores") == 0, "supply_gap").when(F.col("official_out"), "confirm_supply").otherwise("ready")
    rank = F.when(F.col("in_stock_stores") == 0, 0).when(F.col("official_out"), 1).otherwise(2)
    return rows.select("brand", "retailer_id", "product_id", "in_stock_stores", tone.alias("tone"), rank.alias("rank"), (F.col("catalog_size") - F.col("listed")).alias("store_missing"))


def _offered(shelf: Shelf) -> DataFrame:
    """The catalog's products that are in stock somewhere, and how ready they are to be offered."""
    stocked = shelf.catalog.select("product_id", "brand").join(shelf.stock.where("in_stock_stores > 0"), "product_id")
    return stocked.select("product_id", "brand", "in_stock_stores", F.when(F.col("official_out"), "confirm_supply").otherwise("ready").alias("tone"), F.when(F.col("official_out"), 1).otherwise(2).alias("rank"))


_GROUP = ["brand", "tone", "rank", "in_stock_stores"]


def pitch_groups(shelf: Shelf) -> DataFrame:
    """How many products each partner could be offered, by brand, tone and stores in stock: (brand, retailer_id, tone, rank, in_stock_stores, store_missing, n).

    They are counted, never listed: a brand's products in stock less those of them that the partner lists. The hot brand is one row a
    group before it meets its partners.
    """
    offered = _offered(shelf)
    of_brand = offered.groupBy(*_GROUP).agg(F.count("*").alias("n"))
    at_store = shelf.listings.select("product_id", "retailer_id").join(offered, "product_id").groupBy(*_GROUP, "retailer_id").agg(F.count("*").alias("listed_n"))
    groups = _with_catalog_size(shelf).join(of_brand, "brand").join(at_store, [*_GROUP, "retailer_id"], "left")
    counted = groups.withColumn("n", F.col("n") - F.coalesce("listed_n", F.lit(0))).where("n > 0")
    return counted.select(*_GROUP, "retailer_id", (F.col("catalog_size") - F.col("listed")).alias("store_missing"), "n")


def pitches_of(shelf: Shelf, groups: DataFrame) -> DataFrame:
    """The products behind some groups of ``pitch_groups``: those that the partner doesn't list."""
    listed = shelf.listings.select("product_id", "retailer_id")
    return groups.drop("n").join(_offered(shelf), _GROUP).join(listed, ["product_id", "retailer_id"], "left_anti")


def first_pitches(shelf: Shelf, products: DataFrame, retailers: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The first entries of the list of new listings. Only the groups that can reach it are listed.

    A group has one pitch at least, so the first ``limit`` groups in order hold the list; groups equal to the last of them come along.
    """
    groups = pitch_groups(shelf)
    key = F.struct("rank", "in_stock_stores", "store_missing")
    least = groups.select(key.alias("key")).orderBy(F.desc("key")).limit(limit).agg(F.min("key").alias("least"))
    return rank_opportunities(pitches_of(shelf, groups.join(F.broadcast(least), key >= F.col("least")).drop("least")), products, retailers, limit)


def rank_opportunities(rows: DataFrame, products: DataFrame, retailers: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The first of the list: rank, stores in stock and missing products descending, then names. A top-n."""
    named = rows.join(products.select("product_id", "name"), "product_id").join(retailers.select("retailer_id", "retailer_name"), "retailer_id")
    order = [F.col("rank").desc(), F.col("in_stock_stores").desc(), F.col("store_missing").desc(), F.collate("name", "UNICODE"), F.collate("retailer_name", "UNICODE"), F.col("product_id"), F.col("retailer_id")]
    return named.orderBy(*order).limit(limit)


def store_cards(rows: DataFrame, limit: int = CARD_LIMIT) -> DataFrame:
    """At most ``limit`` opportunities for each store and brand."""
    place = F.expr("row_number() OVER (PARTITION BY brand, retailer_id ORDER BY rank DESC, in_stock_stores DESC, store_missing DESC, product_id)")
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def store_briefs(shelf: Shelf) -> DataFrame:
    """One row for each brand and partner: what is listed, in stock, out, missing, could be pitched, and coverage in percent.

    Pitches are counted, not listed: the brand's products in stock somewhere, less those of them that the partner lists.
    """
    placed = shelf.listings.join(shelf.stock.select("product_id", "in_stock_stores"), "product_id")
    partner, stocked, out = ~F.col("official"), F.col("in_stock_stores") > 0, F.col("state") == "out_of_stock"
    at_store = placed.groupBy("brand", "retailer_id").agg(
        F.count_if(partner).alias("listed"),
        F.count_if(partner & (F.col("state") == "in_stock")).alias("in_stock"),
        F.count_if(partner & out).alias("out_of_stock"),
        F.count_if(stocked).alias("listed_in_stock"),
        F.count_if(partner & out & stocked).alias("actionable_restocks"),
    )
    brands = shelf.catalog.join(shelf.stock.select("product_id", "in_stock_stores"), "product_id", "left").groupBy("brand").agg(F.count("*").alias("catalog_size"), F.count_if(stocked).alias("brand_in_stock"))
    rows = at_store.where("listed > 0").join(brands, "brand").withColumn("pitches", F.col("brand_in_stock") - F.col("listed_in_stock"))
    return rows.select(
        "brand",
        "retailer_id",
        "catalog_size",
        "listed",
        "in_stock",
        "out_of_stock",
        (F.col("catalog_size") - F.col("listed")).alias("missing"),
        "pitches",
        "actionable_restocks",
        round_half_up(F.col("listed") / F.col("catalog_size") * 100).alias("coverage_percentage"),
        ((F.col("out_of_stock") == 0) & (F.col("pitches") == 0)).alias("covered"),
    )


def unopened_products(shelf: Shelf) -> DataFrame:
    """Products in stock somewhere that no partner lists."""
    listed = shelf.listings.where(~F.col("official")).select("product_id")
    return shelf.catalog.join(listed, "product_id", "left_anti").join(shelf.stock.where("in_stock_stores > 0").select("product_id"), "product_id", "left_semi")


def _stores(shelf: Shelf) -> DataFrame:
    """Partner stores with the products that they list and the brands that they lack (each is one of another brand's partners)."""
    brands = shelf.catalog.where("brand IS NOT NULL").agg(F.countDistinct("brand").alias("brands"))
    stores = shelf.partners.groupBy("retailer_id").agg(F.sum("listed").alias("other_brand_listings"), F.count("brand").alias("has"))
    return stores.join(F.broadcast(brands)).select("retailer_id", "other_brand_listings", (F.col("brands") - F.col("has")).alias("lacks"))


def door_count(shelf: Shelf) -> DataFrame:
    """One row: the number of pairs of a partner store and a brand that it lacks."""
    return _stores(shelf).agg(F.coalesce(F.sum("lacks"), F.lit(0)).alias("doors"))


def every_door(shelf: Shelf) -> DataFrame:
    """All pairs of a partner store and a brand of which it lists nothing: (brand, retailer_id, catalog_size, other_brand_listings).

    As many rows as the result has: stores are dealt to tasks and meet the brands, which are one row each; pairs that are listed go by an
    anti-join on the pair.
    """
    stores = _stores(shelf).where("lacks > 0").select("retailer_id", "other_brand_listings")
    return stores.crossJoin(_brand_sizes(shelf)).join(shelf.partners.select("brand", "retailer_id"), ["brand", "retailer_id"], "left_anti")


def _brand_sizes(shelf: Shelf) -> DataFrame:
    return shelf.catalog.where("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("catalog_size"))


def first_doors(shelf: Shelf, retailers: DataFrame, limit: int = DOOR_LIMIT) -> DataFrame:
    """The first doors of the overview's list: those of stores that list most, then by name and brand.

    Pairs are unfolded for the first ``limit`` stores only: each of them lacks a brand at least, so they hold the list.
    """
    named = _stores(shelf).where("lacks > 0").join(retailers.select("retailer_id", "retailer_name"), "retailer_id")
    order = [F.col("other_brand_listings").desc(), F.collate("retailer_name", "UNICODE"), F.col("retailer_id")]
    first = named.orderBy(*order).limit(limit).drop("lacks")
    lacking = _brand_sizes(shelf).join(F.broadcast(first)).join(shelf.partners.select("brand", "retailer_id"), ["brand", "retailer_id"], "left_anti")
    return lacking.orderBy(*order, F.collate("brand", "UNICODE"), "brand").limit(limit)


def ordered_briefs(shelf: Shelf, retailers: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The briefs numbered in the order in which stores are shown: restocks to act on, pitches, stock-outs, then names; covered stores last."""
    briefs = store_briefs(shelf).join(retailers.select("retailer_id", "retailer_name"), "retailer_id")
    if observation:
        counts = [F.coalesce(F.sum("out_of_stock"), F.lit(0)).alias("restocks"), F.coalesce(F.sum("pitches"), F.lit(0)).alias("new_listings"), F.count_if(~F.col("covered")).alias("stores_with_gaps")]
        # ``with_place`` writes them once before they are dealt by ranges, so they are counted once.
        briefs = briefs.observe(observation, *counts)
    most = [F.col(c).desc() for c in ("actionable_restocks", "pitches", "out_of_stock")]
    return with_place(briefs, F.col("covered"), *most, F.collate("retailer_name", "UNICODE"), F.collate("brand", "UNICODE"), F.col("retailer_id"), F.col("brand"))


def overview(shelf: Shelf, products: DataFrame, retailers: DataFrame) -> DataFrame:
    """All lists of opportunities as one table, (list, place, brand, retailer_id, product_id, tone, value), with the counts as list ``summary``.

    What the lists leave out beyond their caps is counted while they are computed, by observations: no list is computed for its
    count. ``value`` is the number that a list goes by; in the summary, ``tone`` names the count.
    """
    of_briefs, of_unopened = Observation(), Observation()
    briefs = ordered_briefs(shelf, retailers, of_briefs)
    # Numbering has computed the briefs, so their counts are known.
    counts = dict(of_briefs.get)
    shown = F.when(F.col("covered"), F.col("place") - counts["stores_with_gaps"]).otherwise(F.col("place"))
    every = ["brand", "retailer_id", "product_id", "tone", "value"]

    def tagged(rows: DataFrame, name: str | Column, *order: Column, place: Column | None = None, **values: Column) -> DataFrame:
        """The rows of a capped list, numbered in one task: they are a few hundred."""
        types = {"brand": "string", "retailer_id": "bigint", "product_id": "bigint", "tone": "string", "value": "bigint"}
        number = F.row_number().over(Window.orderBy(*order)) if place is None else place
        columns = [values.get(c, F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in every]
        return rows.select((F.lit(name) if isinstance(name, str) else name).alias("list"), number.cast("int").alias("place"), *columns)

    best = [F.col("rank").desc(), F.col("in_stock_stores").desc(), F.col("store_missing").desc(), F.collate("name", "UNICODE"), F.collate("retailer_name", "UNICODE"), F.col("product_id"), F.col("retailer_id")]
    unopened = unopened_products(shelf).observe(of_unopened, F.count("*").alias("unopened_products"))
    names = [F.collate("name", "UNICODE"), F.collate("brand", "UNICODE"), F.col("product_id")]
    doors = [F.col("other_brand_listings").desc(), F.collate("retailer_name", "UNICODE"), F.col("retailer_id"), F.collate("brand", "UNICODE")]
    one = lambda rows, name, column: rows.select(F.lit("summary").alias("list"), F.lit(None).cast("int").alias("place"), *[(F.lit(name) if c == "tone" else F.col(column) if c == "value" else F.lit(None)).cast("string" if c in ("brand", "tone") else "bigint").alias(c) for c in every])
    lists = [
        tagged(briefs, F.when(F.col("covered"), "covered_stores").otherwise("stores"), place=shown, value=F.when(F.col("covered"), F.col("catalog_size")).otherwise(F.col("pitches"))),
        tagged(rank_opportunities(restocks(shelf), products, retailers), "restocks", *best, value=F.col("in_stock_stores")),
        tagged(first_pitches(shelf, products, retailers), "new_listings", *best, value=F.col("in_stock_stores")),
        tagged(unopened.orderBy(*names).limit(PRODUCT_LIMIT), "unopened_products", *names),
        tagged(first_doors(shelf, retailers), "unopened_doors", *doors, value=F.col("other_brand_listings")),
        one(door_count(shelf), "unopened_doors", "doors"),
        one(shelf.catalog.agg(F.count("*").alias("n")), "products", "n"),
        one(shelf.partners.agg(F.countDistinct("retailer_id").alias("n")), "partner_stores", "n"),
    ]
    written = checkpointed(reduce(DataFrame.unionByName, lists))
    counts |= of_unopened.get
    counts |= {f"{name}_truncated": int(counts[name] > LIST_LIMIT) for name in ("restocks", "new_listings")}
    known = shelf.catalog.sparkSession.createDataFrame(list(counts.items()), "tone string, value bigint")
    return written.unionByName(known.withColumn("list", F.lit("summary")), allowMissingColumns=True)


def summary(shelf: Shelf) -> DataFrame:
    """One row of counts over all brands."""
    counts = store_briefs(shelf).agg(
        F.coalesce(F.sum("out_of_stock"), F.lit(0)).alias("restocks"), F.coalesce(F.sum("pitches"), F.lit(0)).alias("new_listings"), F.count_if(~F.col("covered")).alias("stores_with_gaps")
    )
    return (
        shelf.catalog.agg(F.count("*").alias("products"))
        .join(shelf.partners.agg(F.countDistinct("retailer_id").alias("partner_stores")))
        .join(counts)
        .join(unopened_products(shelf).agg(F.count("*").alias("unopened_products")))
    )
