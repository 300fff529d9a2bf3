"""Page copy: versions, metrics, checks, score, and the gap to competitors, for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricescope.functions import lexicon, text
from pricescope.functions.numeric import round_half_up
from pricescope.session import checkpointed

TRACKED = ["title", "description", "bullets"]
#: What an unchanged page may still tell anew: a version has it as it was seen last.
REFRESHED = ["rating", "images", "language"]
#: Products that the overview looks at.
MOST_PRODUCTS = 500
LIMITS = {"missing": 25, "shared": 20, "unique": 15}


def content_hash(fields: list[str]) -> Column:
    """A digest of the tracked fields; nulls count as values."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def versions(snapshots: DataFrame, fields: list[str] = TRACKED) -> DataFrame:
    """The snapshots that differ from the one before of their source, numbered, with the fields that changed.

    A text that comes back is a new version. Snapshots without change only extend their version's last sight, and refresh what isn't tracked.
    """
    over = "OVER (PARTITION BY source_id ORDER BY captured_at, snapshot_id)"
    hashed = snapshots.withColumn("hash", content_hash(fields))
    marked = hashed.withColumn("before", F.expr(f"lag(struct({', '.join(fields)}, hash)) {over}"))
    marked = marked.withColumn("fresh", F.col("before").isNull() | (F.col("before.hash") != F.col("hash")))
    marked = marked.withColumn("version", F.expr(f"count_if(fresh) {over}"))
    refreshed = [f for f in REFRESHED if f in snapshots.columns]
    last = [F.max_by(F.struct(*refreshed), F.struct("captured_at", "snapshot_id")).alias("last")] if refreshed else []
    spans = marked.groupBy("source_id", "version").agg(F.min("captured_at").alias("since"), F.max("captured_at").alias("last_seen"), *last)
    spans = spans.select("source_id", "version", "since", "last_seen", *[F.col(f"last.{f}").alias(f) for f in refreshed])
    changed = F.filter(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    first = marked.where("fresh").select("source_id", "version", F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(changed).alias("changed"))
    return first.join(spans, ["source_id", "version"])


def latest_versions(snapshots: DataFrame) -> DataFrame:
    """Each source's newest version and the number of versions."""
    every = versions(snapshots)
    return every.groupBy("source_id").agg(F.max("version").alias("version_count"), F.max_by("since", "version").alias("content_since"))


def content_text(prefix: str = "") -> Column:
    """All copy of a page, one part a line; empty parts left out."""
    parts = [F.array("title", "meta", "description"), F.col("h1"), F.col("h2"), F.col("bullets"), F.col("faq")]
    return F.array_join(F.array_remove(F.concat(*parts), ""), "\n")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units; 0 for null."""
    return F.coalesce(F.octet_length(F.encode(value, "UTF-16BE")) / 2, F.lit(0)).cast("int")


def metrics(pages: DataFrame) -> DataFrame:
    return pages.withColumns(
        {
            "words": text.count_words(F.col("description")),
            "title_length": utf16_length(F.col("title")),
            "meta_length": utf16_length(F.col("meta")),
            "h1_count": F.size("h1"),
            "h2_count": F.size("h2"),
            "bullet_count": F.size("bullets"),
            "faq_count": F.size("faq"),
            "alt_coverage": F.when(F.col("images") > 0, round_half_up(F.col("with_alt") / F.col("images") * 100)),
            "has_rating": F.col("rating").isNotNull() | F.col("rating_count").isNotNull(),
        }
    )


def store_words() -> Column:
    """The words of a page's store: of its name and its host's first label."""
    host = F.get(F.split(F.coalesce(text.domain_of(F.col("url")), F.lit("")), r"\."), F.lit(0))
    return text.tokens(F.concat_ws(" ", "retailer_name", host))


def store_tokens(pages: DataFrame) -> DataFrame:
    """The words of the names and hosts of a product's stores: they aren't keywords."""
    return pages.select("product_id", F.explode(store_words()).alias("token")).distinct()


def _of_product(value: Column) -> Column:
    return value.over(Window.partitionBy("product_id"))


def page_terms(pages: DataFrame) -> DataFrame:
    """(product_id, source_id, is_own_store, captured, first_own, term, n) without the terms that hold a store's word.

    ``captured`` competitors' pages and the first own source come from windows over a product's pages, as do its stores' words: no
    side is joined, so none is broadcast.
    """
    keys = ["product_id", "source_id", "is_own_store", "captured", "first_own"]
    marked = pages.withColumns({"copy": content_text(), "store_words": store_words()}).select("product_id", "source_id", "is_own_store", "copy", "store_words")
    marked = marked.withColumns(
        {
            "captured": _of_product(F.count_if(~F.col("is_own_store"))),
            "first_own": _of_product(F.min(F.when(F.col("is_own_store"), F.col("source_id")))),
            "banned": _of_product(F.collect_set("store_words")),
        }
    )
    return text.term_counts(marked.withColumn("banned", F.array_distinct(F.flatten("banned"))), keys, "copy", "banned")


def least_pages(n: Column) -> Column:
    """Pages on which a term must stand to count as a term of the market."""
    return F.when(n >= 3, F.greatest(F.lit(2), F.ceil(n * 0.3))).otherwise(1)


def keyword_gap(pages: DataFrame) -> DataFrame:
    """Terms of each product's market that the own page lacks or shares, and own terms that no competitor uses.

    Limited by kind, in order of pages, occurrences, phrases first, and the term.
    """
    rival, of_own = ~F.col("is_own_store"), F.col("source_id") == F.col("first_own")
    usage = page_terms(pages).groupBy("product_id", "captured", "term").agg(F.count_if(rival).alias("pages"), F.sum(F.when(rival, F.col("n"))).alias("occurrences"), F.max(F.when(of_own, F.col("n"))).alias("own"))
    of_market = (F.col("pages") > 0) & (F.col("pages") >= least_pages(F.col("captured")))
    kind = F.when(of_market, F.when(F.col("own") > 0, "shared").otherwise("missing")).when((F.col("pages") == 0) & (F.col("own") >= 2), "unique")
    found = usage.select("product_id", "term", kind.alias("kind"), "pages", F.coalesce("occurrences", "own").alias("occurrences"), F.coalesce("own", F.lit(0)).alias("own")).where("kind IS NOT NULL")
    place = F.expr("row_number() OVER (PARTITION BY product_id, kind ORDER BY pages DESC, occurrences DESC, contains(term, ' ') AND kind <> 'unique' DESC, term)")
    limit = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    return found.withColumn("place", place).where(F.col("place") <= F.try_element_at(limit, F.col("kind")))


def first_own(pages: DataFrame) -> DataFrame:
    """The own page of each product, the first by source."""
    place = F.expr("row_number() OVER (PARTITION BY product_id ORDER BY source_id)")
    return pages.where("is_own_store").withColumn("place", place).where("place = 1").drop("place")


def attribute_table(pages: DataFrame) -> DataFrame:
    """(product_id, attribute, own, competitors_with, captured): own is null where the own page isn't captured.

    One aggregation by product; the facts are its columns before they become rows.
    """
    names = [name for name, _, _ in lexicon.ATTRIBUTES]
    own = F.col("is_own_store")
    found = pages.withColumn("copy", content_text()).select("product_id", "source_id", "is_own_store", text.detect_attributes(F.col("copy")).alias("found"))
    grouped = found.groupBy("product_id").agg(
        F.min_by(F.when(own, F.col("found")), F.when(own, F.col("source_id"))).alias("own_found"),
        F.count_if(~own).alias("captured"),
        *[F.count_if(~own & F.array_contains("found", name)).alias(f"with_{name}") for name in names],
    )
    rows = F.array(*[F.struct(F.lit(name).alias("attribute"), F.col(f"with_{name}").alias("competitors_with")) for name in names])
    every = grouped.select("product_id", "own_found", "captured", F.inline(rows))
    return every.select("product_id", "attribute", F.array_contains("own_found", F.col("attribute")).alias("own"), "competitors_with", "captured")


def missing_facts(attributes: DataFrame) -> DataFrame:
    """Facts that at least half of the captured competitors mention and the own page doesn't."""
    asked = F.greatest(F.lit(1.0), F.col("captured") / 2)
    return attributes.where(~F.col("own") & (F.col("competitors_with") >= asked)).select("product_id", "attribute")


def similarities(pages: DataFrame) -> DataFrame:
    """(product_id, source_id, similarity): each competitor's description against the own one, which is the product's first row in order."""
    described = pages.where("description <> ''").select("product_id", "source_id", "retailer_name", "is_own_store", text.tokens(F.col("description")).alias("tokens"))
    in_order = Window.partitionBy("product_id").orderBy(F.coalesce("is_own_store", F.lit(False)).desc(), "source_id")
    first = F.first(F.struct("is_own_store", "tokens")).over(in_order)
    compared = described.withColumn("first", first).where("NOT is_own_store AND first.is_own_store")
    return compared.select("product_id", "source_id", "retailer_name", text.similarity(F.col("first.tokens"), F.col("tokens")).alias("similarity"))


def check_table(pages: DataFrame) -> DataFrame:
    """(product_id, check, status) of every product with an own page. Some checks exist only where they mean something."""
    measured = metrics(pages)
    own = first_own(measured)
    peers = measured.where("NOT is_own_store").groupBy("product_id").agg(
        F.count("*").alias("peers"),
        F.median(F.when(F.col("words") > 0, F.col("words"))).alias("median_words"),
        F.count_if(F.col("bullet_count") > 0).alias("bullet_peers"),
        F.count_if(F.col("faq_count") > 0).alias("faq_peers"),
        F.count_if("has_rating").alias("rating_peers"),
    )
    most = similarities(pages).groupBy("product_id").agg(F.max("similarity").alias("most_similar"))
    missing = keyword_gap(pages).where("kind = 'missing'").groupBy("product_id").agg(F.count("*").alias("missing_keywords"))
    facts = missing_facts(attribute_table(pages)).groupBy("product_id").agg(F.count("*").alias("missing_facts"))
    rows = own
    for side in (peers, most, missing, facts):
        # As many rows as products: too many to broadcast, however small the table of products is on disk.
        rows = rows.join(side.hint("merge"), "product_id", "left")
    rows = rows.fillna(0, ["peers", "bullet_peers", "faq_peers", "rating_peers", "missing_keywords", "missing_facts"])

    def within(name: str, length: str, limits: tuple[int, int]) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", "fail").when(F.col(length).between(*limits), "pass").otherwise("warn")

    words, similar, peers_n = F.col("words"), F.col("most_similar"), F.col("peers")
    status = {
        "title": within("title", "title_length", lexicon.TITLE_LENGTH),
        "meta_description": within("meta", "meta_length", lexicon.META_LENGTH),
        "h1": F.when(F.col("h1_count") == 0, "fail").when(F.col("h1_count") > 1, "warn").otherwise("pass"),
        "description": F.when(words == 0, "fail").when(words < F.col("median_words") * 0.5, "warn").when(words < lexicon.LEAST_WORDS, "warn").otherwise("pass"),
        "duplicate": F.when(similar.isNull(), "info").when(similar >= lexicon.DUPLICATE, "fail").when(similar >= lexicon.SIMILAR, "warn").otherwise("pass"),
        "keywords": F.when(peers_n > 0, F.when(F.col("missing_keywords") > 5, "warn").otherwise("pass")),
        "attributes": F.when(F.col("missing_facts") > 0, "warn").when(peers_n > 0, "pass"),
        "bullets": F.when(F.col("bullet_count") > 0, "pass").when((F.col("bullet_peers") > 0) & (F.col("bullet_peers") >= peers_n / 2), "warn"),
        "faq": F.when(F.col("faq_count") > 0, "pass").when(F.col("faq_peers") > 0, "warn").otherwise("info"),
        "rating": F.when(F.col("has_rating"), "pass").when(F.col("rating_peers") > 0, "warn"),
        "image_alt": F.when(F.col("alt_coverage").isNotNull(), F.when(F.col("alt_coverage") < lexicon.LEAST_ALT_COVERAGE, "warn").otherwise("pass")),
    }
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("check"), s.alias("status")) for i, (name, s) in enumerate(status.items())])
    return rows.select("product_id", F.inline(listed)).where("status IS NOT NULL")


def scores(checks: DataFrame) -> DataFrame:
    """One row for each product: score (passes among checks that aren't only informative), failures and warnings."""
    grouped = checks.groupBy("product_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passes"), ("fail", "fails"), ("warn", "warnings"))])
    judged = F.col("passes") + F.col("fails") + F.col("warnings")
    return grouped.withColumn("score", round_half_up(F.try_divide(F.col("passes"), judged) * 100)).drop("passes")


def capped_overview(pages: DataFrame, products: DataFrame, limit: int = MOST_PRODUCTS) -> DataFrame:
    """The overview of the products that were checked last, at most ``limit``, and whether there are more (``truncated``).

    They are chosen before any work on copy: of the pages, only theirs are read on.
    """
    first = products.orderBy(F.col("last_checked_at").desc(), F.col("product_id")).limit(limit + 1)
    chosen = checkpointed(first.select("product_id", F.row_number().over(Window.orderBy(F.col("last_checked_at").desc(), F.col("product_id"))).alias("recency")))
    truncated = chosen.agg((F.count("*") > limit).alias("truncated"))
    shown = chosen.where(F.col("recency") <= limit)
    rows = overview(pages.join(F.broadcast(shown.select("product_id")), "product_id", "left_semi"), shown.select("product_id"))
    return rows.join(F.broadcast(shown), "product_id").join(F.broadcast(truncated))


def overview(pages: DataFrame, products: DataFrame) -> DataFrame:
    """Every product with its score, band, and the key of each sort; nulls come last in either direction."""
    rows = products.join(scores(check_table(pages)).hint("merge"), "product_id", "left")
    band = F.when(F.col("score").isNull(), "not_captured").when(F.col("score") >= lexicon.GOOD_SCORE, "good").otherwise("needs_work")
    return rows.select("product_id", "score", "fails", "warnings", band.alias("band"), (F.col("fails") * 100 + F.col("warnings")).alias("issues"))


def overview_summary(rows: DataFrame) -> DataFrame:
    """One row: products, mean score, and numbers by band."""
    return rows.agg(
        F.count("*").alias("analyzed"),
        round_half_up(F.try_divide(F.sum("score").cast("double"), F.count("score"))).alias("average_score"),
        F.count_if(F.col("band") == "needs_work").alias("needs_work"),
        F.count_if(F.col("band") == "not_captured").alias("not_captured"),
    )
