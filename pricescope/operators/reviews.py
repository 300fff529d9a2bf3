"""What reviews say: sentiment, themes, keywords, gaps and campaign briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions import lexicon, text
from pricescope.functions.numeric import round_half_up

LABELS = {name: label for name, label, _, _ in lexicon.THEMES}


def label_of(theme: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), theme)


def one_decimal(value: Column) -> Column:
    return round_half_up(value * 10) / 10


def finite(rating: Column) -> Column:
    return F.when(~F.isnan(rating) & (F.abs(rating) < float("inf")), rating)


def enrich(reviews: DataFrame) -> DataFrame:
    """Add sentiment, themes, usability, and whether the review is about the store alone."""
    themes = text.detect_themes(F.col("body"))
    store_only = (F.size("themes") > 0) & F.forall("themes", lambda t: t.isin(lexicon.STORE_THEMES))
    return (
        reviews.withColumn("rating", finite(F.col("rating")))
        .withColumns({"sentiment": text.sentiment(F.col("rating"), F.col("body")), "themes": themes, "usable": text.is_usable_review(F.col("body"))})
        .withColumn("store_issue", store_only)
    )


def counts(*more: Column) -> list[Column]:
    """Aggregates of a group of enriched reviews."""
    kinds = [F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")]
    mean = F.try_divide(F.sum(F.col("rating").cast("decimal(18, 6)")).cast("double"), F.count("rating"))
    return [F.count("*").alias("total"), F.count("rating").alias("with_rating"), one_decimal(mean).alias("average_rating"), *kinds, *more]


def summarize(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: numbers of reviews, mean rating, sentiments and their percentages."""
    grouped = reviews.groupBy(*keys).agg(*counts())
    share = lambda c: round_half_up(F.try_divide(F.col(c), F.col("total")) * 100)
    return grouped.withColumns({"positive_percentage": share("positive"), "negative_percentage": share("negative")})


def _theme_counts() -> list[Column]:
    return [F.count("*").alias("mentions"), *[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")]]


def _with_net(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"net_sentiment": (F.col("positive") - F.col("negative")) / F.col("mentions"), "label": label_of(F.col("theme"))})


def theme_stats(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions of each theme by sentiment; net is (positive - negative) / mentions.

    Outer, since otherwise the planner asks for the lists' sizes beneath and judges each text twice.
    """
    exploded = reviews.select(*keys, "sentiment", F.explode_outer("themes").alias("theme")).where("theme IS NOT NULL")
    return _with_net(exploded.groupBy(*keys, "theme").agg(*_theme_counts()))


#: What stands for a theme where a store's complaints are counted.
STORE = ""


def brand_counts(reviews: DataFrame) -> DataFrame:
    """(brand, theme, retailer_id, official, mentions, positive, neutral, negative) of usable reviews: themes by brand, of reviews that aren't about the store
    alone, and complaints about delivery and service by brand and store (theme ``STORE``).

    All insights come from these. A review is judged once: no filter goes beneath, where what its text says would be found anew for each condition.
    """
    complaint = F.col("store_issue") & (F.col("sentiment") == "negative")
    themes = F.when(F.col("usable") & ~F.col("store_issue"), F.col("themes")).when(F.col("usable") & complaint, F.array(F.lit(STORE)))
    said = reviews.select("brand", "retailer_id", "is_official", "sentiment", F.explode_outer(themes).alias("theme")).where("theme IS NOT NULL")
    store = F.when(F.col("theme") == STORE, F.col("retailer_id")).alias("retailer_id")
    return said.groupBy("brand", "theme", store).agg(F.bool_and("is_official").alias("official"), *_theme_counts())


def top_themes(stats: DataFrame, keys: list[str], kind: str, n: int = 3) -> DataFrame:
    """The most praised (or complained of) themes of a group."""
    good, bad, direction = ("positive", "negative", "DESC") if kind == "praised" else ("negative", "positive", "ASC")
    over = f"PARTITION BY {', '.join(keys)} ORDER BY {good} DESC, net_sentiment {direction}, theme"
    return stats.where(F.col(good) >= F.col(bad)).withColumn("place", F.expr(f"row_number() OVER ({over})")).where(F.col("place") <= n)


def top_keywords(reviews: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """The most frequent words of positive and of negative reviews."""
    opinionated = reviews.where("sentiment <> 'neutral'")
    terms = text.term_counts(opinionated.select(*keys, "sentiment", "review_id", "body"), [*keys, "sentiment", "review_id"], "body").where("NOT contains(term, ' ')")
    grouped = terms.groupBy(*keys, "sentiment", "term").agg(F.sum("n").alias("n"))
    over = f"PARTITION BY {', '.join([*keys, 'sentiment'])} ORDER BY n DESC, term COLLATE UNICODE"
    return grouped.withColumn("place", F.expr(f"row_number() OVER ({over})")).where(F.col("place") <= n)


def find_reviews(reviews: DataFrame, query: str | None = None, theme: str | None = None, sentiment: str | None = None) -> DataFrame:
    """Reviews whose text, product or store contains the query, about a theme, of a sentiment."""
    wanted = F.lit(True)
    if query:
        hay = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("body", "name", "brand", "retailer_name")])
        wanted = wanted & F.contains(F.lower(hay), F.lower(F.lit(query)))
    if theme:
        wanted = wanted & F.array_contains("themes", theme)
    if sentiment:
        wanted = wanted & (F.col("sentiment") == sentiment)
    return reviews.where(wanted)


def review_gaps(reviews: DataFrame, products: DataFrame, n: int = 40) -> DataFrame:
    """Own rating against the competitors' median, and own against competing numbers of reviews; the worst first."""
    rating = F.col("rating")
    own_mean = F.try_divide(F.sum(F.when(F.col("is_own_store"), rating).cast("decimal(18, 6)")).cast("double"), F.count(F.when(F.col("is_own_store"), rating)))
    grouped = reviews.groupBy("product_id").agg(
        F.count_if("is_own_store").alias("own_reviews"),
        F.count_if(~F.col("is_own_store")).alias("competitor_reviews"),
        one_decimal(own_mean).alias("own_average"),
        F.median(F.when(~F.col("is_own_store"), rating)).alias("raw_median"),
    )
    gaps = grouped.join(products, "product_id").select(
        "product_id",
        "name",
        "own_reviews",
        "competitor_reviews",
        "own_average",
        one_decimal(F.col("raw_median")).alias("competitor_median"),
        one_decimal(F.col("own_average") - F.col("raw_median")).alias("rating_gap"),
        (F.col("own_reviews") - F.col("competitor_reviews")).alias("count_gap"),
    )
    return gaps.orderBy(F.coalesce("rating_gap", F.lit(0.0)), "count_gap", "name").limit(n)


def product_angles(reviews: DataFrame) -> DataFrame:
    """For each product, of usable reviews that aren't about the store: counts, themes, and up to three quotes either way."""
    usable = reviews.where("usable AND NOT store_issue")
    quotable = F.length(text.clean_review(F.col("body"))) >= 18
    quote = F.struct((-F.col("is_official").cast("int")).alias("official"), (-F.length("body")).alias("length"), F.col("review_id"), text.clip_quote(F.col("body")).alias("quote"))
    plain = F.struct((-F.length("body")).alias("length"), F.col("review_id"), text.clip_quote(F.col("body")).alias("quote"))
    first_three = lambda kind, what: F.transform(F.slice(F.array_sort(F.collect_list(F.when((F.col("sentiment") == kind) & quotable, what))), 1, 3), lambda q: q["quote"])
    grouped = usable.groupBy("product_id", "brand").agg(*counts(first_three("positive", quote).alias("praise"), first_three("negative", plain).alias("complaints")))
    return grouped.select("product_id", "brand", F.col("total").alias("review_count"), "average_rating", "positive", "negative", "praise", "complaints")


def brand_theme_insights(counts: DataFrame) -> DataFrame:
    """Strengths (mostly praised themes) and weaknesses (mostly criticised ones) of each brand, with their priority; of ``brand_counts``."""
    stats = counts.where(F.col("theme") != STORE)
    strong = (F.col("positive") >= 2) & (F.col("positive") > F.col("negative"))
    weak = (F.col("negative") >= 1) & (F.col("negative") >= F.col("positive"))
    kind = F.when(strong, "strength").when(weak, "our_weakness")
    priority = F.when(strong, 60 + 3 * F.col("positive")).when(weak, 72 + 4 * F.col("negative"))
    return stats.select(kind.alias("type"), "brand", "theme", "mentions", priority.alias("priority")).where("type IS NOT NULL")


def competitor_weaknesses(counts: DataFrame, brand: str) -> DataFrame:
    """Themes that the brand is praised for and others are criticised for; of ``brand_counts``. A review without a brand is of neither."""
    ours = F.lower(F.trim("brand")) == brand.strip().lower()
    total = lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
    stats = counts.where(F.col("theme") != STORE).groupBy("theme").agg(
        total("positive", ours).alias("our_praise"), total("mentions", ours).alias("our_mentions"), total("negative", ~ours).alias("their_complaints")
    )
    return stats.where("our_praise >= 1 AND their_complaints >= 1").select(
        F.lit("competitor_weakness").alias("type"), "theme", "our_praise", "their_complaints", (78 + 3 * F.col("their_complaints")).alias("priority"), (F.col("our_mentions") + F.col("their_complaints")).alias("review_count")
    )


def store_issues(counts: DataFrame) -> DataFrame:
    """Complaints about delivery and service, by brand and store; of ``brand_counts``."""
    rows = counts.where(F.col("theme") == STORE)
    return rows.select("brand", "retailer_id", F.col("mentions").alias("n"), "official", (68 + 5 * F.col("mentions")).alias("priority"))


def review_gap_products(reviews: DataFrame, products: DataFrame, n: int = 8) -> DataFrame:
    """The first products without a usable review."""
    return products.join(reviews.where("usable").select("product_id"), "product_id", "left_anti").orderBy("product_id").limit(n)


def store_rules(stats: DataFrame, gaps: DataFrame) -> DataFrame:
    """Insights (type, subject, priority) from themes by store (``theme_stats`` with retailer_id and is_own_store) and review gaps in order.

    The own store is the first of that kind. Each rule is a table; equal places go by theme. Limits are those of the lists.
    """
    first = stats.where("is_own_store").agg(F.min("retailer_id").alias("own_id"))
    own = stats.where("is_own_store").join(first, F.col("retailer_id") == F.col("own_id")).drop("own_id")
    rivals = stats.where("NOT is_own_store")
    whole = lambda x: F.floor(x * 10 + 0.5).cast("bigint")
    first_of = lambda rows, order, n: rows.orderBy(*order).limit(n)

    weak = rivals.where("mentions >= 2 AND negative >= positive AND net_sentiment < -0.15").groupBy("theme").agg(F.count("*").alias("n"))
    ours = F.coalesce("net_sentiment", F.lit(0.0))
    against = weak.join(own.select("theme", "net_sentiment"), "theme", "left").where(ours >= 0)
    rules = [against.select(F.lit("competitor_weakness").alias("type"), F.col("theme").alias("subject"), (80 + 5 * F.col("n") + whole(F.abs(ours))).alias("priority"))]
    bad = first_of(own.where("mentions >= 2 AND negative > positive"), [F.col("negative").desc(), "net_sentiment", "theme"], 5)
    rules.append(bad.select(F.lit("our_weakness"), "theme", 70 + 3 * F.col("negative")))
    good = first_of(own.where("mentions >= 2 AND positive > negative AND net_sentiment > 0.2"), [F.col("positive").desc(), "theme"], 4)
    rules.append(good.select(F.lit("strength"), "theme", 55 + 2 * F.col("positive")))

    order = [F.coalesce("rating_gap", F.lit(0.0)), "count_gap", "name"]
    product = F.concat(F.lit("product:"), "product_id")
    better = first_of(gaps.where("rating_gap >= 0.3 AND own_reviews >= 2"), order, 5)
    rules.append(better.select(F.lit("strength"), product, 50 + whole(F.col("rating_gap"))))
    behind = first_of(gaps.where("count_gap < -2 OR (rating_gap < -0.3 AND competitor_reviews >= 2)"), order, 8)
    rules.append(behind.select(F.lit("review_gap"), product, 60 + F.greatest(F.lit(0), -F.col("count_gap")) + F.greatest(F.lit(0), whole(-F.coalesce("rating_gap", F.lit(0.0))))))
    dear = rivals.where("theme = 'price' AND mentions >= 2 AND negative > positive").agg(F.count("*").alias("n")).where("n > 0")
    rules.append(dear.select(F.lit("price_value"), F.lit("market"), 65 + 4 * F.col("n")))
    every = rules[0]
    for rule in rules[1:]:
        every = every.union(rule)
    return every
