"""Queries of text, content and reviews: over documents for volume, over fixtures for the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.functions import lexicon, text
from pricescope.operators import content, reviews
from pricescope.operators.listing import with_place
from pricescope.operators.matrix import select_products
from pricescope.session import checkpointed
from pricescope.sources import written
from pricescope.sources.domain import Domain


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of long texts for all cores, where the input has fewer splits than there are cores; large inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def t05_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.count_words(F.col("text")).alias("words"), F.size(text.tokens(F.col("text"))).alias("tokens"))


def t06_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_terms(_dealt(documents(spark, sf_dir).select("lang", "doc_id", "text")), "lang", "doc_id", "text", 50)


def t08_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one by id: a document goes to two pairs, its own and that of the one before."""
    terms = text.distinct_tokens(F.col("text"))
    held = _dealt(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", terms.alias("terms"))
    # Repeated tokens matter to short texts only.
    n = F.when(F.size("terms") >= lexicon.LEAST_TOKENS, F.size("terms")).otherwise(F.size(text.tokens(F.col("text"))))
    sides = held.select("doc_id", F.struct(n.alias("n"), "terms").alias("one")).select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1)).alias("doc_id"), "one")
    pairs = sides.groupBy("doc_id").agg(F.collect_list("one").alias("two")).where(F.size("two") == 2)
    a, b = F.get("two", 0), F.get("two", 1)
    return pairs.select("doc_id", text.vocabulary_overlap(a["n"], a["terms"], b["n"], b["terms"]).alias("similarity"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.enrich(written.reviews(spark, sf_dir)).withColumn("is_official", F.col("is_own_store"))
    return rows.join(written.review_products(spark, sf_dir), "product_id").join(written.review_stores(spark, sf_dir), "retailer_id")


def t04_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("review_id", F.array_join(text.tokens(F.col("body")), " ").alias("tokens"))


def u01_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("review_id", "sentiment", text.text_sentiment(F.col("body")).alias("by_words"), F.array_join("themes", ",").alias("themes"))


def t23_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("review_id", text.review_language(F.col("body"), F.when(F.col("review_id") % 2 == 0, "FR-fr")).alias("language"))


def u10_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).select("review_id", "usable", "store_issue", text.clip_quote(F.col("body")).alias("quote"))


def u05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.summarize(_reviews(spark, sf_dir), ["product_id"])


def u07_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.summarize(_reviews(spark, sf_dir), ["retailer_id", "retailer_name"])


def d15_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.theme_stats(_reviews(spark, sf_dir), ["brand"])


def g12_praised(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both lists read it: reviews are judged once.
    stats = checkpointed(reviews.theme_stats(_reviews(spark, sf_dir), ["retailer_id"]))
    both = [reviews.top_themes(stats, ["retailer_id"], kind).withColumn("kind", F.lit(kind)) for kind in ("praised", "complained")]
    return both[0].unionByName(both[1]).select("kind", "retailer_id", "theme", "place")


def g10_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top keywords in any script."""
    return reviews.top_keywords(_reviews(spark, sf_dir), ["brand"]).select("brand", "sentiment", "term", "n")


def b06_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.find_reviews(_reviews(spark, sf_dir), "STORE 3", "scent", "positive").select("review_id")


def e09_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight newest negative reviews, by publication or else by first sight."""
    dated = _reviews(spark, sf_dir).withColumn("seen", F.coalesce(F.when(F.col("review_id") % 3 == 0, F.col("review_id") * 7 % 31), F.col("review_id") % 31))
    return dated.where("sentiment = 'negative'").orderBy(F.col("seen").desc(), "review_id").limit(8).select("review_id", "seen")


def u08_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = written.review_products(spark, sf_dir)
    return reviews.review_gaps(_reviews(spark, sf_dir), products.select("product_id", "name"))


def u12_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = reviews.product_angles(_reviews(spark, sf_dir))
    return angles.withColumns({"praise": F.array_join("praise", "|"), "complaints": F.array_join("complaints", "|")})


def u13_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.brand_theme_insights(reviews.brand_counts(_reviews(spark, sf_dir)))


def u14_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.competitor_weaknesses(reviews.brand_counts(_reviews(spark, sf_dir)), "brand a")


def u15_store_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.store_issues(reviews.brand_counts(_reviews(spark, sf_dir)))


def u16_gap_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = written.review_products(spark, sf_dir)
    return reviews.review_gap_products(_reviews(spark, sf_dir), products).select("product_id", "name")


def u18_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("\x00", F.lit("author"), F.lit(""), "body")
    return _reviews(spark, sf_dir).select("review_id", F.substring(F.sha2(parts, 256), 1, 32).alias("hash"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written.content_pages(spark, sf_dir)


def t09_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("source_id", F.array_join(text.detect_attributes(content.content_text()), ",").alias("attributes"))


def t11_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["source_id", "words", "title_length", "meta_length", "h1_count", "h2_count", "bullet_count", "faq_count", "alt_coverage", "has_rating"]
    return content.metrics(_pages(spark, sf_dir)).select(*wanted)


def t12_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("source_id", content.content_text().alias("copy"))


def t10_store_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.store_tokens(_pages(spark, sf_dir))


def t07_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.keyword_gap(_pages(spark, sf_dir)).drop("place")


def t15_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.missing_facts(content.attribute_table(_pages(spark, sf_dir)))


def t16_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.similarities(_pages(spark, sf_dir)).drop("retailer_name")


def t13_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.check_table(_pages(spark, sf_dir))


def t14_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.overview(_pages(spark, sf_dir), written.review_products(spark, sf_dir).select("product_id"))


def t20_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products checked last, the most recent first, and whether some were left out."""
    products = select_products(Domain(spark, sf_dir).products, demo=False)
    return content.capped_overview(_pages(spark, sf_dir), products).select("product_id", "recency", "score", "band", "truncated")


def t19_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.overview_summary(t14_scores(spark, sf_dir))


def g04_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By score descending; products without one come last, ties by id."""
    return with_place(t14_scores(spark, sf_dir).select("product_id", "score"), F.col("score").desc_nulls_last(), F.col("product_id"))


def l03_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content.versions(written.snapshots(spark, sf_dir))
    return rows.withColumn("changed", F.array_join("changed", ","))


def l04_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.latest_versions(written.snapshots(spark, sf_dir))


def l01_pages_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with equal markup, found by digest."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.groupBy(F.sha2("html", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def t21_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.domain_of(F.col("url")).alias("domain"))


def d18_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviews(spark, sf_dir).select("review_id", text.english_list(F.col("themes")).alias("listed"))
    return rows


QUERIES = {
    "t04_t01_t02_t03_tokens": t04_tokens,
    "t05_word_counts": t05_word_counts,
    "t06_d13_d14_term_counts": t06_term_counts,
    "t07_g11_keyword_gap": t07_gap,
    "t08_i03_similarity": t08_similarity,
    "t09_attributes": t09_attributes,
    "t10_store_tokens": t10_store_tokens,
    "t11_metrics": t11_metrics,
    "t12_content_text": t12_text,
    "t13_checks": t13_checks,
    "t14_t17_t18_overview": t14_scores,
    "t15_missing_facts": t15_facts,
    "t16_similarities": t16_similarities,
    "t20_content_overview": t20_overview,
    "t19_overview_summary": t19_summary,
    "t21_domains": t21_domains,
    "t23_language": t23_language,
    "g04_sorted_overview": g04_sorted,
    "d18_english_lists": d18_lists,
    "l01_page_digests": l01_pages_hash,
    "l02_l03_e06_versions": l03_versions,
    "l04_d06_latest_versions": l04_latest,
    "u01_u04_sentiment_themes": u01_sentiment,
    "u05_summaries": u05_summary,
    "u07_store_summaries": u07_stores,
    "u08_g16_review_gaps": u08_gaps,
    "u10_u11_usable": u10_usable,
    "u12_product_angles": u12_angles,
    "u13_brand_insights": u13_insights,
    "u14_competitor_weaknesses": u14_competitors,
    "u15_store_issues": u15_store_issues,
    "u16_c06_review_gap": u16_gap_products,
    "u18_review_hash": u18_hash,
    "d15_theme_stats": d15_themes,
    "g10_keywords": g10_keywords,
    "g12_top_themes": g12_praised,
    "b06_b07_find_reviews": b06_find,
    "e09_recent_reviews": e09_recent,
}

# Oracle SQL, with words as rows and RE2 patterns.


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def norm(x: str) -> str:
    return f"regexp_replace(translate({x}, '٠١٢٣٤٥٦٧٨٩أإآٱىة', '0123456789اااايه'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g')"


def words_sql(name: str, rows: str, keys: str, x: str) -> str:
    """(keys, i, t): the words of every row, t null where a word says nothing."""
    strip = f"""CASE WHEN NOT regexp_matches(w, '[\\x{{0600}}-\\x{{06FF}}]') THEN w WHEN left(w, 3) IN ({_quoted(lexicon.ARTICLES)}) AND length(w) >= 6 THEN substr(w, 4)
      WHEN left(w, 2) IN ('لل', 'ال') AND length(w) >= 5 THEN substr(w, 3) ELSE w END"""
    return f"""
{name} AS (
  SELECT {keys}, i, CASE WHEN s NOT IN ({_quoted(text.STOPWORDS)}) AND NOT regexp_full_match(s, '[0-9]+')
      AND CASE WHEN regexp_full_match(s, '[a-z]+') THEN length(s) >= 3 ELSE length(s) >= 2 END THEN s END AS t
  FROM (SELECT {keys}, i, {strip} AS s FROM (
    SELECT {keys}, unnest(range(len(ws))) AS i, {norm("lower(unnest(ws))")} AS w FROM (SELECT {keys}, regexp_extract_all({norm(f"coalesce({x}, '')")}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM {rows}))))"""


def terms_sql(name: str, words: str, keys: str) -> str:
    return f"""
{name} AS (
  SELECT {keys}, term, count(*) AS n FROM (
    SELECT {keys}, t AS term FROM {words} UNION ALL SELECT {keys}, t || ' ' || nxt FROM (SELECT {keys}, t, lead(t) OVER (PARTITION BY {keys} ORDER BY i) AS nxt FROM {words}))
  WHERE term IS NOT NULL GROUP BY ALL)"""


_THEME_LIST = ", ".join(f"CASE WHEN regexp_matches(nb, '\\b(?:{en})\\b|{ar}') THEN '{name}' END" for name, _, en, ar in lexicon.THEMES)
_REVIEWS = (
    written.REVIEWS_SQL,
    words_sql("words", "raw", "review_id", "body"),
    f"""
scored AS (SELECT review_id, count(*) FILTER (t IN ({_quoted(text.POSITIVE)})) AS pos, count(*) FILTER (t IN ({_quoted(text.NEGATIVE)})) AS neg FROM words GROUP BY 1),
judged AS (
  SELECT raw.* EXCLUDE (rating), CASE WHEN isnan(rating) THEN NULL ELSE rating END AS rating, coalesce(pos, 0) AS pos,
    coalesce(neg, 0) + CASE WHEN regexp_matches({norm("lower(body)")}, 'لا\\s*انصح|ما\\s*انصح') THEN 2 ELSE 0 END AS neg, {norm("lower(body)")} AS nb,
    trim(regexp_replace(regexp_replace(body, '(?i)\\s*read more\\s*$', ''), '\\s+', ' ', 'g')) AS clean
  FROM raw LEFT JOIN scored USING (review_id)),
reviews AS (
  SELECT *, list_filter([{_THEME_LIST}], lambda x: x IS NOT NULL) AS themes, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS by_words,
    CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' WHEN rating IS NOT NULL THEN 'neutral' WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment,
    length(clean) >= 8 AND lower(clean) NOT IN ('see full review', 'read more') AS usable, is_own_store AS is_official,
    CASE WHEN length(clean) > 220 THEN left(clean, 217) || '…' ELSE clean END AS quote
  FROM judged JOIN review_products USING (product_id) JOIN review_stores USING (retailer_id)),
r AS (SELECT *, len(themes) > 0 AND len(list_filter(themes, lambda x: x NOT IN ('delivery', 'customer_service'))) = 0 AS store_issue FROM reviews),
themed AS (SELECT *, unnest(themes) AS theme FROM r)""",
)


def _over(select: str) -> str:
    return "WITH " + ",".join(_REVIEWS) + "\n" + select


def _summary(keys: str) -> str:
    mean = "CAST(sum(CAST(rating AS DECIMAL(18, 6))) AS DOUBLE) / nullif(count(rating), 0)"
    return f"""SELECT *, CAST(floor(positive / total * 100 + 0.5) AS BIGINT) AS positive_percentage, CAST(floor(negative / total * 100 + 0.5) AS BIGINT) AS negative_percentage FROM (
      SELECT {keys}, count(*) AS total, count(rating) AS with_rating, floor({mean} * 10 + 0.5) / 10 AS average_rating, count(*) FILTER (sentiment = 'positive') AS positive,
        count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM r GROUP BY ALL)"""


def _themes(keys: str, where: str = "TRUE") -> str:
    labels = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label, _, _ in lexicon.THEMES)
    return f"""SELECT *, (positive - negative) / mentions AS net_sentiment, CASE theme {labels} END AS label FROM (
      SELECT {keys}, theme, count(*) AS mentions, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative
      FROM themed WHERE {where} GROUP BY ALL)"""


_GOOD = "usable AND NOT store_issue"
_ATTRIBUTES = ", ".join(f"CASE WHEN regexp_matches(copy, '(?i){p.replace('(?![a-z])', '(?:[^a-zA-Z]|$)')}') THEN '{name}' END" for name, _, p in lexicon.ATTRIBUTES)
_CONTENT = (
    written.CONTENT_SQL,
    f"""
pages1 AS (
  SELECT *, coalesce(len(regexp_extract_all(description, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')), 0) AS words, coalesce(length(title), 0) AS title_length, coalesce(length(meta), 0) AS meta_length,
    len(h1) AS h1_count, len(h2) AS h2_count, len(bullets) AS bullet_count, len(faq) AS faq_count, CASE WHEN images > 0 THEN CAST(floor(with_alt / images * 100 + 0.5) AS BIGINT) END AS alt_coverage,
    rating IS NOT NULL OR rating_count IS NOT NULL AS has_rating,
    array_to_string(list_filter(list_concat([title, meta, description], h1, h2, bullets, faq), lambda x: x <> ''), chr(10)) AS copy FROM pages0),
pages2 AS (SELECT *, list_filter([{_ATTRIBUTES}], lambda x: x IS NOT NULL) AS found FROM pages1),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY source_id) AS rn FROM pages2 WHERE is_own_store) WHERE rn = 1),
names AS (SELECT product_id, source_id, retailer_name || ' ' || split_part(regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', ''), '.', 1) AS x FROM pages0)""",
    words_sql("name_words", "names", "product_id, source_id", "x"),
    "store_tokens AS (SELECT DISTINCT product_id, t AS token FROM name_words WHERE t IS NOT NULL)",
    words_sql("copy_words", "pages1", "product_id, source_id", "copy"),
    terms_sql("all_terms", "copy_words", "product_id, source_id"),
    """
terms AS (
  SELECT a.*, is_own_store FROM all_terms a JOIN pages0 USING (product_id, source_id)
  WHERE NOT EXISTS (SELECT 1 FROM store_tokens s WHERE s.product_id = a.product_id AND list_contains(string_split(a.term, ' '), s.token))),
captured AS (SELECT product_id, count(*) AS peers, median(words) FILTER (words > 0) AS median_words, count(*) FILTER (bullet_count > 0) AS bullet_peers, count(*) FILTER (faq_count > 0) AS faq_peers,
  count(*) FILTER (has_rating) AS rating_peers FROM pages2 WHERE NOT is_own_store GROUP BY 1),
usage AS (SELECT product_id, term, count(*) AS pages, CAST(sum(n) AS BIGINT) AS occurrences FROM terms WHERE NOT is_own_store GROUP BY ALL),
own_terms AS (SELECT product_id, term, n FROM terms WHERE source_id IN (SELECT source_id FROM own)),
gap0 AS (
  SELECT product_id, term, CASE WHEN n > 0 THEN 'shared' ELSE 'missing' END AS kind, pages, occurrences, coalesce(n, 0) AS own
  FROM usage JOIN captured USING (product_id) LEFT JOIN own_terms USING (product_id, term) WHERE pages >= CASE WHEN peers >= 3 THEN greatest(2, ceil(peers * 0.3)) ELSE 1 END
  UNION ALL SELECT product_id, term, 'unique', 0, n, n FROM own_terms o WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM usage u WHERE u.product_id = o.product_id AND u.term = o.term)),
gap AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, kind ORDER BY pages DESC, occurrences DESC, (contains(term, ' ') AND kind <> 'unique') DESC, term) AS rn FROM gap0)
  WHERE rn <= CASE kind WHEN 'missing' THEN 25 WHEN 'shared' THEN 20 ELSE 15 END),
facts AS (
  SELECT c.product_id, attribute FROM (SELECT product_id, attribute, count(*) AS k FROM (SELECT product_id, unnest(found) AS attribute FROM pages2 WHERE NOT is_own_store) GROUP BY ALL) c
  JOIN captured USING (product_id) JOIN own USING (product_id) WHERE NOT list_contains(own.found, attribute) AND k >= greatest(1.0, peers / 2)),""",
)
_CONTENT = (*_CONTENT[:-1], _CONTENT[-1].rstrip(","))
_SIMILAR = (
    words_sql("desc_words", "(SELECT * FROM pages0 WHERE description <> '')", "product_id, source_id", "description"),
    """
desc_lists AS (SELECT product_id, source_id, list(t) FILTER (t IS NOT NULL) AS ts FROM desc_words GROUP BY ALL),
own_desc AS (SELECT product_id, ts FROM (SELECT d.*, row_number() OVER (PARTITION BY d.product_id ORDER BY source_id) AS rn FROM desc_lists d JOIN pages0 USING (product_id, source_id) WHERE is_own_store) WHERE rn = 1),
likeness AS (
  SELECT d.product_id, d.source_id, CASE WHEN len(o.ts) >= 20 AND len(d.ts) >= 20 THEN
      CAST(floor(len(list_intersect(o.ts, d.ts)) / least(len(list_distinct(o.ts)), len(list_distinct(d.ts))) * 100 + 0.5) AS BIGINT) END AS similarity
  FROM desc_lists d JOIN pages0 USING (product_id, source_id) JOIN own_desc o ON o.product_id = d.product_id WHERE NOT is_own_store)""",
)
_CHECKS = """
facts_n AS (SELECT product_id, count(*) AS n FROM facts GROUP BY 1), missing_n AS (SELECT product_id, count(*) AS n FROM gap WHERE kind = 'missing' GROUP BY 1),
most AS (SELECT product_id, max(similarity) AS s FROM likeness GROUP BY 1),
joined AS (
  SELECT own.*, coalesce(c.peers, 0) AS peers, median_words, coalesce(bullet_peers, 0) AS bullet_peers, coalesce(faq_peers, 0) AS faq_peers, coalesce(rating_peers, 0) AS rating_peers, s, coalesce(m.n, 0) AS mk, coalesce(f.n, 0) AS mf
  FROM own LEFT JOIN captured c USING (product_id) LEFT JOIN most USING (product_id) LEFT JOIN missing_n m ON m.product_id = own.product_id LEFT JOIN facts_n f ON f.product_id = own.product_id),
checks AS (
  SELECT product_id, place, "check", status FROM (
    SELECT product_id, 0 AS place, 'title' AS "check", CASE WHEN coalesce(title, '') = '' THEN 'fail' WHEN title_length BETWEEN 30 AND 65 THEN 'pass' ELSE 'warn' END AS status FROM joined
    UNION ALL SELECT product_id, 1, 'meta_description', CASE WHEN coalesce(meta, '') = '' THEN 'fail' WHEN meta_length BETWEEN 70 AND 160 THEN 'pass' ELSE 'warn' END FROM joined
    UNION ALL SELECT product_id, 2, 'h1', CASE WHEN h1_count = 0 THEN 'fail' WHEN h1_count > 1 THEN 'warn' ELSE 'pass' END FROM joined
    UNION ALL SELECT product_id, 3, 'description', CASE WHEN words = 0 THEN 'fail' WHEN words < median_words * 0.5 OR words < 50 THEN 'warn' ELSE 'pass' END FROM joined
    UNION ALL SELECT product_id, 4, 'duplicate', CASE WHEN s IS NULL THEN 'info' WHEN s >= 80 THEN 'fail' WHEN s >= 60 THEN 'warn' ELSE 'pass' END FROM joined
    UNION ALL SELECT product_id, 5, 'keywords', CASE WHEN peers > 0 THEN CASE WHEN mk > 5 THEN 'warn' ELSE 'pass' END END FROM joined
    UNION ALL SELECT product_id, 6, 'attributes', CASE WHEN mf > 0 THEN 'warn' WHEN peers > 0 THEN 'pass' END FROM joined
    UNION ALL SELECT product_id, 7, 'bullets', CASE WHEN bullet_count > 0 THEN 'pass' WHEN bullet_peers > 0 AND bullet_peers >= peers / 2 THEN 'warn' END FROM joined
    UNION ALL SELECT product_id, 8, 'faq', CASE WHEN faq_count > 0 THEN 'pass' WHEN faq_peers > 0 THEN 'warn' ELSE 'info' END FROM joined
    UNION ALL SELECT product_id, 9, 'rating', CASE WHEN has_rating THEN 'pass' WHEN rating_peers > 0 THEN 'warn' END FROM joined
    UNION ALL SELECT product_id, 10, 'image_alt', CASE WHEN alt_coverage < 80 THEN 'warn' WHEN alt_coverage IS NOT NULL THEN 'pass' END FROM joined)
  WHERE status IS NOT NULL),
overview AS (
  SELECT product_id, score, fails, warnings, CASE WHEN score IS NULL THEN 'not_captured' WHEN score >= 85 THEN 'good' ELSE 'needs_work' END AS band, fails * 100 + warnings AS issues
  FROM (SELECT p_partkey AS product_id FROM part) LEFT JOIN (
    SELECT product_id, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warn') AS warnings,
      CAST(floor(count(*) FILTER (status = 'pass') / nullif(count(*) FILTER (status <> 'info'), 0) * 100 + 0.5) AS BIGINT) AS score FROM checks GROUP BY 1) USING (product_id))"""


def _of_pages(select: str) -> str:
    return "WITH " + ",".join((*_CONTENT, *_SIMILAR, _CHECKS)) + "\n" + select


_VERSIONS = (
    written.SNAPSHOTS_SQL,
    """
lagged AS (
  SELECT *, row_number() OVER w AS k, lag(title) OVER w AS lt, lag(description) OVER w AS ld, lag(bullets) OVER w AS lb FROM snaps WINDOW w AS (PARTITION BY source_id ORDER BY captured_at, snapshot_id)),
marked AS (
  SELECT *, k = 1 OR title IS DISTINCT FROM lt OR description IS DISTINCT FROM ld OR bullets IS DISTINCT FROM lb AS fresh FROM lagged),
numbered AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY source_id ORDER BY captured_at, snapshot_id) AS version FROM marked),
versions AS (
  SELECT source_id, any_value(is_own_store) AS is_own_store, version, CASE WHEN bool_or(k = 1) THEN '' ELSE any_value(concat_ws(',', CASE WHEN title IS DISTINCT FROM lt THEN 'title' END, CASE WHEN description IS DISTINCT FROM ld THEN 'description' END,
      CASE WHEN bullets IS DISTINCT FROM lb THEN 'bullets' END)) FILTER (fresh) END AS changed, min(captured_at) AS since, max(captured_at) AS last_seen,
    max_by({'rating': rating, 'images': images, 'language': language}, (captured_at, snapshot_id)) AS seen
  FROM numbered GROUP BY source_id, version)""",
)

ORACLES = {
    "t04_t01_t02_t03_tokens": _over("SELECT review_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS tokens FROM raw LEFT JOIN words USING (review_id) GROUP BY 1"),
    "t05_word_counts": "WITH "
    + words_sql("w", "documents", "doc_id", "text")
    + "\nSELECT d.doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+')) AS words, coalesce(n, 0) AS tokens FROM documents d LEFT JOIN (SELECT doc_id, count(t) AS n FROM w GROUP BY 1) USING (doc_id)",
    "t06_d13_d14_term_counts": "WITH "
    + words_sql("w", "documents", "lang, doc_id", "text")
    + ","
    + terms_sql("terms", "w", "lang, doc_id")
    + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY documents DESC, occurrences DESC, term) AS place
  FROM (SELECT lang, term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM terms GROUP BY ALL)) WHERE place <= 50""",
    "t08_i03_similarity": "WITH "
    + words_sql("w", "documents", "doc_id", "text")
    + """,
lists AS (SELECT doc_id, list(t) FILTER (t IS NOT NULL) AS ts FROM w GROUP BY 1)
SELECT a.doc_id, CASE WHEN len(a.ts) >= 20 AND len(b.ts) >= 20 THEN CAST(floor(len(list_intersect(a.ts, b.ts)) / least(len(list_distinct(a.ts)), len(list_distinct(b.ts))) * 100 + 0.5) AS BIGINT) END AS similarity
FROM lists a JOIN lists b ON b.doc_id = a.doc_id + 1""",
    "t07_g11_keyword_gap": _of_pages("SELECT * FROM gap"),
    "t09_attributes": _of_pages("SELECT source_id, array_to_string(found, ',') AS attributes FROM pages2"),
    "t10_store_tokens": _of_pages("SELECT * FROM store_tokens"),
    "t11_metrics": _of_pages("SELECT source_id, words, title_length, meta_length, h1_count, h2_count, bullet_count, faq_count, alt_coverage, has_rating FROM pages1"),
    "t12_content_text": _of_pages("SELECT source_id, copy FROM pages1"),
    "t13_checks": _of_pages("SELECT * FROM checks"),
    "t14_t17_t18_overview": _of_pages("SELECT * FROM overview"),
    "t15_missing_facts": _of_pages("SELECT * FROM facts"),
    "t16_similarities": _of_pages("SELECT * FROM likeness"),
    "t20_content_overview": _of_pages(
        """SELECT product_id, recency, score, CASE WHEN score IS NULL THEN 'not_captured' WHEN score >= 85 THEN 'good' ELSE 'needs_work' END AS band, truncated
          FROM (SELECT p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey % 400, p_partkey) AS recency, count(*) OVER () > 500 AS truncated FROM part WHERE p_partkey % 97 <> 0) LEFT JOIN overview USING (product_id) WHERE recency <= 500"""
    ),
    "t19_overview_summary": _of_pages(
        "SELECT count(*) AS analyzed, CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_score, count(*) FILTER (band = 'needs_work') AS needs_work, count(*) FILTER (band = 'not_captured') AS not_captured FROM overview"
    ),
    "g04_sorted_overview": _of_pages("SELECT product_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, product_id) AS place FROM overview"),
    "t21_domains": "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages",
    "t23_language": _over(
        """SELECT review_id, CASE WHEN a > l AND a >= 3 THEN 'ar' WHEN l > a AND l >= 3 THEN 'en' WHEN review_id % 2 = 0 THEN 'fr' WHEN a > 0 THEN 'ar' END AS language
           FROM (SELECT review_id, len(regexp_extract_all(body, '[\\x{0600}-\\x{06FF}]')) AS a, len(regexp_extract_all(body, '[A-Za-z]')) AS l FROM r)"""
    ),
    "d18_english_lists": _over(
        """SELECT review_id, CASE len(themes) WHEN 0 THEN '' WHEN 1 THEN themes[1] WHEN 2 THEN themes[1] || ' and ' || themes[2]
           ELSE array_to_string(themes[1:len(themes) - 1], ', ') || ', and ' || themes[len(themes)] END AS listed FROM r"""
    ),
    "l01_page_digests": "SELECT sha256(html) AS hash, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1",
    "l02_l03_e06_versions": "WITH " + ",".join(_VERSIONS) + "\nSELECT * EXCLUDE (is_own_store, seen), seen.rating AS rating, seen.images AS images, seen.language AS language FROM versions",
    "l04_d06_latest_versions": "WITH " + ",".join(_VERSIONS) + "\nSELECT source_id, max(version) AS version_count, max_by(since, version) AS content_since FROM versions GROUP BY 1",
    "u01_u04_sentiment_themes": _over("SELECT review_id, sentiment, by_words, array_to_string(themes, ',') AS themes FROM r"),
    "u05_summaries": _over(_summary("product_id")),
    "u07_store_summaries": _over(_summary("retailer_id, retailer_name")),
    "u08_g16_review_gaps": _over(
        """SELECT product_id, name, own_reviews, competitor_reviews, own_average, floor(md * 10 + 0.5) / 10 AS competitor_median, floor((own_average - md) * 10 + 0.5) / 10 AS rating_gap, own_reviews - competitor_reviews AS count_gap
           FROM (SELECT product_id, name, count(*) FILTER (is_own_store) AS own_reviews, count(*) FILTER (NOT is_own_store) AS competitor_reviews,
             floor(CAST(sum(CAST(rating AS DECIMAL(18, 6))) FILTER (is_own_store) AS DOUBLE) / nullif(count(rating) FILTER (is_own_store), 0) * 10 + 0.5) / 10 AS own_average,
             median(rating) FILTER (NOT is_own_store) AS md FROM r GROUP BY ALL)
           ORDER BY coalesce(floor((own_average - md) * 10 + 0.5) / 10, 0), count_gap, name LIMIT 40"""
    ),
    "u10_u11_usable": _over("SELECT review_id, usable, store_issue, quote FROM r"),
    "u12_product_angles": _over(
        f"""SELECT product_id, brand, count(*) AS review_count, floor(CAST(sum(CAST(rating AS DECIMAL(18, 6))) AS DOUBLE) / nullif(count(rating), 0) * 10 + 0.5) / 10 AS average_rating,
             count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
             coalesce(array_to_string((list(quote ORDER BY is_official DESC, length(body) DESC, review_id) FILTER (sentiment = 'positive' AND length(clean) >= 18))[1:3], '|'), '') AS praise,
             coalesce(array_to_string((list(quote ORDER BY length(body) DESC, review_id) FILTER (sentiment = 'negative' AND length(clean) >= 18))[1:3], '|'), '') AS complaints
           FROM r WHERE {_GOOD} GROUP BY product_id, brand"""
    ),
    "u13_brand_insights": _over(
        f"""SELECT CASE WHEN positive >= 2 AND positive > negative THEN 'strength' ELSE 'our_weakness' END AS type, brand, theme, mentions,
             CASE WHEN positive >= 2 AND positive > negative THEN 60 + 3 * positive ELSE 72 + 4 * negative END AS priority
           FROM ({_themes("brand", _GOOD)}) WHERE (positive >= 2 AND positive > negative) OR (negative >= 1 AND negative >= positive)"""
    ),
    "u14_competitor_weaknesses": _over(
        f"""SELECT 'competitor_weakness' AS type, theme, a.positive AS our_praise, b.negative AS their_complaints, 78 + 3 * b.negative AS priority, a.mentions + b.negative AS review_count
           FROM ({_themes("brand = 'Brand A' AS ours", _GOOD)}) a JOIN ({_themes("brand = 'Brand A' AS ours", _GOOD)}) b USING (theme) WHERE a.ours AND NOT b.ours AND a.positive >= 1 AND b.negative >= 1"""
    ),
    "u15_store_issues": _over(
        "SELECT brand, retailer_id, count(*) AS n, bool_and(is_official) AS official, 68 + 5 * count(*) AS priority FROM r WHERE usable AND store_issue AND sentiment = 'negative' GROUP BY 1, 2"
    ),
    "u16_c06_review_gap": _over("SELECT product_id, name FROM review_products WHERE product_id NOT IN (SELECT product_id FROM r WHERE usable) ORDER BY product_id LIMIT 8"),
    "u18_review_hash": _over("SELECT review_id, left(sha256('author' || chr(0) || chr(0) || body), 32) AS hash FROM r"),
    "d15_theme_stats": _over(_themes("brand")),
    "g10_keywords": _over(
        """SELECT brand, sentiment, term, n FROM (SELECT *, row_number() OVER (PARTITION BY brand, sentiment ORDER BY n DESC, term) AS place FROM (
             SELECT brand, sentiment, t AS term, count(*) AS n FROM words JOIN r USING (review_id) WHERE t IS NOT NULL AND sentiment <> 'neutral' GROUP BY ALL)) WHERE place <= 8"""
    ),
    "g12_top_themes": _over(
        f"""SELECT kind, retailer_id, theme, place FROM (
             SELECT 'praised' AS kind, *, row_number() OVER (PARTITION BY retailer_id ORDER BY positive DESC, net_sentiment DESC, theme) AS place FROM ({_themes("retailer_id")}) WHERE positive >= negative
             UNION ALL SELECT 'complained', *, row_number() OVER (PARTITION BY retailer_id ORDER BY negative DESC, net_sentiment, theme) FROM ({_themes("retailer_id")}) WHERE negative >= positive) WHERE place <= 3"""
    ),
    "b06_b07_find_reviews": _over("SELECT review_id FROM r WHERE contains(lower(concat_ws(' ', nullif(body, ''), name, brand, retailer_name)), 'store 3') AND list_contains(themes, 'scent') AND sentiment = 'positive'"),
    "e09_recent_reviews": _over(
        "SELECT review_id, seen FROM (SELECT *, coalesce(CASE WHEN review_id % 3 = 0 THEN review_id * 7 % 31 END, review_id % 31) AS seen FROM r) WHERE sentiment = 'negative' ORDER BY seen DESC, review_id LIMIT 8"
    ),
}
