"""Reviews, page copy and page versions made of the sales tables, each with the SQL of the same rows.

Every line of an order is a review, every part has pages at up to five stores, and every line item is a look at its part's page. What
is said comes from short lists of texts; who says it, of what and when, from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rating and text of a review; a review's place in the list comes from its key.
REVIEW_TEXTS = [
    (5.0, "Love this shampoo, excellent texture and great smell"),
    (1.0, "Arrived late and the bottle was broken, terrible packaging"),
    (None, "Amazing results, my hair is soft and shiny, worth the price"),
    (None, "Bad smell and greasy texture, a waste"),
    (3.0, "It is ok"),
    (None, "ممتاز وسريع التوصيل"),
    (None, "لا أنصح به، رائحة سيئة وغالي"),
    (4.0, "Authentic product, fast shipping and helpful support Read more"),
    (2.0, "My scalp was itchy, a burning reaction and hair loss"),
    (None, "منتج رائع جداً للشعر الجاف وملمس ناعم"),
    (None, "Delivery was slow and customer service rude, disappointed"),
    (5.0, "read more"),
    (None, "The price is fine, nothing special about the box"),
    (float("nan"), "Expensive but effective, recommended"),
    (4.5, "تقليد؟ لا، أصلي ومناسب"),
    (None, ""),
]
COPY = [
    "Argan oil shampoo for dry hair, sulfate free and gentle, with keratin and vitamin e for soft and shiny hair every day of the week after washing",
    "Argan oil shampoo for dry hair, sulfate free and gentle, with keratin and vitamin e for soft and shiny hair each day of the year, made in Morocco",
    "Hydrating conditioner with shea butter and biotin. How to use: apply to wet hair, leave on for two minutes and rinse well. Paraben-free and vegan formula, 400 ml bottle, dermatologically tested",
    "شامبو بزيت الأرجان للشعر الجاف، بدون سلفات، مناسب لجميع أنواع الشعر. طريقة الاستخدام: يوضع على الشعر المبلل",
    "Short copy",
]
_META = "A gentle shampoo for dry hair with argan oil and keratin. " * 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(keys: DataFrame, *by: str) -> DataFrame:
    """Slim rows from which long texts are made, dealt to tasks by a key: a few megabytes of them are one split of their file.

    The number of tasks is given, so adaptive execution doesn't merge them by the size of the slim rows.
    """
    spark = keys.sparkSession
    return keys.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def _one_of(values: list, place: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), place.cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, product_id, retailer_id, is_own_store, rating, body. Line items of one key are one review."""
    place = (F.col("l_orderkey") * 3 + F.col("l_linenumber") * 5) % len(REVIEW_TEXTS)
    body = F.concat(_one_of([t for _, t in REVIEW_TEXTS], place, "string"), F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit(" item "), F.col("l_partkey"))).otherwise(""))
    lines = dealt(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", "l_linenumber")
    items = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("review_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("retailer_id"),
        (F.col("l_suppkey") % 5 == 1).alias("is_own_store"),
        _one_of([r for r, _ in REVIEW_TEXTS], place, "double").alias("rating"),
        body.alias("body"),
    )


def review_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat(F.lit("Brand "), F.char(65 + F.col("p_partkey") % 7))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), brand.alias("brand"))


def review_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("retailer_id"), F.concat(F.lit("Store "), F.col("s_suppkey")).alias("retailer_name"))


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_RATINGS = ", ".join("NULL" if r is None else "'NaN'::DOUBLE" if r != r else f"{r}::DOUBLE" for r, _ in REVIEW_TEXTS)
_PLACE = f"CAST((l_orderkey * 3 + l_linenumber * 5) % {len(REVIEW_TEXTS)} + 1 AS INTEGER)"
REVIEWS_SQL = f"""
raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS review_id, l_partkey AS product_id, l_suppkey AS retailer_id, l_suppkey % 5 = 1 AS is_own_store, ([{_RATINGS}])[{_PLACE}] AS rating,
    ([{", ".join(_quoted(t) for _, t in REVIEW_TEXTS)}])[{_PLACE}] || CASE WHEN l_orderkey % 3 = 0 THEN ' item ' || l_partkey ELSE '' END AS body
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
review_products AS (SELECT p_partkey AS product_id, p_name || ' ' || p_partkey AS name, 'Brand ' || chr(CAST(65 + p_partkey % 7 AS INTEGER)) AS brand FROM part),
review_stores AS (SELECT s_suppkey AS retailer_id, 'Store ' || s_suppkey AS retailer_name FROM supplier)"""


#: Scalar columns of a page, said alike in Spark and in the oracle's dialect: p is the product, s the store (0 the own one), k = 5 p + s.
_PAGE = {
    "product_id": "p",
    "source_id": "p * 10 + s",
    "retailer_name": "'Store ' || s",
    "url": "'https://www.store' || s || '.example.com/p/' || p",
    "is_own_store": "s = 0",
    "title": "CASE WHEN k % 7 <> 0 THEN substring('Argan Oil Shampoo number ' || p || ' for dry and damaged hair ' || CASE WHEN s > 0 THEN '| Store ' || s ELSE '' END, 1, CAST(24 + k % 45 AS INT)) END",
    "meta": f"CASE WHEN k % 5 <> 1 THEN substring('{_META}', 1, CAST(60 + k % 120 AS INT)) END",
    "images": "CAST(k % 5 AS INT)",
    "with_alt": "CAST(least(k % 5, k % 4) AS INT)",
    "rating": "CASE WHEN k % 4 = 0 THEN CAST(4.5 AS DOUBLE) END",
    "rating_count": "CASE WHEN k % 8 = 2 THEN 12 END",
}


def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy of every part's pages at five stores; one in nine isn't captured."""
    k = dealt(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p")), "p").select("p", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s")).where("(p + s) % 9 <> 0").withColumn("k", F.expr("p * 5 + s"))
    times = lambda n, make: F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n), make)
    copy = lambda place: _one_of(COPY, place % len(COPY), "string")
    more = F.when(F.col("k") % 3 != 0, F.concat(F.lit(" "), copy(F.col("p") + F.col("s") + 1))).otherwise("")
    arrays = {
        "description": F.when(F.col("k") % 11 != 3, F.concat(copy(F.col("p") + F.col("s")), more)),
        "h1": times(F.col("k") % 3, lambda i: F.concat(F.lit("Shampoo "), F.col("p"))),
        "h2": times(F.col("k") % 4, lambda i: F.concat(F.lit("Benefits "), i)),
        "bullets": times(F.col("k") % 5 % 3, lambda i: F.concat(F.lit("Point "), i, F.lit(" argan"))),
        "faq": times((F.col("k") % 6 == 0).cast("int"), lambda i: F.concat(F.lit("Question "), i, F.lit("?"))),
    }
    return k.select(*[F.expr(e).alias(n) for n, e in _PAGE.items()], *[e.alias(n) for n, e in arrays.items()])


_COPY_SQL = f"[{', '.join(map(_quoted, COPY))}]"
CONTENT_SQL = f"""
pages0 AS (
  SELECT {", ".join(f"{e} AS {n}" for n, e in _PAGE.items())},
    CASE WHEN k % 11 <> 3 THEN ({_COPY_SQL})[CAST((p + s) % 5 + 1 AS INTEGER)] || CASE WHEN k % 3 <> 0 THEN ' ' || ({_COPY_SQL})[CAST((p + s + 1) % 5 + 1 AS INTEGER)] ELSE '' END END AS description,
    list_transform(range(k % 3), lambda i: 'Shampoo ' || p) AS h1, list_transform(range(k % 4), lambda i: 'Benefits ' || i) AS h2,
    list_transform(range(k % 5 % 3), lambda i: 'Point ' || i || ' argan') AS bullets, list_transform(range(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END), lambda i: 'Question ' || i || '?') AS faq
  FROM (SELECT p, s, p * 5 + s AS k FROM (SELECT p_partkey AS p, unnest(range(5)) AS s FROM part) WHERE (p + s) % 9 <> 0))"""


_SNAPSHOT = {
    "snapshot_id": "l_orderkey * 10 + l_linenumber",
    "source_id": "l_partkey",
    "is_own_store": "l_partkey % 2 = 0",
    "captured_at": "CAST(l_shipdate AS TIMESTAMP)",
    "title": "CASE WHEN l_linenumber <> 6 THEN 'Title ' || substring('AABBA', CAST(l_orderkey % 5 + 1 AS INT), 1) END",
    "description": "'Text ' || CAST(year(l_shipdate) AS VARCHAR(4))",
    "rating": "CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS DOUBLE) END",
    "images": "CAST(l_orderkey % 7 AS INT)",
    "language": "CASE WHEN l_orderkey % 2 = 0 THEN 'en' ELSE 'ar' END",
}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks at the pages of parts: snapshot_id, source_id, is_own_store, captured_at, the tracked title, description and bullets, and rating, images and language."""
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(*[F.expr(e).alias(n) for n, e in _SNAPSHOT.items()], F.array(F.when(F.col("l_quantity") > 25, "b1").otherwise("b0")).alias("bullets"))


SNAPSHOTS_SQL = f"snaps AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _SNAPSHOT.items())}, [CASE WHEN l_quantity > 25 THEN 'b1' ELSE 'b0' END] AS bullets FROM lineitem)"
