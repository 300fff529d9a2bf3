"""Queries of parameters, brand matching, formatting and the streaming twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.operators import alerts, content
from pricescope.plans import text as text_plans
from pricescope.plans.history import _PAIRS, alert_table
from pricescope.plans.sql import DOMAIN, with_layers
from pricescope.session import checkpointed, keep_result, remove, shared_dir
from pricescope.sources import written
from pricescope.sources.domain import AS_OF, Domain
from pricescope.streaming import sink
from pricescope.streaming.alerts import store_alerts, stored_alerts, version_stream


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep_result(path)
    return path


def money_text(amount: Column, currency: Column) -> Column:
    """Dollars with their sign and thousands; other currencies with their code; two digits, halves away from zero."""
    digits = F.format_number(F.round(F.abs(amount), 2), 2)
    sign = F.when(amount < 0, "-").otherwise("")
    return F.when(amount.isNotNull(), F.when(currency == "USD", F.concat(sign, F.lit("$"), digits)).when(currency.isNotNull(), F.concat(sign, currency, F.lit(" "), digits)).otherwise(F.concat(sign, F.replace(digits, F.lit(","), F.lit("")))))


def normal_url(url: Column) -> Column:
    """For comparing addresses: without fragment and closing slash, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", ""))


def link_errors(links: DataFrame) -> DataFrame:
    """(product_id, error) of products to be created: 1 to 20 competitors, none the own address, none twice."""
    addresses = links.select("product_id", "is_own", normal_url(F.col("url")).alias("u")).groupBy("product_id", "u").agg(
        F.count_if(~F.col("is_own")).alias("n"), F.bool_or("is_own").alias("own")
    )
    found = addresses.groupBy("product_id").agg(
        F.sum("n").alias("n"), F.bool_or(F.col("own") & F.col("u").isNotNull() & (F.col("n") > 0)).alias("same"), F.bool_or(F.col("n") > 1).alias("twice")
    )
    errors = {"COMPETITORS": ~F.col("n").between(1, 20), "OWN_URL": F.col("same"), "DUPLICATE": F.col("twice")}
    return found.select("product_id", F.explode(F.array_compact(F.array(*[F.when(wrong, F.lit(error)) for error, wrong in errors.items()]))).alias("error"))


def canonical_brands(products: DataFrame, brands: DataFrame) -> DataFrame:
    """Each product's brand by the name or slug of the list, regardless of case; else as given, trimmed.

    Both ways to match are equi-joins on one key; the first brand in the list's order wins.
    """
    by_key = brands.select(F.lower(F.trim("name")).alias("key"), "name", "place").unionByName(brands.select(F.col("slug").alias("key"), "name", "place"))
    first = by_key.groupBy("key").agg(F.min_by("name", "place").alias("canonical"))
    joined = products.withColumn("key", F.lower(F.trim("brand"))).join(first, "key", "left")
    return joined.select("product_id", F.coalesce("canonical", F.nullif(F.trim("brand"), F.lit(""))).alias("brand"))


def official_stores(retailers: DataFrame, brands: DataFrame) -> DataFrame:
    """(brand, retailer_id) of brand stores whose domain is the brand's or whose name holds the brand's.

    Brands and brand stores are both short lists; the first match is an equi-join, the second goes by words of the name.
    """
    stores = retailers.where("is_brand_store")
    by_domain = stores.join(brands, F.col("domain") == F.col("official_domain")).select(F.col("name").alias("brand"), "retailer_id")
    words = F.split(F.lower("retailer_name"), " ")
    runs = F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    by_name = stores.withColumn("run", F.explode(runs)).join(brands.withColumn("run", F.lower("name")), "run").select(F.col("name").alias("brand"), "retailer_id")
    return by_domain.unionByName(by_name).distinct()


def m05_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).table("orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)).alias("x"), F.when(F.col("o_orderkey") % 4 == 0, "EUR").when(F.col("o_orderkey") % 4 != 1, "USD").alias("c"))
    return rows.select("o_orderkey", money_text(F.col("x"), F.col("c")).alias("money"))


def b05_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alert_table(spark, sf_dir)
    kinds = [rows.where(w).agg(F.lit(n).alias("filter"), F.count("*").alias("n")) for n, w in (("active", "status <> 'dismissed'"), ("all", "true"), ("read", "status = 'read'"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def _in_parts(rows: DataFrame, time: str, bounds: list[str], run: Callable[[DataFrame, str], None]) -> str:
    """Feed a stream in parts by time: each is written to its input, and the same query is run again. Rows without a time come first.

    Returns the folder with the stream's output (``out``), for the caller to drop.
    """
    spark = rows.sparkSession
    folder = _folder(spark, "stream")
    at = F.col(time)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        after = F.lit(True) if low is None else at >= F.lit(low).cast("timestamp")
        before = F.lit(True) if high is None else at < F.lit(high).cast("timestamp")
        rows.where(F.coalesce(after & before, F.lit(low is None))).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)
    return folder


def _appended(stream: DataFrame, folder: str) -> None:
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def _result(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a stream's output, written for good; the stream's folder goes."""
    held = checkpointed(rows)
    remove(spark, folder)
    return held


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, source_id, n): the batch alerts of all competitors' observations, found by a stream that reads them in order of time, in four parts.

    The observations are made and joined once, not for each part.
    """
    d = Domain(spark, sf_dir)
    columns = ["source_id", "price", "availability", "scraped_at", "order_key", "order_line"]
    rows = checkpointed(alerts.with_own_flag(d.observations, d.sources).where("NOT is_own_store").select(*columns))

    def run(source: DataFrame, folder: str) -> None:
        def write(batch: DataFrame, batch_id: int) -> None:
            store_alerts(batch, batch_id, f"{folder}/alerts")

        source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    folder = _in_parts(rows, "scraped_at", ["1997-01-01", "1998-06-01", "2000-01-01"], run)
    found = _result(spark, folder, stored_alerts(spark, f"{folder}/alerts").groupBy("type", "source_id").agg(F.count("*").alias("n")))
    for path in {name.rsplit("/", 1)[0] for name in rows.inputFiles()}:
        remove(spark, path)
    return found


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of all pages, found by a stream that reads the looks at them in order of time, in three parts."""
    folder = _in_parts(written.snapshots(spark, sf_dir), "captured_at", ["1998-01-01", "2000-01-01"], lambda source, at: _appended(version_stream(source), at))
    looks = spark.read.parquet(f"{folder}/out")
    last = F.max_by(F.struct(*content.REFRESHED), F.struct("captured_at", "snapshot_id")).alias("last")
    changed = F.array_join(F.max(F.when(F.col("fresh"), F.col("changed"))), ",").alias("changed")
    spans = looks.groupBy("source_id", "version").agg(changed, F.min("captured_at").alias("since"), F.max("captured_at").alias("last_seen"), last)
    return _result(spark, folder, spans.select("source_id", "version", "changed", "since", "last_seen", "last.*"))


ALERT = "alert_id string, type string, status string, product_id bigint, retailer_id bigint, change_percentage double, created_at timestamp"


def _stored_alerts(spark: SparkSession, sf_dir: str) -> str:
    """All alerts as a stream of three parts merged into a stored table, each part twice."""
    rows = alert_table(spark, sf_dir)

    def run(source: DataFrame, folder: str) -> None:
        def write(batch: DataFrame, _: int) -> None:
            for _again in range(2):
                sink.merge_alerts(batch, f"{folder}/alerts", ALERT)

        source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    return _in_parts(rows, "created_at", ["1997-01-01", "2000-01-01"], run)


def alert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts by type and status, after all new ones were read; ``changed`` of them were."""
    folder = _stored_alerts(spark, sf_dir)
    table = f"{folder}/alerts"
    changed = sink.mark_alerts(spark, table, ALERT)
    counts = sink.read_alerts(spark, table, ALERT).groupBy("type", "status").agg(F.count("*").alias("n"))
    return _result(spark, folder, counts.withColumn("changed", F.lit(changed).cast("bigint")))


def alert_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored alerts of the last 180 days, after older partitions were dropped, and how many partitions are left."""
    folder = _stored_alerts(spark, sf_dir)
    table, now = f"{folder}/alerts", datetime.fromisoformat(AS_OF)
    sink.expire_alerts(spark, table, now, 180)
    left = len(sink.months(spark, table))
    return _result(spark, folder, sink.live_alerts(spark, table, ALERT, now, 180).select("alert_id", "created_at", F.lit(left).alias("partitions")))


QUERIES = {
    "m05_money_text": m05_money,
    "b05_alert_filters": b05_status,
    "k01_k02_alert_stream": stream_alerts,
    "l03_version_stream": stream_versions,
    "k06_a06_alert_sink": alert_sink,
    "a11_partition_expiry": alert_expiry,
}

ORACLES = {
    "m05_money_text": """SELECT o_orderkey, CASE c WHEN 'USD' THEN sign || '$' || format('{:,.2f}', a) WHEN 'EUR' THEN sign || 'EUR ' || format('{:,.2f}', a) ELSE sign || format('{:.2f}', a) END AS money FROM (
      SELECT o_orderkey, abs(o_totalprice) AS a, CASE WHEN o_orderkey % 3 = 0 AND o_totalprice > 0 THEN '-' ELSE '' END AS sign, CASE WHEN o_orderkey % 4 = 0 THEN 'EUR' WHEN o_orderkey % 4 <> 1 THEN 'USD' END AS c FROM orders)""",
    "b05_alert_filters": with_layers(
        DOMAIN, _PAIRS, select="SELECT 'active' AS filter, count(*) FILTER (status <> 'dismissed') AS n FROM alerts UNION ALL SELECT 'all', count(*) FROM alerts UNION ALL SELECT 'read', count(*) FILTER (status = 'read') FROM alerts"
    ),
    "l03_version_stream": text_plans.ORACLES["l02_l03_e06_versions"],
    "k06_a06_alert_sink": with_layers(
        DOMAIN, _PAIRS, select="SELECT type, CASE WHEN status = 'new' THEN 'read' ELSE status END AS status, count(*) AS n, (SELECT count(*) FROM alerts WHERE status = 'new') AS changed FROM alerts GROUP BY 1, 2"
    ),
    "a11_partition_expiry": with_layers(
        DOMAIN,
        _PAIRS,
        f"live AS (SELECT * FROM alerts WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY)",
        select=f"SELECT alert_id, created_at, (SELECT count(DISTINCT strftime(created_at, '%Y-%m')) FROM alerts WHERE strftime(created_at, '%Y-%m') >= strftime(TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY, '%Y-%m')) AS partitions FROM live",
    ),
    "k01_k02_alert_stream": with_layers(
        DOMAIN, _PAIRS, select="SELECT type, source_id, count(*) AS n FROM (SELECT * FROM changes UNION ALL SELECT * FROM outs) GROUP BY ALL"
    ),
}
