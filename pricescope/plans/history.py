"""Queries of history and alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.functions.numeric import round_percent
from pricescope.operators import alerts, history, pricing
from pricescope.plans.sql import ANALYSIS, DOMAIN, LATEST, market, pct, r2, with_layers
from pricescope.sources.domain import AS_OF, Domain

NOW = datetime.fromisoformat(AS_OF)
SINCE = NOW - timedelta(days=365)


def c11_carry_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.carry_in(Domain(spark, sf_dir).observations, SINCE)


def q01_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.price_history(Domain(spark, sf_dir).observations, SINCE)


def q01_history_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return history.history_of_sources(d.sources, history.price_history(d.observations, SINCE))


def e07_step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.step_rows(history.price_history(Domain(spark, sf_dir).observations, SINCE), SINCE, NOW)


def e08_versus_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by day of the year, so that own and competing prices meet on common times."""
    d = Domain(spark, sf_dir)
    monthly = d.observations.withColumn("scraped_at", F.date_trunc("month", "scraped_at"))
    rows = history.price_history(monthly, datetime(1995, 1, 1))
    return history.versus_own(rows, d.sources.where("is_own_store").select("source_id"))


def q05_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Domain(spark, sf_dir).observations
    newest = rows.orderBy(F.col("scraped_at").desc(), F.col("order_key").desc(), F.col("order_line").desc(), F.col("source_id").desc(), F.col("price").desc())
    return newest.limit(200).select("source_id", "price", "scraped_at")


def pairs(spark: SparkSession, sf_dir: str, d: Domain | None = None) -> DataFrame:
    d = d or Domain(spark, sf_dir)
    return alerts.with_previous(alerts.with_own_flag(d.observations, d.sources))


def c12_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("source_id", "step", "price", "availability", F.col("previous.price").alias("previous_price"), F.col("previous.availability").alias("previous_availability"))


def k01_price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.price_changes(pairs(spark, sf_dir))


def k02_out_of_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.stock_outs(pairs(spark, sf_dir)).select("product_id", "source_id", "step", "price", "scraped_at")


def k03_k04_gap_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps before 2001 against gaps now."""
    d = Domain(spark, sf_dir)
    before = pricing.analyse_products(d.sources, d.observations.where(F.col("scraped_at") < F.to_timestamp(F.lit("2001-01-01")))).select("product_id", F.col("gap_percentage").alias("previous_gap"))
    now = pricing.analyse_products(d.sources, d.observations).select("product_id", F.col("gap_percentage").alias("current_gap"))
    return alerts.gap_alerts(now.join(before, "product_id", "left"))


def alert_table(spark: SparkSession, sf_dir: str, d: Domain | None = None) -> DataFrame:
    """Price changes and stock-outs as stored alerts. ``d`` is a domain some of whose tables are written already."""
    both = alerts.raised(pairs(spark, sf_dir, d))
    status = F.when(F.col("source_id") % 7 == 0, "dismissed").when(F.col("source_id") % 3 == 0, "read").otherwise("new")
    return both.select(
        F.concat_ws("-", "source_id", "step", "type").alias("alert_id"),
        "type",
        status.alias("status"),
        "product_id",
        (F.col("source_id") % 1000000).alias("retailer_id"),
        "change_percentage",
        F.col("scraped_at").alias("created_at"),
    )


def k06_mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.set_status(alert_table(spark, sf_dir), "new", "read").groupBy("type", "status").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


def a11_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.unexpired(alert_table(spark, sf_dir), AS_OF, 180).select("alert_id", "created_at")


def q14_alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Domain(spark, sf_dir)
    return alerts.list_alerts(alert_table(spark, sf_dir), d.products, d.retailers, "active", "PRICE_CHANGE", page=2, size=20)


def v03_price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest moves of the last 30 days."""
    moves = alerts.unexpired(alert_table(spark, sf_dir).where("type = 'PRICE_CHANGE' AND retailer_id % 10 <> 0"), AS_OF, 30)
    top = moves.orderBy(F.abs(F.coalesce("change_percentage", F.lit(0.0))).desc(), F.col("created_at").desc(), "alert_id").limit(10)
    return top.select("alert_id", "change_percentage", "created_at")


def v02_period_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the latest 100 alerts of a type, those of the period: the limit comes first."""
    latest = alert_table(spark, sf_dir).where("type = 'OUT_OF_STOCK'").orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(100)
    return alerts.unexpired(latest, AS_OF, 7).select("alert_id", "created_at")


def events_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of value for each user and event type: the same rule over a stream's table."""
    rows = Domain(spark, sf_dir).table("events").withColumn("previous", F.expr("lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)"))
    return rows.where("previous > 0 AND value > 0 AND abs(value - previous) >= 0.005").select("event_id", "user_id", "event_type", round_percent((F.col("value") - F.col("previous")) / F.col("previous") * 100).alias("change_percentage"))


QUERIES = {
    "c11_carry_in": c11_carry_in,
    "q01_price_history": q01_price_history,
    "q01_history_by_source": q01_history_by_source,
    "e07_q03_step_rows": e07_step_rows,
    "e08_q04_versus_own": e08_versus_own,
    "q05_recent_observations": q05_recent,
    "c12_previous_state": c12_previous,
    "k01_price_change": k01_price_change,
    "k02_out_of_stock": k02_out_of_stock,
    "k03_k04_gap_alerts": k03_k04_gap_alerts,
    "k06_a08_mark_read": k06_mark_read,
    "a11_expiry": a11_expiry,
    "q14_c03_alert_list": q14_alert_list,
    "v02_period_alerts": v02_period_alerts,
    "v03_price_moves": v03_price_moves,
    "k01_event_changes": events_changes,
}

_SINCE = f"TIMESTAMP '{SINCE}'"
_CARRY = f"""
carry AS (
  SELECT product_id, source_id, price, currency, availability, scraped_at
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY scraped_at DESC, order_key DESC, order_line DESC, price DESC) AS rn FROM observations WHERE scraped_at < {_SINCE})
  WHERE rn = 1),
history AS (
  SELECT product_id, source_id, price, currency, availability, scraped_at, FALSE AS carried FROM observations WHERE scraped_at >= {_SINCE} AND price > 0
  UNION ALL SELECT *, TRUE FROM carry WHERE price > 0)"""
_PAIRS = """
pairs AS (
  SELECT o.*, is_own_store, row_number() OVER w AS step, lag(price) OVER w AS previous_price, lag(availability) OVER w AS previous_availability, lag(o.currency) OVER w AS previous_currency
  FROM observations o JOIN sources USING (source_id) WINDOW w AS (PARTITION BY source_id ORDER BY scraped_at, order_key, order_line, price)),
changes AS (
  SELECT 'PRICE_CHANGE' AS type, product_id, source_id, step, previous_price, price, {change} AS change_percentage, coalesce(currency, previous_currency) AS currency, scraped_at
  FROM pairs WHERE NOT is_own_store AND step > 1 AND previous_price > 0 AND price > 0 AND abs(price - previous_price) >= 0.005),
outs AS (
  SELECT 'OUT_OF_STOCK' AS type, product_id, source_id, step, CAST(NULL AS DOUBLE) AS previous_price, price, CAST(NULL AS DOUBLE) AS change_percentage, currency, scraped_at
  FROM pairs WHERE NOT is_own_store AND step > 1 AND availability = 'out_of_stock' AND previous_availability IS DISTINCT FROM 'out_of_stock'),
alerts AS (
  SELECT source_id || '-' || step || '-' || type AS alert_id, type, CASE WHEN source_id % 7 = 0 THEN 'dismissed' WHEN source_id % 3 = 0 THEN 'read' ELSE 'new' END AS status,
    product_id, source_id % 1000000 AS retailer_id, change_percentage, scraped_at AS created_at
  FROM (SELECT * FROM changes UNION ALL SELECT * FROM outs))""".replace("{change}", pct("price", "previous_price"))
_NOW = f"TIMESTAMP '{AS_OF}'"

ORACLES = {
    "c11_carry_in": with_layers(DOMAIN, _CARRY, select="SELECT * FROM carry"),
    "q01_price_history": with_layers(DOMAIN, _CARRY, select="SELECT * FROM history"),
    "q01_history_by_source": with_layers(
        DOMAIN,
        _CARRY,
        select="""SELECT product_id, source_id, coalesce(points, 0) AS points, first_price, last_price FROM sources LEFT JOIN (
          SELECT source_id, count(*) AS points, min_by(price, (scraped_at, price)) AS first_price, max_by(price, (scraped_at, price)) AS last_price FROM history GROUP BY source_id) USING (source_id)""",
    ),
    "e07_q03_step_rows": with_layers(
        DOMAIN,
        _CARRY,
        f"placed AS (SELECT source_id, price, CASE WHEN carried THEN {_SINCE} ELSE scraped_at END AS scraped_at FROM history)",
        select=f"SELECT *, FALSE AS held FROM placed UNION ALL SELECT source_id, max_by(price, (scraped_at, price)), {_NOW}, TRUE FROM placed GROUP BY source_id",
    ),
    "e08_q04_versus_own": with_layers(
        DOMAIN,
        "monthly AS (SELECT product_id, source_id, date_trunc('month', scraped_at)::TIMESTAMP AS scraped_at, max(price) AS price FROM observations WHERE price > 0 GROUP BY ALL)",
        select=f"""SELECT m.product_id, m.source_id, m.scraped_at, CASE WHEN s.is_own_store THEN 0.0 ELSE {pct("m.price", "o.price")} END AS versus_own
          FROM monthly m JOIN sources s USING (source_id)
          JOIN (SELECT product_id AS op, scraped_at AS oat, price FROM monthly WHERE source_id IN (SELECT source_id FROM sources WHERE is_own_store)) o ON op = m.product_id AND oat = m.scraped_at""",
    ),
    "q05_recent_observations": with_layers(DOMAIN, select="SELECT source_id, price, scraped_at FROM observations ORDER BY scraped_at DESC, order_key DESC, order_line DESC, source_id DESC, price DESC LIMIT 200"),
    "c12_previous_state": with_layers(DOMAIN, _PAIRS, select="SELECT source_id, step, price, availability, previous_price, previous_availability FROM pairs"),
    "k01_price_change": with_layers(DOMAIN, _PAIRS, select="SELECT * FROM changes"),
    "k02_out_of_stock": with_layers(DOMAIN, _PAIRS, select="SELECT product_id, source_id, step, price, scraped_at FROM outs"),
    "k06_a08_mark_read": with_layers(
        DOMAIN, _PAIRS, select="SELECT type, CASE WHEN status = 'new' THEN 'read' ELSE status END AS status, count(*) AS n, count(*) FILTER (status = 'new') AS changed FROM alerts GROUP BY 1, 2"
    ),
    "a11_expiry": with_layers(DOMAIN, _PAIRS, select=f"SELECT alert_id, created_at FROM alerts WHERE created_at >= {_NOW} - INTERVAL 180 DAY"),
    "q14_c03_alert_list": with_layers(
        DOMAIN,
        _PAIRS,
        select="""SELECT a.*, p.name AS product_name, retailer_name, domain
          FROM (SELECT * FROM alerts WHERE status <> 'dismissed' AND type = 'PRICE_CHANGE' ORDER BY created_at DESC, alert_id DESC LIMIT 20 OFFSET 20) a
          LEFT JOIN products p USING (product_id) LEFT JOIN retailers USING (retailer_id)""",
    ),
    "v02_period_alerts": with_layers(
        DOMAIN,
        _PAIRS,
        select=f"SELECT alert_id, created_at FROM (SELECT * FROM alerts WHERE type = 'OUT_OF_STOCK' ORDER BY created_at DESC, alert_id DESC LIMIT 100) WHERE created_at >= {_NOW} - INTERVAL 7 DAY",
    ),
    "v03_price_moves": with_layers(
        DOMAIN,
        _PAIRS,
        select=f"""SELECT alert_id, change_percentage, created_at FROM alerts WHERE type = 'PRICE_CHANGE' AND retailer_id % 10 <> 0 AND created_at >= {_NOW} - INTERVAL 30 DAY
          ORDER BY abs(coalesce(change_percentage, 0)) DESC, created_at DESC, alert_id LIMIT 10""",
    ),
    "k01_event_changes": f"""SELECT event_id, user_id, event_type, {r2("((value - previous) / previous * 100)")} AS change_percentage
      FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events) WHERE previous > 0 AND value > 0 AND abs(value - previous) >= 0.005""",
}


def _gap_layers(name: str, where: str) -> str:
    inner = with_layers(DOMAIN.replace("JOIN part ON p_partkey = l_partkey)", f"JOIN part ON p_partkey = l_partkey {where})"), LATEST, market(), ANALYSIS, select="SELECT product_id, gap_percentage FROM analysis")
    return f"{name} AS ({inner})"


ORACLES["k03_k04_gap_alerts"] = f"""WITH {_gap_layers("now", "")}, {_gap_layers("before", "WHERE l_shipdate < TIMESTAMP '2001-01-01'")}
SELECT * FROM (SELECT CASE WHEN n.gap_percentage > 10 AND NOT coalesce(b.gap_percentage > 10, FALSE) THEN 'OVERPRICED'
    WHEN n.gap_percentage < -10 AND NOT coalesce(b.gap_percentage < -10, FALSE) THEN 'UNDERPRICED' END AS type, product_id, b.gap_percentage AS previous_gap, n.gap_percentage AS current_gap
  FROM now n LEFT JOIN before b USING (product_id)) WHERE type IS NOT NULL"""
