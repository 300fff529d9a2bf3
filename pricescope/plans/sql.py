"""Layers of common table expressions for the oracle SQL. Each layer needs those before it."""

from __future__ import annotations


def r2(x: str, digits: int = 2) -> str:
    """Half away from zero on the shortest decimal form."""
    return f"(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE) + 0.0)"


def pct(value: str, base: str) -> str:
    return r2(f"(({value} - {base}) / nullif({base}, 0) * 100)")


def position(gap: str) -> str:
    return f"""CASE WHEN {gap} < -10 THEN 'UNDERPRICED' WHEN {gap} < -5 THEN 'SLIGHTLY_UNDERPRICED' WHEN {gap} <= 5 THEN 'MARKET_ALIGNED'
    WHEN {gap} <= 10 THEN 'SLIGHTLY_OVERPRICED' WHEN {gap} IS NOT NULL THEN 'OVERPRICED' END"""


AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"

DOMAIN = f"""
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS VARCHAR) AS size,
    CASE WHEN p_partkey % 5 <> 0 THEN 'USD' END AS currency,
    CASE WHEN p_partkey % 97 = 0 THEN TRUE WHEN p_partkey % 89 = 0 THEN NULL ELSE FALSE END AS is_demo,
    {AS_OF} - INTERVAL 1 DAY * (p_partkey % 400) AS last_checked_at
  FROM part),
retailers AS (
  SELECT s_suppkey AS retailer_id, s_name AS retailer_name, 'shop' || s_suppkey || '.example.com' AS domain, s_suppkey % 10 = 0 AS is_brand_store
  FROM supplier),
sources AS (
  SELECT l_partkey * 1000000 + l_suppkey AS source_id, l_partkey AS product_id, l_suppkey AS retailer_id,
    'https://shop' || l_suppkey || '.example.com/p/' || l_partkey AS url, so = 0 AS is_own_store, so AS sort_order,
    CASE WHEN (l_partkey * 1000000 + l_suppkey) % 17 = 0 THEN 'failed' WHEN (l_partkey * 1000000 + l_suppkey) % 23 = 0 THEN 'pending' ELSE 'success' END AS scraping_status,
    CASE WHEN (l_partkey * 1000000 + l_suppkey) % 17 = 0 AND (l_partkey * 1000000 + l_suppkey) % 2 = 0 THEN 'Timed out' END AS last_error,
    CASE WHEN (l_partkey * 1000000 + l_suppkey) % 17 = 0 OR (l_partkey * 1000000 + l_suppkey) % 23 <> 0 THEN last END AS last_scraped_at
  FROM (SELECT l_partkey, l_suppkey, max(l_shipdate) AS last, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS so
        FROM lineitem GROUP BY l_partkey, l_suppkey)),
observations AS (
  SELECT l_partkey * 1000000 + l_suppkey AS source_id, l_partkey AS product_id, l_suppkey AS retailer_id,
    {r2("(p_retailprice * (1 - 2 * l_discount) * (1 + 2 * l_tax))")} AS price, p_retailprice AS original_price,
    CASE WHEN l_linenumber = 7 THEN 'EUR' WHEN l_linenumber <> 6 THEN 'USD' END AS currency,
    CASE l_returnflag WHEN 'R' THEN 'out_of_stock' WHEN 'A' THEN 'in_stock' ELSE 'unknown' END AS availability,
    l_shipdate AS scraped_at, l_orderkey AS order_key, l_linenumber AS order_line
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

LATEST = """
latest AS (
  SELECT source_id, price, original_price, currency, availability, scraped_at
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY scraped_at DESC, order_key DESC, order_line DESC, price DESC) AS rn FROM observations)
  WHERE rn = 1),
listed AS (SELECT s.*, l.price, l.original_price, l.currency, l.availability, l.scraped_at FROM sources s LEFT JOIN latest l USING (source_id))"""


def market(out_of_stock: bool = False) -> str:
    excluded = "" if out_of_stock else "WHEN availability = 'out_of_stock' THEN 'OUT_OF_STOCK'"
    return f"""
inputs AS (
  SELECT product_id, source_id, retailer_id, is_own_store, sort_order, success,
    CASE WHEN success THEN price END AS price, CASE WHEN success THEN currency END AS currency, CASE WHEN success THEN availability END AS availability
  FROM (SELECT *, scraping_status = 'success' AND scraped_at IS NOT NULL AS success FROM listed)),
own AS (
  SELECT product_id, CASE WHEN success AND price > 0 THEN price END AS own_price, CASE WHEN success AND price > 0 THEN currency END AS own_currency
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sort_order, source_id) AS rn FROM inputs WHERE is_own_store) WHERE rn = 1),
votes AS (
  SELECT product_id, currency AS vote FROM (
    SELECT product_id, currency, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, min(sort_order)) AS rn
    FROM inputs WHERE success AND NOT is_own_store AND currency IS NOT NULL GROUP BY product_id, currency) WHERE rn = 1),
market AS (
  SELECT *, CASE WHEN NOT is_own_store THEN CASE WHEN NOT success OR price IS NULL THEN 'FAILED' {excluded}
      WHEN NOT coalesce(price > 0, FALSE) THEN 'INVALID_PRICE' WHEN currency <> reference_currency THEN 'CURRENCY_MISMATCH' END END AS exclusion
  FROM (SELECT i.*, coalesce(i.price > 0, FALSE) AS valid, own_price, coalesce(own_currency, vote) AS reference_currency
        FROM inputs i LEFT JOIN own USING (product_id) LEFT JOIN votes USING (product_id))),
stats AS (
  SELECT product_id, any_value(own_price) AS own_price, any_value(reference_currency) AS currency,
    count(*) FILTER (NOT is_own_store) AS competitor_count, count(*) FILTER (inc) AS n,
    min(price) FILTER (inc) AS mn, max(price) FILTER (inc) AS mx, CAST(sum(CAST(price AS DECIMAL(28, 9))) FILTER (inc) AS DOUBLE) / nullif(count(price) FILTER (inc), 0) AS av, median(price) FILTER (inc) AS md,
    count(*) FILTER (inc AND price < own_price) AS cheaper, count(*) FILTER (inc AND price = own_price) AS equal, count(*) FILTER (inc AND price > own_price) AS more_expensive
  FROM (SELECT *, NOT is_own_store AND exclusion IS NULL AS inc FROM market) GROUP BY product_id)"""


ANALYSIS = f"""
figures AS (
  SELECT product_id, currency, ok, CASE WHEN ok THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status,
    CASE WHEN own_price IS NULL THEN 'NO_OWN_PRICE' WHEN n = 0 THEN 'NO_COMPETITOR_PRICES' END AS reason, own_price,
    {r2("mn")} AS market_minimum, {r2("mx")} AS market_maximum, {r2("av")} AS market_average, {r2("md")} AS market_median,
    CASE WHEN ok THEN {pct("own_price", "mn")} END AS versus_minimum, CASE WHEN ok THEN {pct("own_price", "mx")} END AS versus_maximum,
    CASE WHEN ok THEN {pct("own_price", "av")} END AS versus_average, CASE WHEN ok THEN {pct("own_price", "md")} END AS gap_percentage,
    competitor_count, n AS successful_competitor_count,
    CASE WHEN ok THEN cheaper END AS cheaper, CASE WHEN ok THEN equal END AS equal, CASE WHEN ok THEN more_expensive END AS more_expensive
  FROM (SELECT *, own_price IS NOT NULL AND n > 0 AS ok FROM stats)),
suggested AS (
  SELECT *, CASE WHEN ok THEN {r2("CASE position WHEN 'UNDERPRICED' THEN market_median * 0.98::DOUBLE WHEN 'SLIGHTLY_UNDERPRICED' THEN market_median * 0.99::DOUBLE WHEN 'SLIGHTLY_OVERPRICED' THEN market_median WHEN 'OVERPRICED' THEN market_median * 1.02::DOUBLE ELSE own_price END")} END AS suggested_price
  FROM (SELECT *, {position("gap_percentage")} AS position FROM figures)),
analysis AS (
  SELECT product_id, currency, status, reason, own_price, market_minimum, market_maximum, market_average, market_median, versus_minimum, versus_maximum,
    versus_average, gap_percentage, competitor_count, successful_competitor_count, cheaper, equal, more_expensive, position, suggested_price,
    change_amount, {r2("(change_amount / nullif(own_price, 0) * 100)")} AS change_percentage,
    CASE WHEN status = 'OK' THEN CASE WHEN position = 'MARKET_ALIGNED' THEN 'CURRENT_PRICE' ELSE 'MARKET_MEDIAN' END END AS basis
  FROM (SELECT *, {r2("(suggested_price - own_price)")} AS change_amount FROM suggested))"""


def with_layers(*layers: str, select: str) -> str:
    return "WITH " + ",".join(layers) + "\n" + select
