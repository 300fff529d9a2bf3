"""Product pages of shops, one for each part, that tell their price in the ways that shops do.

A part's number decides how its page is made and answered; prices are the part's list price in whole cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.sources.written import dealt

#: Ways to tell a price, by the part's number; {price}, {sale} (80 % of it), {higher} and {name} are filled in.
BODIES = [
    # 0: structured data
    '<h1>{name}</h1><script type="application/ld+json">/* c */ {"@type": "Product", "name": "{name}", "brand": {"name": "{brand}"}, "image": "/img/{id}.jpg", "offers": {"price": "{price}", "priceCurrency": "USD", "availability": "https://schema.org/InStock"},}</script>',
    # 1: meta tags
    '<h1>{name}</h1><p>Nothing else is said here.</p>',
    # 2: microdata
    '<div><h1 itemprop="name">{name}</h1><span itemprop="price" content="{price}"></span><meta itemprop="priceCurrency" content="AED"><link itemprop="availability" href="http://schema.org/OutOfStock"></div>',
    # 3: an attribute, the currency from the text
    '<h1>{name}</h1><button data-price="{price}">Add to cart</button><p>Delivery from € 5.00, or € 9.00 by courier; $ 1.00 for wrapping</p>',
    # 4: the text alone
    '<main><h1>{name}</h1><p>Now {price} AED</p><p>Sold out</p></main>',
    # 5: structured data with the former price, the sale in the price block
    '<h1>{name}</h1><script type="application/ld+json">{"@type": "Product", "name": "{name}", "offers": {"price": "{price}", "priceCurrency": "USD", "availability": "InStock"}}</script>'
    '<div class="product-card"><span class="price-item--sale">$1.00</span></div><div class="product__block--price"><div class="price price--on-sale"><del>${price}</del><span class="price-item--sale">${sale}</span></div></div>',
    # 6: structured data with the sale, the former price struck through
    '<h1>{name}</h1><script type="application/ld+json">{"@type": "Product", "name": "{name}", "offers": {"price": "{sale}", "priceCurrency": "USD", "availability": "InStock"}}</script>'
    '<div class="product-info-price"><s>${price}</s> <ins>${sale}</ins></div>',
    # 7: several offers
    '<h1>{name}</h1><script type="application/ld+json">{"@type": "Product", "name": "{name}", "brand": "{brand}", "offers": [{"price": "{sale}", "priceCurrency": "USD", "availability": "OutOfStock"}, {"price": "{higher}", "priceCurrency": "USD", "availability": "InStock"}, '
    '{"price": "{price}", "priceCurrency": "USD", "availability": "LimitedAvailability"}]}</script>',
    # 8: the page is there, the product is gone
    "<h1>Sorry</h1><p>The page that you look for is no longer here.</p>",
    # 9: no price
    "<h1>{name}</h1><p>Ask in the store for what it costs today.</p>",
    # 10: the class of an element, beside a former price and another product's
    '<h1>{name}</h1><div class="recommended"><span class="price">$1.00</span></div><div class="box"><span class="old-price">${higher}</span><span class="sale-price">${price} <s>$9.00</s></span></div><button>Add to cart</button>',
    # 11: several offers, one of the page's variant
    '<h1>{name}</h1><script type="application/ld+json">{"@type": "Product", "name": "{name}", "offers": [{"price": "{sale}", "priceCurrency": "USD", "availability": "InStock", "url": "/p/{id}?variant=1"}, '
    '{"price": "{price}", "priceCurrency": "USD", "availability": "OutOfStock", "url": "/p/{id}?variant={id}"}]}</script>',
    # 12: an attribute in minor units, the amount beside it
    '<h1>{name}</h1><button data-price="{cents}"><b>${price}</b></button><p>In stock</p>',
    # 13: several offers, one of the page's address
    '<h1>{name}</h1><script type="application/ld+json">{"@type": "Product", "name": "{name}", "offers": [{"price": "{sale}", "priceCurrency": "USD", "availability": "InStock", "url": "/p/other"}, '
    '{"price": "{higher}", "priceCurrency": "USD", "availability": "OutOfStock", "url": "https://shop.example.com/p/{id}/"}]}</script>',
]
HEADS = ["<title>{name} | Shop</title>"] * 8 + ["<title>404 Not Found</title>", "<title>{name}</title>"] + ["<title>{name} | Shop</title>"] * 4
HEADS[1] += '<meta property="og:title" content="{name} online"><meta property="product:brand" content="{brand}"><meta property="og:image" content="https://cdn.example.com/{id}.png"><meta property="product:price:amount" content="{price}"><meta property="product:price:currency" content="EUR"><meta property="product:availability" content="preorder">'
PAGE = '<!DOCTYPE html><html lang="en"><head>{head}</head><body>{body}</body></html>'


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, http_status, html."""
    # A row of a part becomes a page: rows are dealt to all cores first.
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    money = lambda c: F.concat_ws("", F.floor(c / 100), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    kind = F.col("p_partkey") % len(BODIES)
    pages = [PAGE.replace("{head}", head).replace("{body}", body) for head, body in zip(HEADS, BODIES, strict=True)]
    html = F.get(F.array(*[F.lit(p) for p in pages]), kind.cast("int"))
    fills = {"{id}": F.col("p_partkey").cast("string"), "{name}": F.concat_ws(" ", "p_name", "p_partkey"), "{brand}": F.col("p_brand"), "{price}": money(cents), "{sale}": money(F.floor(cents * 8 / 10)), "{higher}": money(cents + 500), "{cents}": cents.cast("string")}
    for mark, value in fills.items():
        html = F.replace(html, F.lit(mark), value)
    status = F.when(F.col("p_partkey") % 13 == 0, 403).when(F.col("p_partkey") % 17 == 0, 404).when(F.col("p_partkey") % 19 != 0, 200)
    return part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/p/"), "p_partkey", F.when(kind == 11, F.concat(F.lit("?variant="), "p_partkey")).otherwise("")).alias("url"), status.cast("int").alias("http_status"), html.alias("html"))


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
#: What the rules must read from these pages.
ANALYSIS_SQL = f"""
told AS (SELECT p_partkey AS page_id, p_partkey % 14 AS kind, p_name || ' ' || p_partkey AS name, p_brand, {_CENTS} / 100.0::DOUBLE AS price, ({_CENTS} * 8 // 10) / 100.0::DOUBLE AS sale, ({_CENTS} + 500) / 100.0::DOUBLE AS higher,
    CASE WHEN p_partkey % 13 = 0 THEN 'BLOCKED' WHEN p_partkey % 17 = 0 THEN 'UNAVAILABLE' WHEN p_partkey % 14 = 8 THEN 'UNAVAILABLE' WHEN p_partkey % 14 = 9 THEN 'PRICE_NOT_FOUND' END AS problem FROM part),
analysed AS (
  SELECT page_id, problem, CASE WHEN problem IS NULL THEN CASE WHEN kind IN (5, 6) THEN sale WHEN kind = 13 THEN higher ELSE price END END AS price,
    CASE WHEN problem IS NULL THEN (['USD', 'EUR', 'AED', 'EUR', 'AED', 'USD', 'USD', 'USD', NULL, NULL, 'USD', 'USD', 'USD', 'USD'])[kind + 1] END AS currency,
    CASE WHEN problem IS NULL THEN CASE WHEN kind IN (5, 6) THEN price WHEN kind = 10 THEN higher END END AS original_price,
    CASE WHEN problem IS NULL AND kind IN (7, 11, 13) THEN sale END AS low_price, CASE WHEN problem IS NULL THEN CASE WHEN kind IN (7, 13) THEN higher WHEN kind = 11 THEN price END END AS high_price,
    CASE WHEN problem IS NULL THEN (['in_stock', 'preorder', 'out_of_stock', 'in_stock', 'out_of_stock', 'in_stock', 'in_stock', 'limited', NULL, NULL, 'in_stock', 'out_of_stock', 'in_stock', 'out_of_stock'])[kind + 1] END AS availability,
    CASE WHEN problem IS NULL THEN (['json-ld', 'meta', 'microdata', 'attributes', 'visible-text', 'json-ld', 'json-ld', 'json-ld', NULL, NULL, 'selectors', 'json-ld', 'attributes', 'json-ld'])[kind + 1] END AS strategy,
    CASE WHEN problem IS NULL THEN CASE WHEN kind IN (7, 11, 13) THEN 'PRICE_RANGE' ELSE '' END END AS warnings, kind NOT IN (8, 9) AS kind_known
  FROM told)"""
INFO_SQL = """
SELECT p_partkey AS page_id,
  CASE p_partkey % 14 WHEN 1 THEN p_name || ' ' || p_partkey || ' online' WHEN 8 THEN 'Sorry' ELSE p_name || ' ' || p_partkey END AS product_name,
  CASE WHEN p_partkey % 14 IN (0, 1, 7) THEN p_brand END AS brand,
  CASE p_partkey % 14 WHEN 0 THEN 'https://shop.example.com/img/' || p_partkey || '.jpg' WHEN 1 THEN 'https://cdn.example.com/' || p_partkey || '.png' END AS image_url
FROM part"""
#: The offers of the pages' structured data, and what the pages say of stock in markup or text.
OFFERS_SQL = f"WITH {ANALYSIS_SQL}" + """,
offers AS (
  SELECT page_id, kind, name, p_brand, unnest(CASE kind WHEN 0 THEN [(price, 'in_stock')] WHEN 5 THEN [(price, 'in_stock')] WHEN 6 THEN [(sale, 'in_stock')] WHEN 7 THEN [(sale, 'out_of_stock'), (higher, 'in_stock'), (price, 'limited')]
    WHEN 11 THEN [(sale, 'in_stock'), (price, 'out_of_stock')] WHEN 13 THEN [(sale, 'in_stock'), (higher, 'out_of_stock')] END) AS o,
    unnest(range(CASE kind WHEN 7 THEN 3 WHEN 11 THEN 2 WHEN 13 THEN 2 ELSE 1 END)) AS place FROM told WHERE kind IN (0, 5, 6, 7, 11, 13))
SELECT page_id, place, name, CASE WHEN kind IN (0, 7) THEN p_brand END AS brand, o[1] AS price, 'USD' AS currency, o[2] AS availability FROM offers"""
STOCK_SQL = f"WITH {ANALYSIS_SQL}" + """
SELECT page_id, (['unknown', 'preorder', 'out_of_stock', 'in_stock', 'out_of_stock', 'unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'in_stock', 'unknown', 'in_stock', 'unknown'])[kind + 1] AS availability FROM told"""
