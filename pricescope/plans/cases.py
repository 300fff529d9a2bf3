"""Rules over single texts and small facts, each over all rows of a table that the texts are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricescope.functions import web
from pricescope.functions.numeric import is_valid_price
from pricescope.operators import imports, page_prices, pages, reports
from pricescope.operators.listing import with_place
from pricescope.operators.tables import upsert
from pricescope.plans.edges import canonical_brands, link_errors, official_stores
from pricescope.plans.sql import DOMAIN, with_layers
from pricescope.sources import shop_pages, written
from pricescope.sources.domain import Domain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) if not isinstance(v, Column) else v for v in values]), (place % len(values)).cast("int"))


def _part() -> Column:
    return F.col("p_partkey")


def _sql_list(values: list, place: str) -> str:
    shown = ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" for v in values)
    return f"([{shown}])[CAST({place} % {len(values)} + 1 AS INTEGER)]"


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"


def b01_valid_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items, of which some are zero, negative, missing, not a number or endless."""
    odd = _one_of([F.lit(0.0), -F.col("l_extendedprice"), F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf")), *[F.col("l_extendedprice")] * 3], F.col("l_orderkey"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("price"))
    return rows.select("l_orderkey", "l_linenumber", is_valid_price(F.col("price")).alias("valid"))


def h09_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's price, written in the ways of several countries."""
    plain = F.format_number("p_retailprice", 2)
    turned = F.translate(plain, ",.", ".,")
    texts = [F.concat(F.lit("$"), plain), F.concat(turned, F.lit(" €")), F.concat(F.lit("CHF "), F.translate(plain, ",", "'")), F.concat(F.translate(plain, ",", ""), F.lit(" 1.00")), F.lit("free"), F.concat(F.lit("now "), F.translate(turned, ".", " ")), F.lit("0.00"), F.lit(None).cast("string")]
    return _table(spark, sf_dir, "part").select(_part().alias("part"), web.parse_amount(_one_of(texts, _part())).alias("amount"))


#: What stands beside a price, and the currency that it is.
MONEY = [("AED ", "AED"), ("€", "EUR"), ("US$ ", "USD"), ("C$", "CAD"), ("$", "USD"), ("E£ ", "EGP"), ("LE ", "EGP"), ("SALE ", None), ("ر.س ", "SAR"), ("", None), ("Dhs ", "AED"), ("¥", "JPY"), ("XAEDX ", None)]
STOCK = [("http://schema.org/InStock", "in_stock"), ("OutOfStock", "out_of_stock"), ("sold out", "out_of_stock"), ("Pre-Order", "preorder"), ("LimitedAvailability", "limited"), ("low_stock", "limited"), ("soon", "unknown"), ("https://schema.org/Discontinued", "out_of_stock"), (None, "unknown")]
MESSAGES = [("Timeout {}ms exceeded", "TIMEOUT"), ("page.goto: net::ERR_NAME_NOT_RESOLVED at {}", "UNAVAILABLE"), ("net::ERR_CONNECTION_RESET {}", "UNAVAILABLE"), ("net::ERR_HTTP2_PROTOCOL_ERROR {}", "BLOCKED"), ("net::ERR_CERT_DATE_INVALID {}", "UNAVAILABLE"), ("Target closed {}", "RENDER_FAILURE"), ("odd {}", "UNKNOWN")]


def h10_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency beside each order's total."""
    text = F.concat(_one_of([t for t, _ in MONEY], F.col("o_orderkey")), F.format_number("o_totalprice", 2))
    return _table(spark, sf_dir, "orders").select("o_orderkey", web.detect_currency(text).alias("currency"))


def h11_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Domain(spark, sf_dir).sources.select("source_id", web.normalize_availability(_one_of([t for t, _ in STOCK], F.col("source_id"))).alias("availability"))


def h14_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's error message as a code."""
    i = F.col("source_id")
    text = F.replace(_one_of([t for t, _ in MESSAGES], i), F.lit("{}"), i.cast("string"))
    return Domain(spark, sf_dir).sources.select("source_id", web.classify_error(text).alias("code"))


def h12_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = pages.snapshots(shop_pages.product_pages(spark, sf_dir))
    return shown.select("page_id", web.page_problem(F.col("http_status"), F.col("title"), F.col("visible_text"), F.col("html")).alias("problem"))


def h15_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses as they are, with another scheme, and on hosts that aren't public."""
    i, url = F.col("page_id"), F.col("url")
    texts = [F.lit("https://shop.com/x"), F.replace(F.lit("https://a.com/{}"), F.lit("https"), F.lit("ftp")), F.concat(F.lit("http://192.168.1."), i % 250, F.lit("/a")), F.concat(F.lit("http://172."), i % 64, F.lit(".0.1")), F.concat(F.lit("http://printer"), i, F.lit(".local/")), F.lit("http://localhost:3000"), F.lit("not an address"), F.lit(None).cast("string")]
    rows = _table(spark, sf_dir, "pages").select("page_id", F.when(i % 3 == 0, url).otherwise(_one_of(texts, i)).alias("url"))
    return rows.select("page_id", web.is_scrapable(F.col("url")).alias("scrapable"))


def t22_store_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of the stores' domains."""
    i = F.col("retailer_id").cast("string")
    texts = [F.col("domain"), F.concat(F.lit("www.big_shop"), i, F.lit(".net")), F.concat(F.lit("shop.brand"), i, F.lit(".co.uk")), F.concat(F.lit("store-"), i, F.lit(".com"))]
    return Domain(spark, sf_dir).retailers.select("retailer_id", web.store_name(_one_of(texts, F.col("retailer_id"))).alias("name"))


def b10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every product, some of which are given twice in other spellings or are the own one."""
    links = Domain(spark, sf_dir).sources.select("product_id", F.col("is_own_store").alias("is_own"), "url", "sort_order")
    own = F.concat(F.lit("HTTPS://shop.example.com/"), F.col("product_id"), F.lit("/"))
    p, s = F.col("product_id"), F.col("sort_order")
    url = F.when(F.col("is_own") | ((p % 5 == 0) & (s == 1)), F.when(F.col("is_own"), F.lower(own)).otherwise(own)).when((p % 7 == 0) & (s == 3), F.concat(F.lit("https://twice.com/"), p, F.lit("#top"))).when((p % 7 == 0) & (s == 2), F.concat(F.lit("https://Twice.com/"), p)).otherwise(F.col("url"))
    return link_errors(links.select("product_id", "is_own", url.alias("url")))


def _brands(d: Domain) -> DataFrame:
    """The brands of the catalog: name, slug, domain and place in the list."""
    n = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    names = d.products.select(F.col("brand").alias("name")).distinct()
    return names.select("name", F.concat(F.lit("brand-"), n).alias("slug"), F.concat(F.lit("shop"), n * 10, F.lit(".example.com")).alias("official_domain"), n.alias("place"))


def c09_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose brand is spelled in other ways."""
    d = Domain(spark, sf_dir)
    spelled = [F.col("brand"), F.concat(F.lit("  "), F.upper("brand"), F.lit(" ")), F.replace(F.lower("brand"), F.lit("#"), F.lit("-")), F.concat(F.lit(" Other "), F.col("product_id"), F.lit(" ")), F.lit(" "), F.lit(None).cast("string")]
    return canonical_brands(d.products.select("product_id", _one_of(spelled, F.col("product_id")).alias("brand")), _brands(d))


def c10_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand stores told by their domain or by the brand in their name."""
    d = Domain(spark, sf_dir)
    name = F.when(F.col("retailer_id") % 20 == 0, F.concat(F.lit("The BRAND#1"), F.floor(F.col("retailer_id") / 20) % 5 + 1, F.lit(" outlet"))).otherwise(F.col("retailer_name"))
    return official_stores(d.retailers.withColumn("retailer_name", name), _brands(d))


def h01_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.structured_offers(shop_pages.product_pages(spark, sf_dir))
    return found.select("page_id", "place", "name", "brand", "price", "currency", "availability")


def h08_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_availability(shop_pages.product_pages(spark, sf_dir))


def h02_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of pages whose markup is made of their copy; each is asked twice."""
    rows = written.content_pages(spark, sf_dir)
    asked = F.transform(F.concat("faq", F.transform("bullets", lambda b: F.concat(b, F.lit("?"))), "faq"), lambda q: F.struct(F.lit("Question").alias("@type"), q.alias("name")))
    graph = F.to_json(F.struct(F.lit("FAQPage").alias("@type"), asked.alias("mainEntity")))
    return pages.faq_questions(rows.select(F.col("source_id").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit("</script>")).alias("html")))


def h18_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as structured data, rated of 100; pages of one review each."""
    given = F.struct(F.lit("Review").alias("@type"), F.struct(F.concat(F.lit("Buyer "), F.col("retailer_id")).alias("name")).alias("author"), F.struct((F.col("rating") * 20).alias("ratingValue")).alias("reviewRating"), F.col("body").alias("reviewBody"))
    graph = F.to_json(F.struct(F.lit("Product").alias("@type"), F.array(given, given).alias("review")))
    html = F.concat(F.lit("<script type='application/ld+json'>"), graph, F.lit("</script>"))
    return pages.structured_reviews(written.reviews(spark, sf_dir).select(F.col("review_id").alias("page_id"), html.alias("html"))).select("page_id", "n", "author", "rating", "body")


#: A review's block in the ways of shops; {author}, {stars} and {body} are filled in.
WIDGETS = [
    '<div itemprop="review"><span itemprop="author">{author}</span><div itemprop="reviewRating"><meta itemprop="ratingValue" content="{stars}"></div><p itemprop="reviewBody">{body}</p></div>',
    '<div class="jdgm-rev"><span class="jdgm-rev__author">{author}</span><div class="jdgm-rev__rating" aria-label="{stars} stars"></div><div class="jdgm-rev__body">{body}</div></div>',
    '<ol class="commentlist"><li class="review"><strong class="woocommerce-review__author">{author}</strong><div class="star-rating" aria-label="Rated {stars} out of 5"></div><div class="description">{body}</div></li></ol>',
    '<div class="spr-review"><p class="review-text">{body}</p></div>',
    '<nav><div class="product-review">{body}</div></nav>',
]


def h18_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as blocks of shops' pages, beside a page's other elements."""
    rows = written.reviews(spark, sf_dir)
    html = _one_of(WIDGETS, F.col("review_id"))
    fills = {"{author}": F.concat(F.lit("Buyer "), F.col("retailer_id")), "{stars}": (F.col("review_id") % 5 + 1).cast("string"), "{body}": F.col("body")}
    for mark, value in fills.items():
        html = F.replace(html, F.lit(mark), value)
    return pages.page_reviews(rows.select(F.col("review_id").alias("page_id"), F.concat(F.lit("<main><p>Stars and reviews</p>"), html, F.lit("</main>")).alias("html"))).select("page_id", "n", "author", "rating", "body")


def h19_buy_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part on a page of a marketplace or of a shop: in its box, out of stock, or without a box."""
    part = _table(spark, sf_dir, "part")
    host = _one_of(["https://www.amazon.ae/dp/", "https://amazon.com/dp/", "https://shop.com/", "https://www.amazon.com/dp/"], _part())
    stock = _one_of(["In stock", "Currently unavailable.", "Currently unavailable.", "In stock"], _part())
    button = F.when(_part() % 4 % 3 == 0, '<input id="add-to-cart-button">').otherwise("")
    box = F.when(_part() % 4 == 0, F.concat(F.lit("AED "), F.format_number("p_retailprice", 2))).otherwise("")
    html = F.concat(F.lit("<main><p>Other sellers from AED 30.00</p></main><div id='availability'>"), stock, F.lit("</div>"), button, F.lit('<div id="corePrice_feature_div"><span class="a-offscreen">'), box, F.lit("</span></div>"))
    shown = pages.snapshots(part.select(_part().alias("page_id"), F.concat(host, _part()).alias("url"), html.alias("html")))
    return pages.buy_box(page_prices.analyze_pages(shown), shown).select("page_id", "price", "currency", "availability")


def h05_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's page may be read, by its store's rules."""
    d = Domain(spark, sf_dir)
    texts = ["User-agent: *\nDisallow: /p/1 # not these\nAllow: /p/10\nCrawl-delay: 2\n", "User-agent: *\r\nDisallow: /\r\n\r\nUser-agent: PriceBot\r\nUser-agent: other\r\nDisallow: /*5$\r\n", "Disallow: /\nUser-agent: *\nDisallow:\n"]
    i = F.col("retailer_id")
    files = d.retailers.where(i % 4 != 3).select(F.concat(F.lit("https://"), "domain").alias("origin"), _one_of([*texts, ""], i).alias("content"))
    return pages.robots_verdicts(d.sources.select(F.col("source_id").alias("url_id"), "url"), pages.robots_rules(files, "PriceBot/1.0"))


def _sheet(d: Domain) -> DataFrame:
    """A planned sheet: a row for each product, a column for each store; some cells lack a price or an address."""
    i = F.col("source_id")
    url = F.when(i % 6 == 0, None).when(i % 6 == 1, "nowhere").otherwise(F.col("url"))
    cells = d.sources.select(F.col("product_id").alias("row_id"), F.col("retailer_id").cast("string").alias("store_key"), url.alias("url"), F.when(i % 5 != 0, (i % 997).cast("double")).alias("price"), (i % 7 == 0).alias("out_of_stock"))
    stores = d.retailers.select(F.col("retailer_id").cast("string").alias("store_key"), F.col("retailer_name").alias("name"), (F.col("retailer_id") == 1).alias("is_own_store"), F.col("retailer_id").alias("listed"))
    return imports.plan_sheet(stores, cells)


def n01_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(Domain(spark, sf_dir))


def n01_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with several own stores, stores that nobody knows, and names given twice."""
    d = Domain(spark, sf_dir)
    stores = d.retailers.where("retailer_id % 3 <> 0").select(F.col("retailer_id").cast("string").alias("store_key"), (F.col("retailer_id") % 10 == 1).alias("is_own_store"))
    names = d.products.select(F.col("product_id").alias("row_id"), F.when(F.col("product_id") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit(" "), "name")).alias("name"))
    return imports.sheet_errors(stores, names, d.sources.select(F.col("product_id").alias("row_id"), F.col("retailer_id").cast("string").alias("store_key")))


def n02_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sheet adds to products that have every third of its sources."""
    d = Domain(spark, sf_dir)
    known = d.sources.where("source_id % 3 = 0").select(F.col("product_id").alias("row_id"), "url")
    return imports.new_sources(_sheet(d), known).select("row_id", "url", "scraping_status", "observed_price")


def q02_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks of every product's chart: six even ones for each range of days up to its newest observation, seven daily ones for the week."""
    ends = Domain(spark, sf_dir).observations.groupBy("product_id").agg(F.unix_seconds(F.max("scraped_at")).alias("end"))
    ranges = ends.select("product_id", "end", F.explode(F.array(*[F.lit(n) for n in (7, 30, 90, 182, 365)])).alias("days"))
    end, days = F.col("end"), F.col("days")
    daily = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor(end / 86400) * 86400 - (6 - i) * 86400)
    even = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: end - days * 86400 + F.floor(i * days * 86400 / 5))
    return ranges.select("product_id", "days", F.posexplode(F.when(days == 7, daily).otherwise(even)).alias("place", "tick"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a report that was sent: to one or two people, of which some sendings failed."""
    k = F.col("o_orderkey")
    result = lambda name, bad: F.struct(F.lit(name).alias("email"), F.when(bad, "failed").otherwise("sent").alias("status"))
    results = F.when(k % 3 == 0, F.array(result("a", k % 2 == 0))).otherwise(F.array(result("a", k % 2 == 0), result("b", k % 5 == 0)))
    audience = _one_of(["ceo", "sales", "marketing"], F.col("o_custkey"))
    kpis = F.create_map(F.lit("compared"), F.floor("o_totalprice").cast("double"), F.lit("overpriced"), (k % 10).cast("double"), F.lit("aligned"), F.lit(1.0))
    return _table(spark, sf_dir, "orders").select(k.alias("log_id"), audience.alias("audience"), F.col("o_orderdate").cast("timestamp").alias("created_at"), results.alias("results"), kpis.alias("kpis"))


def v12_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures counted from the tables, against those of the last report that reached somebody."""
    d = Domain(spark, sf_dir)
    counts = d.products.agg(F.count("*").alias("compared"), F.count_if("is_demo").alias("overpriced"), F.count_if(F.col("currency").isNull()).alias("underpriced"), F.lit(None).cast("bigint").alias("aligned"), F.countDistinct("brand").alias("restocks"), F.countDistinct("category").alias("newAlerts"))
    values = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("kpi", "value"))
    return reports.key_figures(values, reports.previous_snapshot(_logs(spark, sf_dir), "ceo"), "ceo")


def v17_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_history(_logs(spark, sf_dir))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    email = F.concat(F.when(i % 2 == 0, "C").otherwise("c"), i, F.lit("@x.com"))
    return _table(spark, sf_dir, "customer").select(i.alias("recipient_id"), email.alias("email"), F.col("c_name").alias("name"), _one_of(["ceo", "sales", "marketing"], i).alias("team"), (i % 10 != 0).alias("is_active"))


def v14_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets which report: asked for twice, for all, by nobody known."""
    i = F.col("recipient_id")
    people = _people(spark, sf_dir)
    wanted = people.select((F.when(i % 50 == 0, -i).otherwise(i)).alias("recipient_id"), _one_of(["auto", None, "auto", "all"], i).alias("audience"))
    return reports.group_recipients(people, wanted.unionByName(wanted.where("recipient_id % 4 <> 3")))


def x04_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients after an upsert by address, ordered by team, name and address."""
    people = _people(spark, sf_dir).withColumn("email", F.lower("email")).drop("recipient_id")
    incoming = people.where(F.length("email") % 2 == 0).withColumns({"name": F.upper("name"), "is_active": F.lit(True)})
    after = upsert(people.where("team <> 'sales'"), incoming, "email", ["name", "team"], ["is_active"])
    return with_place(after, F.col("team"), F.col("name"), F.col("email"))


def a15_store_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of stores' data by brand, as JSON: decimal texts of variants, or whole numbers with their number of minor digits."""
    part = _table(spark, sf_dir, "part")
    money = F.format_number("p_retailprice", 2)
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    handle = _part().cast("string").alias("handle")
    variants = F.array(F.struct(F.replace(money, F.lit(","), F.lit("")).alias("price"), (_part() % 3 != 0).alias("available")))
    shop = part.where(_part() % 2 == 0).select(F.to_json(F.struct(F.array(F.struct(handle, variants.alias("variants"))).alias("products"))).alias("body"))
    woo = part.where(_part() % 2 == 1).select(F.to_json(F.struct(handle, F.struct(cents.alias("price"), F.lit(2).alias("minor")).alias("prices"), (_part() % 3 != 0).alias("in_stock"))).alias("body"))
    parsed = shop.select(F.explode(F.from_json("body", "products array<struct<handle: string, variants: array<struct<price: string, available: boolean>>>>")["products"]).alias("p"))
    first = parsed.select(F.col("p.handle").alias("handle"), F.explode("p.variants").alias("v")).select("handle", F.col("v.price").cast("double").alias("price"), F.col("v.available").alias("in_stock"))
    second = woo.select(F.from_json("body", "handle string, prices struct<price: string, minor: int>, in_stock boolean").alias("p"))
    return first.unionByName(second.select("p.handle", (F.col("p.prices.price").cast("double") / F.pow(F.lit(10.0), F.col("p.prices.minor"))).alias("price"), "p.in_stock"))


QUERIES = {
    "b01_valid_price": b01_valid_price,
    "h09_amounts": h09_amounts,
    "h10_currencies": h10_currencies,
    "h11_availability": h11_availability,
    "h14_errors": h14_errors,
    "h12_usability": h12_usability,
    "h15_addresses": h15_addresses,
    "t22_store_names": t22_store_names,
    "b10_link_errors": b10_links,
    "c09_canonical_brands": c09_brands,
    "c10_official_stores": c10_official,
    "h01_structured_offers": h01_offers,
    "h08_page_availability": h08_availability,
    "h02_faq_questions": h02_faq,
    "h18_markup_reviews": h18_markup,
    "h18_widget_reviews": h18_widgets,
    "h19_h20_buy_box": h19_buy_box,
    "h05_robots": h05_robots,
    "n01_a12_plan_sheet": n01_plan,
    "n01_sheet_errors": n01_errors,
    "n02_import_sheet": n02_import,
    "q02_chart_ticks": q02_ticks,
    "v12_v09_key_figures": v12_figures,
    "v17_report_history": v17_history,
    "v14_recipients": v14_recipients,
    "x04_recipients": x04_recipients,
    "a15_store_data": a15_store_data,
}

_BODY = "trim(regexp_replace(body, '\\s+', ' ', 'g'))"
_PLAN = """
cells AS (
  SELECT product_id AS row_id, CAST(retailer_id AS VARCHAR) AS store_key, retailer_id = 1 AS is_own_store, retailer_id, CASE source_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nowhere' ELSE url END AS url,
    CASE WHEN source_id % 5 <> 0 AND source_id % 997 > 0 THEN CAST(source_id % 997 AS DOUBLE) END AS price, source_id % 7 = 0 AS out_of_stock, source_id FROM sources),
planned AS (
  SELECT c.*, place AS sort_order, CASE WHEN url IS NULL THEN CASE WHEN price IS NOT NULL THEN 'MISSING_URL' END WHEN url = 'nowhere' THEN 'INVALID_URL' ELSE 'SOURCE' END AS outcome,
    CASE WHEN url LIKE 'https:%' THEN 'shop' || retailer_id || '.example.com' END AS domain, CASE WHEN out_of_stock THEN 'out_of_stock' ELSE 'unknown' END AS availability
  FROM cells c JOIN (SELECT retailer_id, row_number() OVER (ORDER BY retailer_id = 1 DESC, retailer_id) - 1 AS place FROM retailers) USING (retailer_id))"""
_LOGS_SQL = f"""
logs AS (
  SELECT o_orderkey AS log_id, {_sql_list(["ceo", "sales", "marketing"], "o_custkey")} AS audience, o_orderdate AS created_at, o_orderkey % 2 = 0 AS a_failed, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 = 0 END AS b_failed,
    floor(o_totalprice) AS compared, CAST(o_orderkey % 10 AS DOUBLE) AS overpriced FROM orders)"""
_PEOPLE_SQL = f"people AS (SELECT c_custkey AS i, 'c' || c_custkey || '@x.com' AS email, c_name AS name, {_sql_list(['ceo', 'sales', 'marketing'], 'c_custkey')} AS team, c_custkey % 10 <> 0 AS is_active FROM customer)"

ORACLES = {
    "b01_valid_price": "SELECT l_orderkey, l_linenumber, l_orderkey % 8 >= 5 AND l_extendedprice > 0 AS valid FROM lineitem",
    "h09_amounts": f"SELECT p_partkey AS part, CASE WHEN p_partkey % 8 IN (4, 6, 7) THEN NULL ELSE {_CENTS} / 100.0::DOUBLE END AS amount FROM part",
    "h10_currencies": f"SELECT o_orderkey, {_sql_list([c for _, c in MONEY], 'o_orderkey')} AS currency FROM orders",
    "h11_availability": with_layers(DOMAIN, select=f"SELECT source_id, {_sql_list([c for _, c in STOCK], 'source_id')} AS availability FROM sources"),
    "h14_errors": with_layers(DOMAIN, select=f"SELECT source_id, {_sql_list([c for _, c in MESSAGES], 'source_id')} AS code FROM sources"),
    "h12_usability": "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 13 = 0 THEN 'BLOCKED' WHEN p_partkey % 17 = 0 THEN 'UNAVAILABLE' END AS problem FROM part",
    "h15_addresses": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN coalesce(regexp_matches(url, '^(?i)https?://[^/?#]'), FALSE)
        WHEN page_id % 8 = 0 THEN TRUE WHEN page_id % 8 = 3 THEN page_id % 64 NOT BETWEEN 16 AND 31 ELSE FALSE END AS scrapable FROM pages""",
    "t22_store_names": with_layers(DOMAIN, select="SELECT retailer_id, CASE retailer_id % 4 WHEN 0 THEN 'Shop' || retailer_id WHEN 1 THEN 'Big Shop' || retailer_id WHEN 2 THEN 'Brand' || retailer_id ELSE 'Store ' || retailer_id END AS name FROM retailers"),
    "b10_link_errors": with_layers(
        DOMAIN,
        select="""SELECT product_id, unnest(list_filter([CASE WHEN n - 1 NOT BETWEEN 1 AND 20 THEN 'COMPETITORS' END, CASE WHEN product_id % 5 = 0 AND n > 1 THEN 'OWN_URL' END,
            CASE WHEN product_id % 7 = 0 AND n > 3 THEN 'DUPLICATE' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT product_id, count(*) AS n FROM sources GROUP BY 1)""",
    ),
    "c09_canonical_brands": with_layers(DOMAIN, select="SELECT product_id, CASE product_id % 6 WHEN 3 THEN 'Other ' || product_id WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE brand END AS brand FROM products"),
    "c10_official_stores": with_layers(
        DOMAIN,
        select="""SELECT DISTINCT brand, retailer_id FROM (SELECT DISTINCT brand, CAST(substr(brand, 7) AS BIGINT) AS n FROM products), retailers
          WHERE is_brand_store AND (domain = 'shop' || n * 10 || '.example.com' OR (retailer_id % 20 = 0 AND n = 11 + retailer_id // 20 % 5))""",
    ),
    "h01_structured_offers": shop_pages.OFFERS_SQL,
    "h08_page_availability": shop_pages.STOCK_SQL,
    "h02_faq_questions": f"""WITH {written.CONTENT_SQL}
      SELECT source_id AS page_id, q.place - 1 AS place, q.question FROM (SELECT source_id, unnest(list_transform(list_concat(faq, list_transform(bullets, lambda b: b || '?')), lambda x, i: {{'place': i, 'question': x}})) AS q FROM pages0)""",
    "h18_markup_reviews": f"""WITH {written.REVIEWS_SQL} SELECT review_id AS page_id, 1 AS n, 'Buyer ' || retailer_id AS author, CASE WHEN NOT isnan(rating) THEN rating END AS rating, {_BODY} AS body FROM raw WHERE length({_BODY}) >= 8""",
    "h18_widget_reviews": f"""WITH {written.REVIEWS_SQL} SELECT review_id AS page_id, 1 AS n, CASE WHEN review_id % 5 < 3 THEN 'Buyer ' || retailer_id END AS author, CASE WHEN review_id % 5 < 3 THEN CAST(review_id % 5 + 1 AS DOUBLE) END AS rating, {_BODY} AS body
      FROM raw WHERE length({_BODY}) >= 8 AND review_id % 5 < 4""",
    "h19_h20_buy_box": f"""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN {_CENTS} / 100.0::DOUBLE WHEN 1 THEN 0 ELSE 30 END AS price, 'AED' AS currency, CASE WHEN p_partkey % 4 IN (0, 3) THEN 'in_stock' ELSE 'out_of_stock' END AS availability FROM part""",
    "h05_robots": with_layers(
        DOMAIN,
        select="""SELECT source_id AS url_id, CASE retailer_id % 4 WHEN 0 THEN NOT starts_with('/p/' || product_id, '/p/1') OR starts_with('/p/' || product_id, '/p/10') WHEN 1 THEN product_id % 10 <> 5 ELSE TRUE END AS allowed FROM sources""",
    ),
    "n01_a12_plan_sheet": with_layers(DOMAIN, _PLAN, select="SELECT row_id, store_key, is_own_store, sort_order, outcome, url, domain, price, availability FROM planned WHERE outcome IS NOT NULL"),
    "n01_sheet_errors": with_layers(
        DOMAIN,
        select="""SELECT 'OWN_STORES' AS error, CAST(n AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM retailers WHERE retailer_id % 3 <> 0 AND retailer_id % 10 = 1) WHERE n <> 1
          UNION ALL SELECT DISTINCT 'UNKNOWN_STORE', CAST(retailer_id AS VARCHAR) FROM sources WHERE retailer_id % 3 = 0 UNION ALL SELECT 'DUPLICATE_NAME', lower(trim(name)) FROM products GROUP BY 2 HAVING count(*) > 1""",
    ),
    "n02_import_sheet": with_layers(
        DOMAIN, _PLAN,
        select="""SELECT row_id, url, CASE WHEN price IS NOT NULL OR out_of_stock THEN 'success' ELSE 'pending' END AS scraping_status, CASE WHEN price IS NOT NULL OR out_of_stock THEN coalesce(price, 0) END AS observed_price
          FROM planned WHERE outcome = 'SOURCE' AND source_id % 3 <> 0""",
    ),
    "q02_chart_ticks": with_layers(
        DOMAIN, "ends AS (SELECT product_id, CAST(epoch(max(scraped_at)) AS BIGINT) AS e FROM observations GROUP BY 1)",
        select="""SELECT product_id, 7 AS days, i AS place, e // 86400 * 86400 - (6 - i) * 86400 AS tick FROM ends, range(7) t(i)
        UNION ALL SELECT product_id, d, i, e - d * 86400 + CAST(floor(i * d * 86400 / 5) AS BIGINT) FROM ends, range(6) t(i), (VALUES (30), (90), (182), (365)) r(d)""",
    ),
    "v12_v09_key_figures": with_layers(
        DOMAIN, _LOGS_SQL, "previous AS (SELECT * FROM logs WHERE audience = 'ceo' AND (NOT a_failed OR NOT coalesce(b_failed, TRUE)) ORDER BY created_at DESC, log_id DESC LIMIT 1)",
        select="""SELECT kpi, place, value, value - before AS delta FROM (
          SELECT 'compared' AS kpi, 1 AS place, CAST(count(*) AS DOUBLE) AS value, (SELECT compared FROM previous) AS before FROM products
          UNION ALL SELECT 'overpriced', 2, count(*) FILTER (is_demo), (SELECT overpriced FROM previous) FROM products
          UNION ALL SELECT 'underpriced', 3, count(*) FILTER (currency IS NULL), NULL FROM products UNION ALL SELECT 'newAlerts', 6, count(DISTINCT category), NULL FROM products)""",
    ),
    "v17_report_history": f"""WITH {_LOGS_SQL} SELECT log_id, audience, CAST(NOT a_failed AS INTEGER) + coalesce(CAST(NOT b_failed AS INTEGER), 0) AS sent, CAST(a_failed AS INTEGER) + coalesce(CAST(b_failed AS INTEGER), 0) AS failed
      FROM logs ORDER BY created_at DESC, log_id DESC LIMIT 20""",
    "v14_recipients": f"""WITH {_PEOPLE_SQL} SELECT audience, string_agg(shown, ',' ORDER BY shown) AS emails FROM (
        SELECT CASE WHEN (i % 50 = 0 AND i > 0) OR NOT is_active THEN 'rejected' WHEN i % 4 = 3 THEN 'all' ELSE team END AS audience, CASE WHEN i % 50 = 0 AND i > 0 THEN CAST(-i AS VARCHAR) ELSE email END AS shown FROM people) GROUP BY 1""",
    "x04_recipients": f"""WITH {_PEOPLE_SQL} SELECT email, name, team, is_active, row_number() OVER (ORDER BY team, name, email) AS place FROM (
        SELECT email, CASE WHEN team = 'sales' THEN upper(name) ELSE name END AS name, team, is_active OR length(email) % 2 = 0 AS is_active FROM people WHERE team <> 'sales' OR length(email) % 2 = 0)""",
    "a15_store_data": f"SELECT CAST(p_partkey AS VARCHAR) AS handle, {_CENTS} / 100.0::DOUBLE AS price, p_partkey % 3 <> 0 AS in_stock FROM part",
}
