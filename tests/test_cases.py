"""Rules on short lists of texts and facts whose results are known."""

import pytest
from pyspark.sql import functions as F

from pricescope.functions import web
from pricescope.functions.numeric import is_valid_price
from pricescope.operators import alerts, imports, page_prices, pages, reports
from pricescope.operators.tables import upsert
from pricescope.plans import report, slices
from pricescope.plans.edges import canonical_brands, link_errors, money_text, official_stores
from pricescope.sources import demo

#: Texts and what they must give.
AMOUNTS = [("$1,234.56", 1234.56), ("1.234,56 €", 1234.56), ("12,50 €", 12.5), ("12,500", 12500.0), ("CHF 1'299.00", 1299.0), ("KWD 12.750", 12.75), ("45.50 60.00", 45.5), ("free", None), ("0.00", None), ("1 234,50", 1234.5), ("1.234.567", 1234567.0), (None, None)]
CURRENCIES = [("AED 45.50", "AED"), ("45,50 €", "EUR"), ("US$ 5", "USD"), ("C$5", "CAD"), ("$5", "USD"), ("E£ 20", "EGP"), ("120 LE", "EGP"), ("SALE 5", None), ("١٢٠ ر.س", "SAR"), ("plain 5", None), (None, None), ("Dhs 20", "AED")]
STOCK = [("http://schema.org/InStock", "in_stock"), ("OutOfStock", "out_of_stock"), ("sold out", "out_of_stock"), ("Pre-Order", "preorder"), ("LimitedAvailability", "limited"), ("low_stock", "limited"), ("soon", "unknown"), (None, "unknown"), ("https://schema.org/Discontinued", "out_of_stock")]
NAMES = [("store-a.com", "Store A"), ("shop.brand.co.uk", "Brand"), ("mystore.example.com", "Mystore"), ("www.big_shop.net", "Big Shop"), ("m.com", "M"), ("", "")]
ADDRESSES = [("https://a.com/x", True), ("ftp://a.com", False), ("http://localhost:3000", False), ("http://192.168.1.4/a", False), ("http://172.20.0.1", False), ("http://172.40.0.1", True), ("not an address", False), (None, False), ("http://printer.local/", False)]
MESSAGES = [("Timeout 30000ms exceeded", "TIMEOUT"), ("page.goto: net::ERR_NAME_NOT_RESOLVED", "UNAVAILABLE"), ("net::ERR_CONNECTION_RESET", "UNAVAILABLE"), ("net::ERR_HTTP2_PROTOCOL_ERROR", "BLOCKED"), ("net::ERR_CERT_DATE_INVALID", "UNAVAILABLE"), ("Target closed", "RENDER_FAILURE"), ("odd", "UNKNOWN")]
SNAPSHOTS = [
    (1, 403, "x", "long enough text", "", "BLOCKED"),
    (2, 404, "x", "long enough text", "", "UNAVAILABLE"),
    (3, 503, "Just a moment...", "checking", "", "BLOCKED"),
    (4, 500, "Oops", "server error here", "", "UNAVAILABLE"),
    (5, 200, "Shampoo", "please solve the captcha", "", "BLOCKED"),
    (6, 200, "Shampoo", "", "<p></p>", "EMPTY_PAGE"),
    (7, 200, "Shampoo", "", '<script type="application/ld+json">', None),
    (8, None, "Shampoo", "A very good shampoo", "", None),
    (9, 200, "Shampoo", "A very good shampoo", '<form action="/validateCaptcha">', "BLOCKED"),
]
_LD = '<script type="application/ld+json">{}</script>'
HTML = [
    (1, _LD.format('{"@type": "Product", "name": "Oil", "offers": {"price": "45.50", "priceCurrency": "AED", "availability": "http://schema.org/InStock"}}')),
    (2, _LD.format('{"@graph": [{"@type": ["Thing", "Product"], "name": "Set", "brand": {"name": "B0"}, "offers": [{"price": 30, "priceCurrency": "USD", "availability": "OutOfStock"}, {"price": 32, "priceCurrency": "USD", "availability": "InStock"},]}]}')),
    (3, "<meta property='product:price:amount' content='1.234,56'><meta property='product:price:currency' content='EUR'>"),
    (4, '<span itemprop="price" content="19.99"></span><meta itemprop="priceCurrency" content="USD">'),
    (5, "<div>Now only <b>$ 12.50</b> a piece</div><script>var p = '$ 99'</script>"),
    (6, "<p>No price here</p>" + _LD.format("{broken")),
    (7, _LD.format('/* c */ {"@type": "Product", "name": "Range", "offers": {"@type": "AggregateOffer", "lowPrice": "10", "highPrice": "20", "priceCurrency": "SAR"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": "12"}}')),
    (8, '<button data-product-price="85">Buy</button>'),
]
#: Page, its address, its cart button, what it says of stock, and the price in its box.
BOXES = [(1, "https://www.amazon.ae/dp/1", True, "In stock", "AED 19.50"), (2, "https://amazon.com/dp/2", False, "Currently unavailable.", ""), (3, "https://shop.com/3", False, "Currently unavailable.", "$ 5.00"), (4, "https://www.amazon.com/dp/4", True, "In stock", "")]
ROBOTS = [
    ("https://a.com", "User-agent: *\nDisallow: /cart\nAllow: /cart/view\nCrawl-delay: 2\n\nUser-agent: PriceBot\nUser-agent: other\nDisallow: /private # no\nDisallow: /*.pdf$\nAllow: /private/ok"),
    ("https://b.com", "user-agent: *\r\ndisallow: /\r\nallow: /open\r\n"),
    ("https://c.com", "Disallow: /\nUser-agent: *\nDisallow:\n"),
]
TARGETS = [
    (1, "https://a.com/cart", True), (2, "https://a.com/private/x", False), (3, "https://a.com/private/ok?x=1", True), (4, "https://a.com/f/doc.pdf", False), (5, "https://a.com/f/doc.pdf?v=2", True),
    (6, "https://b.com/x", False), (7, "https://b.com/open/1#top", True), (8, "https://c.com/any", True), (9, "https://d.com/", True), (10, "https://b.com", False),
]
STORES = [("a", "Own", True, 2), ("b", "Shop B", False, 1), ("c", "Shop C", False, 3)]
CELLS = [(1, "a", "https://own.com/1", 500.0, False), (1, "b", None, 350.0, False), (1, "c", "https://www.c.com/1", None, True), (2, "a", "https://own.com/2", None, False), (2, "b", "nowhere", 20.0, False), (2, "c", None, None, False), (3, "b", "https://b.com/3", 0.0, False)]
_CELLS = "row_id bigint, store_key string, url string, price double, out_of_stock boolean"
LOGS = [
    (1, "ceo", "2024-01-01 08:00:00", [("a", "sent")], {"compared": 10.0, "overpriced": 2.0}),
    (2, "ceo", "2024-01-08 08:00:00", [("a", "failed"), ("b", "sent")], {"compared": 12.0, "overpriced": 5.0, "aligned": 1.0}),
    (3, "ceo", "2024-01-15 08:00:00", [("a", "failed")], {"compared": 99.0}),
    (4, "sales", "2024-01-16 08:00:00", [("c", "sent"), ("d", "sent")], {"restocks": 3.0}),
]
FIGURES = [("compared", 14.0), ("overpriced", 4.0), ("underpriced", 3.0), ("aligned", None), ("restocks", 9.0), ("newAlerts", 2.0)]
MARKUP = [
    (1, '<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "Is it vegan?"}, {"@type": "Question", "name": "Is it vegan?"}, {"@type": "Question", "name": "How much?"}]}</script>'),
    (
        2,
        '<script type="application/ld+json">{"@type": "Product", "review": [{"@type": "Review", "author": {"name": "Ann"}, "reviewRating": {"ratingValue": "80"}, "reviewBody": "Lovely  oil indeed", "datePublished": "2024-01-02"},'
        '{"@type": "Review", "author": {"name": "Ann"}, "reviewRating": {"ratingValue": "80"}, "reviewBody": "Lovely oil indeed", "datePublished": "2024-01-02"}, {"@type": "Review", "author": "Bob", "reviewBody": "short"},'
        '{"@type": "Review", "author": "Cy", "reviewRating": {"ratingValue": 4.26}, "description": "Works well for me"}]}</script><p>In stock now</p>',
    ),
    (3, '<link itemprop="availability" href="http://schema.org/OutOfStock"><p>Add to cart</p>'),
    (4, "<p>غير متوفر</p>"),
    (5, "<p>nothing</p>"),
]
WIDGET_PAGES = [
    (1, '<div itemprop="review"><span itemprop="author">Sara</span><meta itemprop="datePublished" content="2024-03-01"><div itemprop="reviewRating"><meta itemprop="ratingValue" content="80"></div><p itemprop="reviewBody">Gentle and light on the hair.</p></div>'),
    (2, '<div class="jdgm-rev"><span class="jdgm-rev__author">Nora</span><div class="jdgm-rev__rating" aria-label="5 stars"></div><div class="jdgm-rev__body">Best cream that I have tried.</div></div>'
        '<ol class="commentlist"><li class="review"><strong class="woocommerce-review__author">Huda</strong><div class="star-rating" aria-label="Rated 3 out of 5"></div><div class="description">Average results, nothing special.</div></li></ol>'),
    (3, '<nav><div class="product-review">A good link to reviews</div></nav><div class="product-review"><div class="stars"><i class="star on"></i><i class="star on"></i><i class="star"></i></div>Two stars for this one</div><div class="spr-review">short</div>'),
    (4, '<div class="spr-review"><p class="review-text">The very same words</p></div><div class="spr-review"><p class="review-text">The very same words</p></div>'),
    (5, "<p>No word of it</p>"),
]
LINKS = [(1, True, "https://own.com/a"), (1, False, "https://B.com/x/"), (1, False, "https://b.com/x#top"), (2, True, "https://own.com/b"), (2, False, "https://OWN.com/b/"), (3, True, "https://own.com/c"), (4, True, "https://own.com/d"), (4, False, "https://c.com/d")]
BRANDS = [("Acme Labs", "acme", "acme.com", 0), ("Nordic", "nordic", "nordic.example", 1), ("ACME LABS", "acme-2", "other.com", 2)]

def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = {"amounts": (AMOUNTS, web.parse_amount), "currencies": (CURRENCIES, web.detect_currency), "stock": (STOCK, web.normalize_availability), "names": (NAMES, web.store_name), "addresses": (ADDRESSES, web.is_scrapable), "messages": (MESSAGES, web.classify_error)}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_texts(spark, kind):
    cases, rule = TEXTS[kind]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id bigint, t string")
    assert rows_of(texts.select("id", rule(F.col("t")))) == sorted(((i, want) for i, (_, want) in enumerate(cases)), key=repr)


def test_valid_prices(spark):
    prices = spark.createDataFrame([(1, 1.5), (2, 0.0), (3, -4.0), (4, float("nan")), (5, float("inf")), (6, None), (7, 1e-9)], "id int, price double")
    assert {r["id"] for r in prices.where(is_valid_price(F.col("price"))).collect()} == {1, 7}


def test_usability(spark):
    rows = spark.createDataFrame([r[:5] for r in SNAPSHOTS], "id bigint, status int, title string, body string, html string")
    assert rows_of(rows.select("id", web.page_problem(F.col("status"), F.col("title"), F.col("body"), F.col("html")))) == sorted(((r[0], r[5]) for r in SNAPSHOTS), key=repr)


def test_offers(spark):
    got = pages.structured_offers(spark.createDataFrame(HTML, "page_id bigint, html string")).select("page_id", "place", "name", "brand", "price", "currency", "availability", "rating", "rating_count")
    want = [(1, 0, "Oil", None, 45.5, "AED", "in_stock", None, None), (2, 0, "Set", "B0", 30.0, "USD", "out_of_stock", None, None), (2, 1, "Set", "B0", 32.0, "USD", "in_stock", None, None), (7, 0, "Range", None, 10.0, "SAR", "unknown", 4.5, 12)]
    assert rows_of(got) == sorted(want, key=repr)


def shown(spark, html):
    return pages.snapshots(spark.createDataFrame([(i, f"https://shop.com/p/{i}?variant=b", h) for i, h in html], "page_id bigint, url string, html string"))


def test_prices(spark):
    want = [(1, "json-ld", 45.5, "AED"), (2, "json-ld", 32.0, "USD"), (3, "meta", 1234.56, "EUR"), (4, "microdata", 19.99, "USD"), (5, "visible-text", 12.5, "USD"), (7, "json-ld", 10.0, "SAR"), (8, "attributes", 85.0, None)]
    assert rows_of(page_prices.page_prices(shown(spark, HTML))) == sorted(want, key=repr)


def offers(*rows):
    listed = ", ".join(f'{{"price": "{p}", "priceCurrency": "USD", "availability": "{a}"{f", {chr(34)}url{chr(34)}: {chr(34)}{u}{chr(34)}" if u else ""}}}' for p, a, u in rows)
    return _LD.format(f'{{"@type": "Product", "offers": [{listed}]}}')


PRICES = [
    # The page's variant, though another is cheaper and in stock.
    (1, offers((10, "InStock", "/p/1?variant=a"), (12, "OutOfStock", "/p/1?variant=b"), (11, "InStock", None)), ("json-ld", 12.0, "USD", None, 10.0, 12.0, "out_of_stock")),
    # The only offer of the page's address; slash, query and fragment don't count.
    (2, offers((10, "InStock", "/p/9"), (12, "OutOfStock", "https://shop.com/p/2/#x")), ("json-ld", 12.0, "USD", None, 10.0, 12.0, "out_of_stock")),
    # Two of that address: the cheapest in stock.
    (3, offers((9, "OutOfStock", "/p/3"), (12, "InStock", "/p/3"), (11, "LimitedAvailability", None)), ("json-ld", 11.0, "USD", None, 9.0, 12.0, "limited")),
    # Nothing in stock: the cheapest.
    (4, offers((9, "OutOfStock", None), (8, "OutOfStock", None)), ("json-ld", 8.0, "USD", None, 8.0, 9.0, "out_of_stock")),
    # Minor units beside the amount; without it they stay.
    (5, '<b data-price="3200">$32.00</b>', ("attributes", 32.0, "USD", None, None, None, "unknown")),
    (6, '<b data-price="3200">now</b>', ("attributes", 3200.0, None, None, None, None, "unknown")),
    (7, '<b data-price="3200">$31.00</b>', ("attributes", 3200.0, "USD", None, None, None, "unknown")),
    # Former prices and other products' don't count as attributes.
    (8, '<i class="was"><b data-price="50">50</b></i><div class="upsell"><b data-price="40">40</b></div><b data-price-amount="30" data-currency="EUR">x</b>', ("attributes", 30.0, "EUR", None, None, None, "unknown")),
    # The order of selectors, not of elements; the former price above it and below five times it.
    (9, '<p class="price">$9.00</p><p class="x-current-price">$8.00</p><p class="final-price">$7.00</p><del>$99.00</del><del>$11.00</del>', ("selectors", 7.0, "USD", 11.0, None, None, "unknown")),
    # Without a currency an amount needs its cents; struck-out parts of an element don't count.
    (10, '<p class="price">item 12</p><p class="price"><s>20.00</s> 15.00</p>', ("selectors", 15.0, None, 20.0, None, None, "unknown")),
    # Text of frames and of other products is not the page's.
    (11, "<nav>$1.00</nav><main><aside class='related'>$2.00</aside><p>only $3.00</p></main>", ("visible-text", 3.0, "USD", None, None, None, "unknown")),
    # A sale in meta tags and its regular price.
    (12, '<meta property="product:price:amount" content="20"><meta property="product:sale_price:amount" content="15"><meta property="product:price:currency" content="EUR">', ("meta", 15.0, "EUR", 20.0, None, None, "unknown")),
    # The first product that has a price; a list price is the former one.
    (13, _LD.format('[{"@type": "Product", "offers": {"price": ""}}, {"@type": "Product", "offers": {"price": 5, "priceSpecification": [{"priceType": "https://schema.org/ListPrice", "price": 9, "priceCurrency": "USD"}]}}]'), ("json-ld", 5.0, "USD", 9.0, None, None, "unknown")),
    (14, "<p>nothing to buy</p>", (None,) * 6 + ("unknown",)),
    (15, "<div><p class='price'>$4.00", ("selectors", 4.0, "USD", None, None, None, "unknown")),
]


def test_strategies(spark):
    got = page_prices.read_prices(shown(spark, [(i, h) for i, h, _ in PRICES])).drop("said")
    found = {r["page_id"]: tuple(r)[1:] for r in got.collect()}
    for i, _, want in PRICES:
        strategy, price, currency, original, low, high, stock = want
        if price is None:
            assert found[i][:6] == (None,) * 6
        else:
            assert found[i] == (strategy, price, currency, original, low, high, stock), (i, found[i])


def test_pages_are_read_once(spark):
    plan = page_prices.analyze_pages(shown(spark, HTML))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange") <= 2 and "Join" not in plan


def test_markup(spark):
    markup = spark.createDataFrame(MARKUP, "page_id bigint, html string")
    assert rows_of(pages.faq_questions(markup)) == [(1, 0, "Is it vegan?"), (1, 1, "How much?")]
    assert rows_of(pages.structured_reviews(markup).drop("hash")) == [(2, 1, "Ann", 4.0, "Lovely oil indeed", "2024-01-02"), (2, 2, "Cy", 4.3, "Works well for me", None)]
    assert dict(rows_of(pages.page_availability(markup))) == {1: "unknown", 2: "in_stock", 3: "out_of_stock", 4: "out_of_stock", 5: "unknown"}


def test_widgets(spark):
    got = pages.page_reviews(spark.createDataFrame(WIDGET_PAGES, "page_id bigint, html string")).drop("hash")
    want = [
        (1, 1, "Sara", 4.0, "Gentle and light on the hair.", "2024-03-01"),
        (2, 1, "Nora", 5.0, "Best cream that I have tried.", None),
        (2, 2, "Huda", 3.0, "Average results, nothing special.", None),
        (3, 1, None, 2.0, "Two stars for this one", None),
        (4, 1, None, None, "The very same words", None),
    ]
    assert rows_of(got) == sorted(want, key=repr)


def test_many_reviews_on_a_page():
    """Elements are ranges: a page of 20,000 reviews is read in a pass, not by searching all elements for each."""
    import time

    html = "<ul>" + "".join(f'<li class="jdgm-rev"><b class="jdgm-rev__author">A{i}</b><p class="jdgm-rev__body">Body of number {i}</p></li>' for i in range(20_000)) + "</ul>"
    began = time.time()
    found = pages.review_blocks(html)
    assert len(found) == 20_000 and found[-1]["body"] == "Body of number 19999" and time.time() - began < 30


def test_buy_box(spark):
    rows = spark.createDataFrame(BOXES, "page_id bigint, url string, cart boolean, stock string, box string")
    button = F.when(F.col("cart"), '<input id="add-to-cart-button">').otherwise("")
    html = F.concat(F.lit("<main><p>Other sellers from AED 30.00</p></main><div id='availability'>"), "stock", F.lit("</div>"), button, F.lit('<div id="corePrice_feature_div"><span class="a-offscreen">'), "box", F.lit("</span></div>"))
    made = pages.snapshots(rows.select("page_id", "url", html.alias("html")))
    got = pages.buy_box(page_prices.analyze_pages(made), made).select("page_id", "price", "currency", "availability")
    assert rows_of(got) == [(1, 19.5, "AED", "in_stock"), (2, 0.0, "AED", "out_of_stock"), (3, 30.0, "AED", "out_of_stock"), (4, 30.0, "AED", "in_stock")]


def test_robots(spark):
    rules = pages.robots_rules(spark.createDataFrame(ROBOTS, "origin string, content string"), "PriceBot/1.0")
    got = pages.robots_verdicts(spark.createDataFrame([t[:2] for t in TARGETS], "url_id bigint, url string"), rules)
    assert dict(rows_of(got)) == {t[0]: t[2] for t in TARGETS}


def planned(spark):
    return imports.plan_sheet(spark.createDataFrame(STORES, "store_key string, name string, is_own_store boolean, listed int"), spark.createDataFrame(CELLS, _CELLS))


def test_sheets(spark):
    want = [
        (1, "a", True, 0, "SOURCE", "https://own.com/1", "own.com", 500.0, "unknown"),
        (1, "b", False, 1, "MISSING_URL", None, None, 350.0, "unknown"),
        (1, "c", False, 2, "SOURCE", "https://www.c.com/1", "c.com", None, "out_of_stock"),
        (2, "a", True, 0, "SOURCE", "https://own.com/2", "own.com", None, "unknown"),
        (2, "b", False, 1, "INVALID_URL", "nowhere", None, 20.0, "unknown"),
        (3, "b", False, 1, "SOURCE", "https://b.com/3", "b.com", None, "unknown"),
    ]
    assert rows_of(planned(spark)) == sorted(want, key=repr)
    known = spark.createDataFrame([(1, "https://own.com/1")], "row_id bigint, url string")
    got = imports.new_sources(planned(spark), known).select("row_id", "url", "scraping_status", "observed_price")
    assert rows_of(got) == [(1, "https://www.c.com/1", "success", 0.0), (2, "https://own.com/2", "pending", None), (3, "https://b.com/3", "pending", None)]
    stores = spark.createDataFrame([("a", True), ("b", True)], "store_key string, is_own_store boolean")
    rows = spark.createDataFrame([(1, "Oil"), (2, " oil "), (3, "Gel")], "row_id bigint, name string")
    errors = imports.sheet_errors(stores, rows, spark.createDataFrame([(1, "a"), (2, "z"), (3, "z")], "row_id bigint, store_key string"))
    assert rows_of(errors) == [("DUPLICATE_NAME", "oil"), ("OWN_STORES", "2"), ("UNKNOWN_STORE", "z")]


def test_reports(spark):
    logs = spark.createDataFrame(LOGS, "log_id bigint, audience string, created_at string, results array<struct<email: string, status: string>>, kpis map<string, double>").withColumn("created_at", F.col("created_at").cast("timestamp"))
    values = spark.createDataFrame(FIGURES, "kpi string, value double")
    got = reports.key_figures(values, reports.previous_snapshot(logs, "ceo"), "ceo")
    assert rows_of(got) == [("compared", 1, 14.0, 2.0), ("newAlerts", 6, 2.0, None), ("overpriced", 2, 4.0, -1.0), ("underpriced", 3, 3.0, None)]
    assert [tuple(r) for r in reports.report_history(logs).collect()] == [(4, "sales", 2, 0), (3, "ceo", 0, 1), (2, "ceo", 1, 1), (1, "ceo", 1, 0)]
    people = spark.createDataFrame([(1, "A@x.com", "ceo", True), (2, "b@x.com", "sales", True), (3, "c@x.com", "sales", False), (4, "d@x.com", "marketing", True)], "recipient_id bigint, email string, team string, is_active boolean")
    wanted = spark.createDataFrame([(1, "auto"), (1, "auto"), (2, None), (3, "auto"), (4, "all"), (9, "auto")], "recipient_id bigint, audience string")
    assert dict(rows_of(reports.group_recipients(people, wanted))) == {"ceo": "a@x.com", "sales": "b@x.com", "all": "d@x.com", "rejected": "9,c@x.com"}


def test_recipients(spark):
    people = spark.createDataFrame([("a@x.com", "Ann", "ceo", True), ("b@x.com", "Bob", "sales", False)], "email string, name string, team string, is_active boolean")
    incoming = spark.createDataFrame([("b@x.com", "Robert", "sales", True), ("c@x.com", "Cy", "marketing", True)], "email string, name string, team string, is_active boolean")
    assert rows_of(upsert(people, incoming, "email", ["name", "team"], ["is_active"])) == [("a@x.com", "Ann", "ceo", True), ("b@x.com", "Bob", "sales", True), ("c@x.com", "Cy", "marketing", True)]


def test_links_and_brands(spark):
    assert rows_of(link_errors(spark.createDataFrame(LINKS, "product_id bigint, is_own boolean, url string"))) == [(1, "DUPLICATE"), (2, "OWN_URL"), (3, "COMPETITORS")]
    listed = "name string, slug string, official_domain string, place int"
    products = spark.createDataFrame([(1, " acme labs"), (2, "ACME"), (3, "Nordic "), (4, " Unknown "), (5, None), (6, "acme-2"), (7, "")], "product_id bigint, brand string")
    assert dict(rows_of(canonical_brands(products, spark.createDataFrame(BRANDS, listed)))) == {1: "Acme Labs", 2: "Acme Labs", 3: "Nordic", 4: "Unknown", 5: None, 6: "ACME LABS", 7: None}
    stores = spark.createDataFrame([(1, "The Nordic store", "shop.com", True), (2, "X", "acme.com", True), (3, "Nordic", "n.com", False), (4, "Acme Labs outlet", "y.com", True)], "retailer_id bigint, retailer_name string, domain string, is_brand_store boolean")
    assert rows_of(official_stores(stores, spark.createDataFrame(BRANDS[:2], listed))) == [("Acme Labs", 2), ("Acme Labs", 4), ("Nordic", 1)]


def test_demo_catalog(spark):
    rows = alerts.with_previous(demo.catalog(spark).withColumn("is_own_store", F.col("retailer_id") == 0))
    assert alerts.price_changes(rows).count() > 0 and alerts.stock_outs(rows).count() >= 0


def test_money(spark):
    cases = [(1234.5, "USD", "$1,234.50"), (-1234.565, "USD", "-$1,234.57"), (0.005, "EUR", "EUR 0.01"), (1e6, None, "1000000.00"), (-0.5, "AED", "-AED 0.50"), (None, "USD", None)]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], "id int, a double, c string")
    assert dict(rows_of(df.select("id", money_text(F.col("a"), F.col("c"))))) == {i: want for i, (_, _, want) in enumerate(cases)}


def test_sections_without_a_loader(spark, sf_dir):
    assert {s for sections in slices.SECTIONS.values() for s in sections} == set(report.LOADERS)
    with pytest.raises(ValueError, match="weather"):
        report.assemble(report.Tables(spark, sf_dir), {"ceo": ["decisions", "weather"]})
