"""The price of a product page: strategies in order, the sale that is shown, currency, stock and warnings. Pages are read once.

One pass over a page's outline in Python gives raw texts: offers, attributes, elements with the class of a price, sales, struck-out
prices. They become rows, so that the long parsing expressions stand in the plan once and run as compiled code; a page's rows meet
again by its id, as parsed numbers and codes without markup: one exchange of slim rows, and nothing is joined.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions import web
from pricescope.operators.outline import STRUCK, Element, Outline
from pricescope.operators.pages import FOREIGN, FORMER, availability_of, currency_sources, products_of, sale_texts, scripts_of

#: The selectors of a page's price and of its former price, in order: a class, a part of classes (*) or a part of the id (#).
CURRENT = ".sale-price .current-price .product-price .price-sale .special-price .price--current .price-current .price-now .now-price .offer-price .final-price *sale-price *current-price *product-price #product-price #current-price .price *price #price".split()
ORIGINAL = ".regular-price .old-price .was-price .compare-at-price .price--compare .original-price *old-price *was-price *compare *regular-price *original-price del s".split()
#: Attributes that hold a price, and how many elements each way looks at.
ATTRIBUTES = "data-price data-product-price data-price-amount data-sale-price data-current-price data-price-value data-final-price".split()
ATTRIBUTE_ELEMENTS, SELECTOR_ELEMENTS, ORIGINAL_ELEMENTS = 20, 30, 10
MAIN = {"tag": {"main"}, "role": {"main"}, "id": {"main", "content"}, "class": {"product"}}
FRAME = {"header", "footer", "nav", *STRUCK}

#: What one raw text of a page says: the way it was found, its order on the page, a group (product or sale), texts to parse, and marks.
RAW = "struct<kind: string, place: int, part: int, price: string, beside: string, former: string, shown: string, currency: string, availability: string, mark: string>"
_FIELDS = re.findall(r"(\w+): (\w+)", RAW)
_RAW = pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in _FIELDS])


def fits(e: Element, selector: str) -> bool:
    name = selector[1:]
    if selector[0] == ".":
        return name in e.names
    return name in e.classes if selector[0] == "*" else name in e.id if selector[0] == "#" else e.tag == selector


def same_page(address: str, page: str) -> str | None:
    """An address as seen from a page, without query, fragment and closing slash."""
    try:
        return re.sub(r"/$", "", re.sub(r"[?#].*$", "", urljoin(page, address)))
    except ValueError:
        return None


def variant_of(address: str, page: str) -> str | None:
    try:
        return next(iter(parse_qs(urlsplit(urljoin(page, address)).query).get("variant", [])), None)
    except ValueError:
        return None


def _hint(e: Element) -> str:
    return f"{e.classes} {e.id}"


def offer_texts(scripts: list[str], url: str) -> list[dict]:
    """The offers of structured data. ``mark`` tells those of the page's variant (v) and address (a)."""
    found, wanted = [], variant_of(url, url) if url else None
    for n, script in enumerate(scripts):
        for o in products_of(script):
            variant = bool(wanted and o["url"] and variant_of(o["url"], url) == wanted)
            address = bool(url and o["url"] and same_page(o["url"], url) == same_page(url, url))
            row = {"kind": "json-ld", "part": n * 1000 + o["product"], "price": o["price"], "beside": o["list_price"], "former": o["former"], "shown": o["low"], "currency": o["currency"], "availability": o["availability"]}
            found.append(row | {"mark": "v" * variant + "a" * address})
    return found


def price_texts(page: Outline) -> list[dict]:
    """Attributes and elements that look like the price, then struck-out prices. Other products' and former prices are left out."""
    elements = page.elements
    foreign = page.marked(lambda e: FOREIGN.search(e.hint))
    struck = page.marked(lambda e: e.tag in STRUCK)
    former = [bool(FORMER.search(_hint(e))) for e in elements]
    outer = lambda i: elements[i].parent >= 0 and foreign[elements[i].parent]

    def is_former(i: int) -> bool:
        parent = elements[i].parent
        return struck[i] or former[i] or (parent >= 0 and (former[parent] or (elements[parent].parent >= 0 and former[elements[parent].parent])))

    found = []
    for name in ATTRIBUTES:
        for i in [i for i, e in enumerate(elements) if name in e.given][:ATTRIBUTE_ELEMENTS]:
            if not outer(i) and not is_former(i):
                given = elements[i].given
                found.append({"kind": "attributes", "price": given[name], "shown": page.text(i), "currency": given.get("data-currency", given.get("data-price-currency"))})
    # Which selectors an element fits, as bits: one look at each element for all of them.
    masks = [sum(1 << k for k, s in enumerate(CURRENT) if fits(e, s)) for e in elements]
    seen: set[int] = set()
    for k in range(len(CURRENT)):
        for i in [i for i, mask in enumerate(masks) if mask >> k & 1][:SELECTOR_ELEMENTS]:
            if i in seen or elements[i].tag in ("script", "style", "meta", "link", "input"):
                continue
            seen.add(i)
            if outer(i) or is_former(i):
                continue
            text = page.text(i, [j for j in page.inside(i) if elements[j].tag in STRUCK or former[j]])
            if 0 < len(text) <= 60:
                found.append({"kind": "selectors", "price": text, "shown": text})
    for s in ORIGINAL:
        for i in [i for i, e in enumerate(elements) if fits(e, s)][:ORIGINAL_ELEMENTS]:
            text = page.text(i)
            if not outer(i) and 0 < len(text) <= 40:
                found.append({"kind": "original", "price": text})
    return found


def main_text(page: Outline) -> str:
    """The text of the page's main part, without frames, struck-out prices and other products."""
    elements = page.elements
    is_main = lambda e: e.tag in MAIN["tag"] or e.given.get("role") in MAIN["role"] or e.id in MAIN["id"] or MAIN["class"] & e.names
    root = next((i for i, e in enumerate(elements) if is_main(e)), None)
    root = root if root is not None else next((i for i, e in enumerate(elements) if e.tag == "body"), None)
    inside = page.inside(root) if root is not None else range(len(elements))
    left_out = [i for i in inside if elements[i].tag in FRAME or elements[i].tag in ("head", "title") or FOREIGN.search(_hint(elements[i]))]
    return page.text(root, left_out, between=" ")


def raw_texts(html: str | None, scripts: list[str] | None, url: str | None) -> tuple[list[dict], str]:
    page = Outline(html or "")
    rows = offer_texts(scripts or [], url or "") + price_texts(page)
    for n, sale in enumerate(sale_texts(page)):
        rows.append({"kind": "sale", "part": n, "price": sale["text"], "shown": sale["text"], "mark": "explicit" if sale["explicit"] else ""})
        rows += [{"kind": "struck", "part": n, "price": s} for s in sale["struck"]]
    return [row | {"place": i} for i, row in enumerate(rows)], main_text(page)


def _read(html: Column, scripts: Column, url: Column) -> Column:
    """(rows, text): a page's raw texts and the text of its main part."""

    @F.arrow_udf(f"struct<rows: array<{RAW}>, text: string>")
    def read(pages: pa.Array, found: pa.Array, urls: pa.Array) -> pa.Array:
        out = [raw_texts(h, s, u) for h, s, u in zip(pages.to_pylist(), found.to_pylist(), urls.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in out], pa.list_(_RAW)), pa.array([t for _, t in out], pa.string())], ["rows", "text"])

    return read(html, scripts, url)


def _attribute(tag: str, name: str) -> Column:
    return F.regexp_extract("html", rf"(?is)<{tag}[^>]*{name}", 1)


def _raw(kind: str, **values: Column) -> Column:
    """A row of raw texts made of expressions."""
    given = {"kind": F.lit(kind), **values}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS])


def _rows(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda x, i: _raw(kind, place=i, price=x, shown=x))


def _gathered(pages: DataFrame, said: dict[str, Column]) -> DataFrame:
    """(page_id, c): ``c`` has the parsed rows of each page by kind and place; that of kind ``page`` holds ``said``."""
    meta = lambda name: F.nullif(F.coalesce(*[F.nullif(_attribute("meta", rf"""{by}=["']{name}["'][^>]*content=["']([^"']+)["']"""), F.lit("")) for by in ("property", "name")]), F.lit(""))
    item = lambda name: _attribute("[a-z]+", rf"""itemprop=["']{name}["'][^>]*content=["']([^"']+)["']""")
    sale, regular = meta("product:sale_price:amount"), F.coalesce(meta("product:price:amount"), meta("og:price:amount"))
    code = F.coalesce(meta("product:sale_price:currency"), meta("product:price:currency"), meta("og:price:currency"))
    told = F.to_json(F.struct(*[c.alias(n) for n, c in said.items()])) if said else F.lit(None).cast("string")
    read = _held(pages.select("page_id", told.alias("said"), "html", "visible_text", "final_url"), r=_read(F.col("html"), scripts_of("html"), F.col("final_url")))
    raw = read.select(
        "page_id",
        F.concat(
            F.array(
                _raw("page", mark=F.col("said")),
                _raw("microdata", price=item("price"), currency=item("priceCurrency"), shown=item("price")),
                _raw("meta", price=F.coalesce(sale, regular), former=F.coalesce(meta("product:original_price:amount"), F.when(sale.isNotNull(), regular)), currency=code),
            ),
            F.transform(F.array(*currency_sources()), lambda x, i: _raw("currency", place=i, currency=x)),
            _rows("visible-text", F.regexp_extract_all(F.coalesce("r.text", F.lit("")), F.lit(web.tagged_amount()), F.lit(0))),
            _rows("tag", F.regexp_extract_all(F.coalesce("visible_text", F.lit("")), F.lit(web.tagged_amount()), F.lit(0))),
            "r.rows",
        ).alias("raw"),
    )
    # Ways that found nothing go before anything is parsed.
    rows = raw.select("page_id", F.inline("raw")).where((F.col("kind") == "page") | (F.coalesce("price", F.lit("")) != "") | (F.coalesce("currency", F.lit("")) != ""))
    parsed = rows.select(
        "page_id",
        F.struct(
            "kind",
            "place",
            "part",
            web.parse_amount(F.col("price")).alias("amount"),
            web.parse_amount(F.col("beside")).alias("beside"),
            web.parse_amount(F.col("former")).alias("former"),
            F.when(F.col("kind").isin("attributes", "json-ld"), web.parse_amount(F.col("shown"))).alias("shown"),
            web.normalize_currency(F.col("currency")).alias("code"),
            web.detect_currency(F.col("shown")).alias("seen"),
            web.normalize_availability(F.col("availability")).alias("availability"),
            F.coalesce(F.col("price").rlike(r"\d[.,]\d{2}(?![0-9A-Za-z_])"), F.lit(False)).alias("has_cents"),
            "mark",
        ).alias("c"),
    )
    return parsed.groupBy("page_id").agg(F.sort_array(F.collect_list("c")).alias("c"))


def _of(kind: str) -> Column:
    return F.filter("c", lambda x: x["kind"] == kind)


def _first(rows: Column) -> Column:
    return F.get(rows, F.lit(0))


def _candidate(strategy: str, x: Column, price: Column, currency: Column, former: Column | None = None, low: Column | None = None, high: Column | None = None, availability: Column | None = None) -> Column:
    none = F.lit(None)
    fields = {"price": price, "currency": currency, "original": F.when(former > price, former) if former is not None else none, "low": none if low is None else low, "high": none if high is None else high}
    made = F.struct(F.lit(strategy).alias("strategy"), *[v.cast("string" if n == "currency" else "double").alias(n) for n, v in fields.items()], (F.lit("unknown") if availability is None else availability).alias("availability"))
    return F.when(x.isNotNull() & (price > 0), made)


def choose_offer(offers: Column) -> Column:
    """Of a product's priced offers: the one of the page's variant, else the only one of the page's address, else the cheapest in stock, else the cheapest."""
    variants, addressed = F.filter(offers, lambda x: x["mark"].contains("v")), F.filter(offers, lambda x: x["mark"].contains("a"))
    stocked = F.filter(offers, lambda x: x["availability"].isin("in_stock", "limited"))
    pool = F.when(F.size(stocked) > 0, stocked).otherwise(offers)
    cheapest = F.array_min(F.transform(pool, lambda x: F.struct(x["amount"].alias("amount"), x["place"].alias("place"), x.alias("x"))))["x"]
    return F.coalesce(_first(variants), F.when(F.size(addressed) == 1, _first(addressed)), cheapest)


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, which later expressions refer to: they are computed once, not copied into each of these."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _picked(rows: DataFrame) -> DataFrame:
    """For each way to find a price, the row that it goes by."""
    with_price = lambda kind: F.filter("c", lambda x: (x["kind"] == kind) & x["amount"].isNotNull())
    rows = _held(rows, priced=with_price("json-ld"), data=_of("json-ld"))
    rows = _held(rows, product=F.array_min(F.transform("priced", lambda x: x["part"])))
    rows = _held(rows, offers=F.filter("data", lambda x: x["part"] == F.col("product")), candidates=F.filter("priced", lambda x: x["part"] == F.col("product")))
    has_money = lambda x: (x["kind"] == "selectors") & x["amount"].isNotNull() & (x["seen"].isNotNull() | x["has_cents"])
    return _held(
        rows,
        best=choose_offer(F.col("candidates")),
        low=F.array_min(F.transform("offers", lambda x: F.coalesce(x["shown"], x["amount"]))),
        high=F.array_max(F.transform("offers", lambda x: F.coalesce(x["beside"], x["amount"]))),
        code=_first(F.filter("offers", lambda x: x["code"].isNotNull()))["code"],
        microdata=_first(with_price("microdata")),
        meta=_first(with_price("meta")),
        attribute=_first(with_price("attributes")),
        selector=_first(F.filter("c", has_money)),
        text=_first(with_price("visible-text")),
        sale=_first(with_price("sale")),
        page_currency=page_currency(),
        told=F.from_json(_first(_of("page"))["mark"], "map<string, string>"),
    )


def _strategies() -> list[Column]:
    """The candidates of all strategies, in the order in which they are tried."""
    best, micro, meta, attribute, chosen, seen = (F.col(n) for n in ("best", "microdata", "meta", "attribute", "selector", "text"))
    ranged = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    minor = F.coalesce((attribute["amount"] == F.floor(attribute["amount"])) & (F.abs(attribute["amount"] / 100 - attribute["shown"]) < 0.005), F.lit(False))
    original = _first(F.filter("c", lambda x: (x["kind"] == "original") & (x["amount"] > F.col("selector.amount")) & (x["amount"] < F.col("selector.amount") * 5)))["amount"]
    return [
        _candidate("json-ld", best, best["amount"], F.coalesce(best["code"], F.col("code")), best["former"], F.when(ranged, F.col("low")), F.when(ranged, F.col("high")), best["availability"]),
        _candidate("microdata", micro, micro["amount"], F.coalesce(micro["code"], micro["seen"])),
        _candidate("meta", meta, meta["amount"], meta["code"], meta["former"]),
        _candidate("attributes", attribute, F.when(minor, attribute["shown"]).otherwise(attribute["amount"]), F.coalesce(attribute["code"], F.when(attribute["shown"].isNotNull(), attribute["seen"]))),
        _candidate("selectors", chosen, chosen["amount"], chosen["seen"], original),
        _candidate("visible-text", seen, seen["amount"], seen["seen"]),
    ]


def page_currency() -> Column:
    """A page's currency: what it says in markup, or else the most frequent beside amounts; of those as frequent, the one seen first."""
    explicit = _first(F.filter(_of("currency"), lambda x: x["code"].isNotNull()))["code"]
    codes = F.filter(F.transform(_of("tag"), lambda x: x["seen"]), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(codes), lambda x: F.struct(F.size(F.filter(codes, lambda y: y == x)).alias("n"), (-F.array_position(codes, x)).alias("first"), x.alias("code")))
    return F.coalesce(explicit, F.array_max(counted)["code"])


def read_prices(shown: DataFrame, said: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, said, strategy, price, currency, original_price, low_price, high_price, availability) of every snapshot; without a price, null.

    ``said`` are facts of a page that come along as text. A price is held against the sale that the page shows: where the price is
    the former one, the sale takes its place; beside a sale, the former price is added.
    """
    held = _picked(_gathered(shown, {"availability": availability_of(F.col("visible_text")), **(said or {})}))
    beside = F.filter("c", lambda x: (x["kind"] == "struck") & (x["part"] == F.col("sale.part")) & (x["amount"] > F.col("sale.amount")) & (x["amount"] < F.col("sale.amount") * 5))
    states = F.filter(F.transform("data", lambda x: x["availability"]), lambda x: x != "unknown")
    held = _held(held, p=F.coalesce(*_strategies()), compare_at=_first(beside)["amount"], states=states)
    price, sale, former = F.col("p.price"), F.col("sale.amount"), F.col("compare_at")
    same = lambda a, b: F.coalesce(F.abs(a - b) < 0.02, F.lit(False))
    lower = F.coalesce((sale < price) & (same(former, price) | (former.isNull() & (F.col("sale.mark") == "explicit"))), F.lit(False))
    add = same(sale, price) & F.coalesce(former > price, F.lit(False)) & (F.col("p.original").isNull() | (former > F.col("p.original")))
    in_data = F.when(F.exists("states", lambda x: x.isin("in_stock", "limited")), "in_stock").otherwise(_first(F.col("states")))
    original = F.when(lower & (F.coalesce(former, price) > sale), F.coalesce(former, price)).when(add, former).otherwise(F.col("p.original"))
    priced = F.col("p").isNotNull()
    return held.select(
        "page_id",
        F.col("told").alias("said"),
        "p.strategy",
        F.when(lower, sale).otherwise(price).alias("price"),
        F.when(priced, F.coalesce("p.currency", F.when(lower, F.col("sale.seen")), "page_currency")).alias("currency"),
        original.alias("original_price"),
        F.col("p.low").alias("low_price"),
        F.col("p.high").alias("high_price"),
        F.when(priced, F.coalesce(F.nullif("p.availability", F.lit("unknown")), in_data, F.try_element_at("told", F.lit("availability")), F.lit("unknown"))).alias("availability"),
    )


def page_currencies(shown: DataFrame) -> DataFrame:
    """(page_id, currency) of the pages that tell one."""
    return _gathered(shown, {}).select("page_id", page_currency().alias("currency")).where("currency IS NOT NULL")


def page_prices(shown: DataFrame) -> DataFrame:
    """(page_id, strategy, price, currency) of the pages with a price."""
    return read_prices(shown).where("price IS NOT NULL").select("page_id", "strategy", "price", "currency")


def analyze_pages(shown: DataFrame) -> DataFrame:
    """One row for each snapshot: why it can't be used, or else price, currency, former price, range, availability, strategy and warnings."""
    problem = web.page_problem(F.col("http_status"), F.col("title"), F.col("visible_text"), F.col("html"))
    judged = _held(shown, problem=problem)
    # A page that can't be used is read as empty.
    usable = judged.withColumns({c: F.when(F.col("problem").isNull(), F.col(c)) for c in ("html", "visible_text")})
    told = F.col("said")
    facts = read_prices(usable, {"problem": F.col("problem"), "gone": F.when(F.col("title").rlike(web.NOT_FOUND_TITLE), "yes")})
    warnings = F.concat_ws(",", F.when(F.col("currency").isNull(), "CURRENCY_NOT_FOUND"), F.when(F.col("availability") == "unknown", "AVAILABILITY_UNKNOWN"), F.when(F.col("low_price").isNotNull(), "PRICE_RANGE"))
    gone = F.when(told["gone"].isNotNull(), "UNAVAILABLE").otherwise("PRICE_NOT_FOUND")
    return facts.select(
        "page_id",
        F.coalesce(told["problem"], F.when(F.col("price").isNull(), gone)).alias("problem"),
        "price",
        "currency",
        "original_price",
        "low_price",
        "high_price",
        "availability",
        "strategy",
        F.when(F.col("price").isNotNull(), warnings).alias("warnings"),
    )
