"""What product pages say: structured products, prices, copy and access rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.functions import web
from pricescope.operators.outline import STRUCK, Element, Outline

OFFER = "struct<name: string, brand: string, sku: string, image: string, price: string, currency: string, availability: string, list_price: string, rating: double, rating_count: double, product: int, url: string, low: string, former: string>"
OFFER_FIELDS = [(n, pa.float64() if n.startswith("rating") else pa.int32() if n == "product" else pa.string()) for n in re.findall(r"(\w+): ", OFFER)]
_KEYS = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "item", "hasVariant", "offers", "isVariantOf")
_COMMENTS = re.compile(r"/\*.*?\*/|<!--|-->|//<!\[CDATA\[|//\]\]>|<!\[CDATA\[|\]\]>", re.S)
_TRAILING = re.compile(r",\s*([}\]])")


def _nodes(value, depth: int = 0) -> Iterator[dict]:
    if depth > 12:
        return
    if isinstance(value, list):
        for x in value:
            yield from _nodes(x, depth + 1)
    elif isinstance(value, dict):
        yield value
        for key in _KEYS:
            if key in value:
                yield from _nodes(value[key], depth + 1)


def _first(value):
    return _first(value[0]) if isinstance(value, list) and value else value


def _text(value) -> str | None:
    value = _first(value)
    value = value.get("name") if isinstance(value, dict) else value
    return None if value in (None, "", []) else str(value)


def _image(value) -> str | None:
    value = _first(value)
    return _text(value.get("url") or value.get("contentUrl")) if isinstance(value, dict) else _text(value)


def products_of(script: str) -> list[dict]:
    """The products of one JSON-LD script, with their offers; comments and trailing commas are forgiven."""
    found, n_products = [], 0
    for node in _nodes(_loose(script)):
        kinds = node.get("@type")
        if not any(str(k).lower() in ("product", "productgroup", "individualproduct", "productmodel") for k in (kinds if isinstance(kinds, list) else [kinds])):
            continue
        offers = node.get("offers")
        rating = _first(node.get("aggregateRating")) or {}
        n_products += 1
        for offer in [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)] or [{}]:
            specs = offer.get("priceSpecification")
            specs = [x for x in (specs if isinstance(specs, list) else [specs]) if isinstance(x, dict)]
            listed = [x for x in specs if re.search("ListPrice|StrikethroughPrice|MSRP", str(x.get("priceType", "")), re.I)]
            spec = next((x for x in specs if x not in listed), {})
            number = lambda x: float(x) if re.fullmatch(r"\d+(\.\d+)?", str(x)) else None
            found.append(
                {
                    "name": _text(node.get("name")),
                    "brand": _text(node.get("brand")),
                    "sku": _text(node.get("sku")),
                    "image": _image(node.get("image")),
                    "price": _text(offer.get("price", spec.get("price"))) or _text(offer.get("lowPrice")),
                    "currency": _text(offer.get("priceCurrency")) or next((c for x in specs if (c := _text(x.get("priceCurrency")))), None),
                    "availability": _text(offer.get("availability")),
                    "list_price": _text(offer.get("highPrice")),
                    "rating": number(rating.get("ratingValue")) if isinstance(rating, dict) else None,
                    "rating_count": number(rating.get("reviewCount", rating.get("ratingCount"))) if isinstance(rating, dict) else None,
                    "product": n_products,
                    "url": offer["url"] if isinstance(offer.get("url"), str) else None,
                    "low": _text(offer.get("lowPrice")),
                    "former": next((t for x in reversed(listed) if (t := _text(x.get("price")))), None),
                }
            )
    return found


def scripts_of(html: str = "html") -> Column:
    """The texts of a page's JSON-LD scripts."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def _loose(script: str):
    try:
        return json.loads(_TRAILING.sub(r"\1", _COMMENTS.sub("", script)).strip())
    except ValueError:
        return None


def _of_type(value, kinds: set[str], depth: int = 0) -> Iterator[dict]:
    """Every node of a kind, however deep below keys of any name (12 levels)."""
    if depth <= 12 and isinstance(value, list):
        for x in value:
            yield from _of_type(x, kinds, depth + 1)
    elif depth <= 12 and isinstance(value, dict):
        own = value.get("@type")
        if kinds & {str(k) for k in (own if isinstance(own, list) else [own])}:
            yield value
        for x in value.values():
            yield from _of_type(x, kinds, depth + 1)


def faq_questions(pages: DataFrame) -> DataFrame:
    """(page_id, place, question) of FAQ markup, each question once, in order."""

    @F.arrow_udf("array<string>")
    def ask(found: pa.Array) -> pa.Array:
        return pa.array([[q for s in row or [] for n in _of_type(_loose(s), {"Question"}) if (q := _text(n.get("name")) or _text(n.get("text")))] for row in found.to_pylist()], pa.list_(pa.string()))

    return pages.where(F.lower("html").contains("ld+json")).select("page_id", F.posexplode(F.array_distinct(ask(scripts_of()))).alias("place", "question"))


def structured_reviews(pages: DataFrame, most: int = 50) -> DataFrame:
    """Reviews of JSON-LD markup: author, rating (of 100 as of 5), text of 8 characters or more, date, hash.

    Equal reviews of a page count once; at most ``most`` of a page are taken, in order.
    """
    shape = "struct<author: string, rating: double, body: string, published: string>"

    @F.arrow_udf(f"array<{shape}>")
    def collect(found: pa.Array) -> pa.Array:
        rows = []
        for row in found.to_pylist():
            out = []
            for n in (n for s in row or [] for n in _of_type(_loose(s), {"Review", "UserReview", "CriticReview"})):
                rating = _first(n.get("reviewRating") or n.get("rating"))
                number = rating.get("ratingValue") if isinstance(rating, dict) else None
                body = next((t for k in ("reviewBody", "description", "text", "name") if (t := _text(n.get(k)))), None)
                out.append({"author": _text(n.get("author")), "rating": float(number) if re.fullmatch(r"\d+(\.\d+)?", str(number)) else None, "body": body, "published": _text(n.get("datePublished")) or _text(n.get("dateCreated"))})
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct([("author", pa.string()), ("rating", pa.float64()), ("body", pa.string()), ("published", pa.string())])))

    found = pages.where(F.lower("html").contains("ld+json")).select("page_id", F.posexplode(collect(scripts_of())).alias("place", "r")).select("page_id", "place", "r.*")
    return _clean_reviews(found, most)


def page_reviews(pages: DataFrame, most: int = 50) -> DataFrame:
    """Reviews of a page: of JSON-LD markup, then of microdata, then of review widgets; equal ones once, at most ``most``."""
    shape = "struct<author: string, rating: double, body: string, published: string>"

    @F.arrow_udf(f"array<{shape}>")
    def blocks(found: pa.Array) -> pa.Array:
        return pa.array([review_blocks(h) if h else [] for h in found.to_pylist()], pa.list_(pa.struct([("author", pa.string()), ("rating", pa.float64()), ("body", pa.string()), ("published", pa.string())])))

    # No filter: it would go beneath, and make pages that are made once more. Outer, so that no list is asked for its size there.
    marked = pages.select("page_id", F.when(F.col("html").rlike(r"(?i)review|commentlist"), F.col("html")).alias("html"))
    found = marked.select("page_id", F.posexplode_outer(blocks("html")).alias("place", "r")).where("place IS NOT NULL").select("page_id", (F.col("place") + 1_000_000).alias("place"), "r.*")
    first = structured_reviews(pages, most).select("page_id", F.col("n").alias("place"), "author", "rating", "body", "published")
    return _clean_reviews(first.unionByName(found), most)


def _clean_reviews(found: DataFrame, most: int) -> DataFrame:
    body = F.substring(F.trim(F.regexp_replace("body", r"\s+", " ")), 1, 1000)
    scaled = F.when((F.col("rating") > 5) & (F.col("rating") <= 100), F.col("rating") / 20).otherwise(F.col("rating"))
    clean = found.withColumn("body", body).where(F.length("body") >= 8).withColumn("rating", F.when(scaled.between(0, 5), F.floor(scaled * 10 + 0.5) / 10))
    digest = F.substring(F.sha2(F.concat(F.coalesce("author", F.lit("")), F.lit("\0"), F.coalesce("published", F.lit("")), F.lit("\0"), F.col("body")), 256), 1, 32)
    once = clean.withColumn("hash", digest).withColumn("copy", F.expr("row_number() OVER (PARTITION BY page_id, hash ORDER BY place)")).where("copy = 1")
    numbered = once.withColumn("n", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY place)")).where(F.col("n") <= most)
    return numbered.select("page_id", "n", "author", "rating", "body", "published", "hash")


def availability_of(text: Column) -> Column:
    """What a page (column html) says of stock: markup first, then meta tags, then its text in English or Arabic."""
    micro = F.regexp_extract("html", r"""(?is)itemprop=["']availability["'][^>]*(?:href|content)=["']([^"']+)["']""", 1)
    meta = F.regexp_extract("html", r"""(?is)property=["'](?:product|og):availability["'][^>]*content=["']([^"']+)["']""", 1)
    seen = F.lower(text)
    # Phrases of shops.
    out = seen.rlike("out of stock|sold out|currently unavailable|غير متوفر|نفدت الكمية")
    stocked = seen.rlike("in stock|add to cart|add to bag|متوفر|أضف إلى السلة")
    named = [F.nullif(web.normalize_availability(x), F.lit("unknown")) for x in (micro, meta)]
    return F.coalesce(*named, F.when(out, "out_of_stock").when(stocked, "in_stock"), F.lit("unknown"))


def page_availability(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", availability_of(visible_text(F.col("html"))).alias("availability"))


def structured_offers(pages: DataFrame) -> DataFrame:
    """(page_id, place, offer fields) of every JSON-LD product; the graph walk alone runs in Python."""
    @F.arrow_udf(f"array<{OFFER}>")
    def parse(found: pa.Array) -> pa.Array:
        return pa.array([[p for script in row or [] for p in products_of(script)] for row in found.to_pylist()], pa.list_(pa.struct(OFFER_FIELDS)))

    with_scripts = pages.where(F.lower("html").contains("ld+json")).select("page_id", scripts_of().alias("scripts"))
    exploded = with_scripts.select("page_id", F.posexplode(parse("scripts")).alias("place", "o"))
    return exploded.select(
        "page_id",
        "place",
        "o.name",
        "o.brand",
        "o.sku",
        "o.image",
        web.parse_amount(F.col("o.price")).alias("price"),
        web.parse_amount(F.col("o.list_price")).alias("high_price"),
        web.normalize_currency(F.col("o.currency")).alias("currency"),
        web.normalize_availability(F.col("o.availability")).alias("availability"),
        "o.rating",
        F.col("o.rating_count").cast("int").alias("rating_count"),
    )


def currency_sources() -> list[Column]:
    """Where a page (column html) names its currency: meta tags, microdata, attributes."""
    named = lambda name: F.regexp_extract("html", rf"""(?is)<meta(?=[^>]*\sproperty=["']{name}["'])[^>]*\scontent=["']([^"']*)["']""", 1)
    data = lambda name: F.regexp_extract("html", rf"""(?is)<[a-z][^>]*\s{name}=["']([^"']*)["']""", 1)
    item = r"""(?is)(<[a-z][^>]*\sitemprop=["']priceCurrency["'][^>]*>)([^<]*)"""
    content = F.regexp_extract(F.regexp_extract("html", item, 1), r"""(?is)\scontent=["']([^"']*)["']""", 1)
    return [named("product:price:currency"), named("og:price:currency"), F.coalesce(F.nullif(content, F.lit("")), F.regexp_extract("html", item, 2)), data("data-currency"), data("data-price-currency")]


def unescape_html(text: Column) -> Column:
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def inner(tag: str) -> Column:
    """Texts of all elements of a kind, tags removed and white space collapsed, empty ones left out."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    texts = F.transform(found, lambda x: F.trim(F.regexp_replace(unescape_html(F.regexp_replace(x, r"(?s)<[^>]*>", " ")), r"\s+", " ")))
    return F.filter(texts, lambda x: x != "")


def page_copy(pages: DataFrame, bullets: int = 30) -> DataFrame:
    """Title, headings, longest paragraph, bullets (outside navigation), images and language of every page."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    page = pages.select("page_id", F.col("html").alias("__whole"), body.alias("html"))
    paragraphs = F.filter(inner("p"), lambda p: F.length(p).between(40, 15000))
    images = F.regexp_count("html", F.lit(r"(?i)<img\b"))
    with_alt = F.regexp_count("html", F.lit(r"""(?i)<img\b[^>]*\balt=["'][^"']+["']"""))
    title = F.regexp_extract("__whole", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return page.select(
        "page_id",
        F.nullif(F.trim(F.regexp_replace(unescape_html(title), r"\s+", " ")), F.lit("")).alias("title"),
        F.nullif(F.lower(F.regexp_extract("__whole", r"""(?i)<html[^>]*\blang=["']([A-Za-z-]+)""", 1)), F.lit("")).alias("language"),
        inner("h1").alias("h1"),
        inner("h2").alias("h2"),
        F.array_max(F.transform(paragraphs, lambda p: F.struct(F.length(p).alias("n"), p.alias("t"))))["t"].alias("description"),
        F.slice(inner("li"), 1, bullets).alias("bullets"),
        images.alias("images"),
        with_alt.alias("with_alt"),
    )


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, allow, pattern) for an agent: the groups that name it, or else those for all.

    A group is a run of agent lines and the rules below them.
    """
    lines = files.select("origin", F.posexplode(F.split("content", r"\r?\n")).alias("i", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    keyed = lines.where(F.col("line").contains(":")).select("origin", "i", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    is_agent = "(key = 'user-agent')"
    begun = keyed.withColumn("begins", F.expr(f"{is_agent} AND NOT coalesce(lag({is_agent}) OVER (PARTITION BY origin ORDER BY i), false)"))
    grouped = begun.withColumn("group", F.expr("count_if(begins) OVER (PARTITION BY origin ORDER BY i)")).where("group > 0")
    name = F.lower("value")
    agents = grouped.where("key = 'user-agent'").groupBy("origin", "group").agg(
        F.bool_or((name != "*") & F.contains(F.lit(agent.lower()), name)).alias("named"), F.bool_or(name == "*").alias("general")
    )
    chosen = agents.withColumn("any_named", F.expr("bool_or(named) OVER (PARTITION BY origin)")).where("named OR (general AND NOT any_named)")
    rules = grouped.where("key = 'allow' OR (key = 'disallow' AND value <> '')")
    return rules.join(chosen.select("origin", "group"), ["origin", "group"]).select("origin", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_id, allowed): the longest rule that fits decides, allowing ones first; no rule allows. Joined on the origin."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""), "#.*$", "")
    placed = urls.select("url_id", F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1).alias("origin"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    # Only rules with wildcards are patterns; most are prefixes.
    plain = ~F.col("pattern").rlike(r"[*]|\$$")
    fits = placed.join(rules, "origin").where(F.when(plain, F.startswith(F.col("path"), F.col("pattern"))).otherwise(F.regexp_like("path", web.robots_pattern(F.col("pattern")))))
    best = fits.groupBy("url_id").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allow"))
    return placed.join(best, "url_id", "left").select("url_id", F.coalesce("allow", F.lit(True)).alias("allowed"))


#: Elements that hold a page's own price, in the order in which they are read, and hints of those that don't.
MAIN_CLASSES = ["product__block--price", "product-info-price", "productView-price"]
SUMMARIES = {"entry-summary", "summary"}
FOREIGN = re.compile(r"related|recommend|upsell|cross-?sell|similar|recently|also-?bought|bought-?together|(?:^|[\s_-])(?:pbt|fbt)(?:$|[\s_-])|you-?may|(?:^|\s)carousel(?:\s|$)|products?-carousel", re.I)
AUXILIARY = re.compile(r"product-card|card-wrapper|card-product|quick-view|quick-add|compare-drawer|compare-modal|predictive-search|search-modal|menu-drawer", re.I)
FORMER = re.compile(r"old|was|compare|strike|regular|original|before|list|rrp|msrp|crossed", re.I)
#: Marks of reviews and of their parts, by attribute, class or part of a class.
WIDGETS = {"jdgm-rev", "yotpo-review", "okeReviews-review", "loox-review", "stamped-review", "spr-review"}
NAMED = re.compile("customer-review|product-review", re.I)
LISTS = {"woocommerce-Reviews": {"review"}, "commentlist": {"review", "comment"}, "product-reviews": {"review"}, "salla-reviews": {"review"}, "zid-reviews": {"review"}}
BODY = ("reviewBody", {"review-body", "review-content", "review-text", "jdgm-rev__body", "yotpo-review-content", "okeReviews-review-body", "loox-review-content", "comment-text", "woocommerce-review__body"}, r"review[-_]body|review-content")
AUTHOR = ("author", {"review-author", "author", "jdgm-rev__author", "yotpo-user-name", "okeReviews-reviewerName", "comment-author"}, r"reviewer|author")
STARS = ("reviewRating", {"stars", "rating", "jdgm-rev__rating", "yotpo-review-stars"}, r"star")
FULL_STAR = {"on", "active", "jdgm--on", "yotpo-icon-star"}


def sale_texts(page: Outline) -> list[dict]:
    """The sale prices in a page's own price block, in the order in which they count, each with the struck-through texts beside it."""
    elements = page.elements
    foreign = page.marked(lambda e: FOREIGN.search(e.hint) or AUXILIARY.search(e.hint))
    struck_out = page.marked(lambda e: e.tag in STRUCK)
    wrapped = page.marked(lambda e: "product__info-wrapper" in e.names)
    summed = page.marked(lambda e: SUMMARIES & e.names)
    outer = lambda marks, i: elements[i].parent >= 0 and marks[elements[i].parent]

    def main_rank(i: int) -> int | None:
        e = elements[i]
        if outer(foreign, i) or AUXILIARY.search(e.hint):
            return None
        if e.id.startswith("price-") and ("__main" in e.id or outer(wrapped, i)):
            return 0
        if "price" in e.names and outer(summed, i):
            return 1 + MAIN_CLASSES.index("product-info-price")
        return next((1 + n for n, name in enumerate(MAIN_CLASSES) if name in e.names), None)

    found = []
    for _, i in sorted((rank, i) for i in range(len(elements)) if (rank := main_rank(i)) is not None):
        parts = [j for j in page.inside(i) if "--on-sale" in elements[j].classes][:4]
        for w in [*([] if "on-sale" in elements[i].classes else parts), i]:
            struck = [page.text(j) for j in page.inside(w) if elements[j].tag in STRUCK][:6]
            for j in [j for j in page.inside(w) if "price-item--sale" in elements[j].classes or elements[j].tag == "ins"][:8]:
                e, text = elements[j], page.text(j)
                if not outer(struck_out, j) and not FORMER.search(f"{e.classes} {e.id}") and 0 < len(text) <= 60:
                    explicit = "price-item--sale" in e.classes or "on-sale" in elements[w].classes
                    found.append({"text": text, "explicit": explicit, "struck": [s for s in struck if 0 < len(s) <= 40]})
    return found


def _is_part(e: Element, part: tuple[str, set[str], str]) -> bool:
    item, names, pattern = part
    return e.given.get("itemprop") == item or bool(e.names) and (not names.isdisjoint(e.names) or bool(re.search(pattern, e.classes, re.I)))


def _stars(page: Outline, at: int) -> float | None:
    """A rating from an element and those in it: what its label says, its value, or the number of full stars."""
    numbers = [at, *page.inside(at)]
    around = [page.elements[j] for j in numbers]
    label = next((e.given["aria-label"] for e in around if "aria-label" in e.given), "")
    told = re.search(r"(\d+(?:[.,]\d+)?)\s*(?:out of|/|من)\s*5", label, re.I) or re.search(r"(\d+(?:[.,]\d+)?)\s*stars?", label, re.I)
    values = [e.given.get("content") or page.text(j) for j, e in zip(numbers, around, strict=True) if e.given.get("itemprop") == "ratingValue"] + [e.given[k] for e in around for k in ("data-score", "data-rating") if k in e.given]
    for raw in [told.group(1)] if told else values[:1]:
        found = re.match(r"\s*\d+(?:[.,]\d+)?", raw)
        if found:
            return float(found.group().replace(",", "."))
    full = sum(bool(FULL_STAR & e.names) or {"star", "filled"} <= e.names or bool(re.search("star[-_]full", e.classes)) for e in around[1:])
    return float(full) if 0 < full <= 5 else None


def review_blocks(html: str) -> list[dict]:
    """Reviews of microdata, then those of widgets outside headers, footers and navigation."""
    page = Outline(html)
    elements = page.elements
    # Marks are made only of what the page has.
    names = set().union(*[e.names for e in elements])
    framed = page.marked(lambda e: e.tag in ("header", "footer", "nav")) if any(e.tag in ("header", "footer", "nav") for e in elements) else None
    listed_in = {name: page.marked(lambda e, name=name: name in e.names) for name in LISTS if name in names}

    def is_widget(i: int) -> bool:
        e = elements[i]
        if framed and framed[i]:
            return False
        if e.given.get("data-testid") == "review":
            return True
        if not e.names:
            return False
        listed = any(LISTS[name] & e.names and e.parent >= 0 and marks[e.parent] for name, marks in listed_in.items())
        return bool(WIDGETS & e.names) or listed or bool(NAMED.search(e.classes))

    def read(i: int) -> dict:
        inside = page.inside(i)
        first = lambda part: next((j for j in inside if _is_part(elements[j], part)), None)
        body, author, stars = first(BODY), first(AUTHOR), first(STARS)
        stars = stars if stars is not None else next((j for j in inside if "star" in elements[j].given.get("aria-label", "").lower()), None)
        date = next((j for j in inside if elements[j].tag == "time" or elements[j].given.get("itemprop") == "datePublished" or "datetime" in elements[j].given), None)
        rest = [j for j in inside if _is_part(elements[j], AUTHOR) or _is_part(elements[j], STARS) or elements[j].tag == "time"]
        given = elements[date].given if date is not None else {}
        name = page.text(author) if author is not None else None
        return {
            "author": name[:120] if name else None,
            "rating": _stars(page, i if stars is None else stars),
            "body": (page.text(body) if body is not None else None) or page.text(i, rest) or None,
            "published": given.get("datetime") or given.get("content") or ((page.text(date) or None) if date is not None else None),
        }

    micro = [i for i, e in enumerate(elements) if e.given.get("itemprop") == "review"]
    return [read(i) for i in [*micro, *(i for i in range(len(elements)) if is_widget(i))]]


def displayed_sales(pages: DataFrame) -> DataFrame:
    """(page_id, sale_price, sale_currency, compare_at, explicit) of pages whose own price block shows a sale.

    The compare-at price is the first struck-through one above the sale and below five times it. The outline of the page
    alone is made in Python, of pages with the marks of a sale; texts become rows before they are parsed.
    """
    shape = "array<struct<text: string, explicit: boolean, struck: array<string>>>"

    @F.arrow_udf(shape)
    def outline(found: pa.Array) -> pa.Array:
        return pa.array([sale_texts(Outline(h or "")) for h in found.to_pylist()], pa.list_(pa.struct([("text", pa.string()), ("explicit", pa.bool_()), ("struck", pa.list_(pa.string()))])))

    marked = pages.where(F.col("html").rlike("price-item--sale|(?i)<ins[ >]")).select("page_id", F.posexplode(outline("html")).alias("place", "w"))
    sales = marked.select("page_id", "place", "w.explicit", "w.struck", web.parse_amount(F.col("w.text")).alias("sale_price"), web.detect_currency(F.col("w.text")).alias("sale_currency")).where("sale_price IS NOT NULL")
    first = sales.groupBy("page_id").agg(F.min_by(F.struct("sale_price", "sale_currency", "explicit", "struck"), "place").alias("s")).select("page_id", "s.*")
    beside = first.select("page_id", "sale_price", F.posexplode("struck").alias("place", "text")).withColumn("amount", web.parse_amount(F.col("text")))
    former = beside.where("amount > sale_price AND amount < 5 * sale_price").groupBy("page_id").agg(F.min_by("amount", "place").alias("compare_at"))
    return first.drop("struck").join(former, "page_id", "left")


def snapshots(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, and http_status if there is one) as a browser shows them: with title, visible text and final address."""
    status = F.col("http_status") if "http_status" in pages.columns else F.lit(None).cast("int")
    final = F.col("final_url") if "final_url" in pages.columns else F.col("url")
    title = F.trim(F.regexp_replace(unescape_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))
    body = F.regexp_replace("html", r"(?is)<(head|title)\b.*?</\1>", " ")
    return pages.select("page_id", "url", final.alias("final_url"), "html", title.alias("title"), visible_text(body).alias("visible_text"), status.alias("http_status"))


def product_info(shown: DataFrame) -> DataFrame:
    """(page_id, product_name, brand, image_url): markup first, then microdata, meta tags, headings and the title."""
    empty = F.lit("")
    meta = lambda key: F.nullif(F.coalesce(*[F.nullif(F.regexp_extract("html", rf"""(?is)<meta(?=[^>]*\s{by}=["']{key}["'])[^>]*\scontent=["']([^"']*)["']""", 1), empty) for by in ("property", "name")]), empty)
    item = lambda name: F.nullif(F.regexp_extract("html", rf"""(?is)itemprop=["']{name}["'][^>]*\scontent=["']([^"']+)["']""", 1), empty)
    content = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", rf"""(?is)<([a-z0-9]+)[^>]*itemprop=["']{name}["'][^>]*>(.*?)</\1>""", 2), r"(?s)<[^>]*>", " ")), empty)
    offers = structured_offers(shown)
    named = offers.groupBy("page_id").agg(F.min_by(F.struct("name", "brand", "image"), F.struct(F.col("name").isNull(), F.col("place"))).alias("ld"))
    source = F.nullif(F.regexp_extract("html", r"""(?is)itemprop=["']image["'][^>]*\s(?:content|src)=["']([^"']+)["']""", 1), empty)
    page = shown.join(named, "page_id", "left").select(
        "page_id",
        "final_url",
        F.coalesce("ld.name", item("name"), content("name"), meta("og:title"), F.get(inner("h1"), F.lit(0)), F.nullif("title", empty)).alias("product_name"),
        F.coalesce("ld.brand", item("brand"), content("brand"), meta("product:brand"), meta("og:brand")).alias("brand"),
        F.coalesce("ld.image", meta("og:image"), meta("twitter:image"), source).alias("image"),
    )
    origin, folder = F.regexp_extract("final_url", r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract("final_url", r"^([a-z]+://[^?#]*/)", 1)
    absolute = F.when(F.col("image").rlike(r"^[a-z]+://"), F.col("image")).when(F.col("image").startswith("//"), F.concat(F.lit("https:"), "image")).when(F.col("image").startswith("/"), F.concat(origin, "image")).otherwise(F.concat(folder, "image"))
    clean = lambda c, n: F.substring(F.trim(F.regexp_replace(unescape_html(F.col(c)), r"\s+", " ")), 1, n)
    return page.select("page_id", clean("product_name", 300).alias("product_name"), clean("brand", 120).alias("brand"), absolute.alias("image_url"))


def buy_box(analysed: DataFrame, shown: DataFrame) -> DataFrame:
    """Marketplace pages sell at the price of their buy box: without one the product is out of stock, at price 0.

    Which pages are a marketplace's is told by their host; all others stay as they are.
    """
    text = lambda name: F.regexp_extract("html", rf"""(?is)id=["']{name}["'][^>]*>(.*?)</div>""", 1)
    cart = F.col("html").rlike(r"""id=["']add-to-cart-button["']""")
    elsewhere = F.col("html").rlike(r"""id=["'](?:buybox-see-all-buying-choices|aod-ingress-link)["']|(?i)see all buying options""")
    none = r"(?i)currently unavailable|out of stock|غير متوفر"
    gone = text("availability").rlike(none) | (~cart & (elsewhere | text("buybox").rlike(none)))
    core = F.regexp_extract("html", r"""(?is)id=["'](?:corePriceDisplay_desktop_feature_div|corePrice_feature_div)["'].*?class=["'][^"']*a-offscreen[^"']*["'][^>]*>([^<]*)<""", 1)
    boxes = shown.where(F.lower("final_url").rlike(r"^[a-z]+://([^/?#]*\.)?amazon\.")).select("page_id", gone.alias("gone"), F.when(cart & ~gone, web.parse_amount(core)).alias("box_price"))
    joined = analysed.join(boxes, "page_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)) & F.col("problem").isNull())
    only = lambda c: F.when(~F.col("gone"), F.col(c)).alias(c)
    return joined.select(
        "page_id",
        "problem",
        F.when(F.col("gone"), 0.0).otherwise(F.coalesce("box_price", "price")).alias("price"),
        "currency",
        only("original_price"),
        only("low_price"),
        only("high_price"),
        F.when(F.col("gone"), "out_of_stock").when(F.col("box_price").isNotNull(), "in_stock").otherwise(F.col("availability")).alias("availability"),
        "strategy",
        "warnings",
    )
