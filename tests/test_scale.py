"""What must hold for large inputs: whole results, no broadcast of tables as large as the products, long texts made by many tasks."""

import re
from datetime import datetime

from pricescope.functions import lexicon, text
from pricescope.operators import alerts, bundle, content, listing, opportunities, outline, pricing
from pricescope.plans import cases, edges, history, registry, runs
from pricescope.sources import shop_pages, written


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_content_broadcasts_nothing(spark, sf_dir):
    for name in ("t16_similarities", "t15_missing_facts", "t07_g11_keyword_gap", "g15_attribute_coverage"):
        assert not re.search("Join|BroadcastExchange", plan(registry.QUERIES[name](spark, sf_dir))), name
    for name in ("t13_checks", "g19_check_order", "t14_t17_t18_overview"):
        assert "Broadcast" not in plan(registry.QUERIES[name](spark, sf_dir)), name


def test_all_doors(spark):
    """More stores than the overview's list shows; one store lists both brands."""
    listings = [(1, r, "A", "in_stock", 1.0, False) for r in range(30)] + [(2, 0, "B", "in_stock", 1.0, False)]
    shelf = opportunities.build_shelf(
        spark.createDataFrame(listings, "product_id bigint, retailer_id bigint, brand string, state string, price double, official boolean"),
        spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "c", "B")], "product_id bigint, name string, brand string"),
    )
    doors = opportunities.every_door(shelf).collect()
    assert sorted((d["brand"], d["retailer_id"], d["catalog_size"], d["other_brand_listings"]) for d in doors) == [("B", r, 2, 1) for r in range(1, 30)]


def test_texts_are_made_by_many_tasks(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for rows in (shop_pages.product_pages(spark, sf_dir), written.content_pages(spark, sf_dir), written.reviews(spark, sf_dir)):
            assert rows.rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_patterns_begin_with_their_letters(spark):
    """The look at the first letter loses no match; case is folded as patterns fold it."""
    texts = ["VEGAN and 400 ML", "400 mlx", "no sulphates", "Sulfate-free", "non-organıc", "ſulfate free, vıtamin e", "شعر جاف", "خالٍ من السلفات", "scentless", "the SCENT!", "late", "plate", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, _, p in lexicon.ATTRIBUTES:
        pattern = "(?iu)" + text.java_pattern(p)
        found = rows.select(rows.t.rlike(pattern).alias("plain"), text.F.array_contains(text.detect_attributes(rows.t), name).alias("found")).collect()
        assert [r["plain"] for r in found] == [r["found"] for r in found], name
    for name, _, en, ar in lexicon.THEMES:
        pattern = f"(?<![A-Za-z0-9_])(?:{en})(?![A-Za-z0-9_])|{ar}"
        normal = text.normalize_arabic(text.F.lower(rows.t))
        found = rows.select(normal.rlike(pattern).alias("plain"), text.F.array_contains(text.detect_themes(rows.t), name).alias("found")).collect()
        assert [r["plain"] for r in found] == [r["found"] for r in found], name


def test_own_page_is_the_first(spark, sf_dir):
    """A product's own terms are those of its first own page; other own pages and stores' words count for nothing."""
    shape = "product_id bigint, source_id bigint, retailer_name string, url string, is_own_store boolean, title string, meta string, description string, h1 array<string>, h2 array<string>, bullets array<string>, faq array<string>"
    page = lambda s, own, words: (1, s, f"Shop{s}", f"https://shop{s}.example.com", own, words, None, None, [], [], [], [])
    pages = spark.createDataFrame([page(1, True, "keratin keratin shop2 argan"), page(2, True, "biotin biotin"), page(3, False, "argan biotin")], shape)
    found = {(r["term"], r["kind"], r["pages"], r["own"]) for r in content.keyword_gap(pages).collect()}
    assert found == {("argan", "shared", 1, 1), ("biotin", "missing", 1, 0), ("argan biotin", "missing", 1, 0), ("keratin", "unique", 0, 2)}


def test_link_errors_in_one_read(spark):
    """Every rule of every product by aggregation; an address that is null is none of the own ones."""
    links = [(1, True, "https://a.com/"), (1, False, "https://A.com"), (2, True, None), (2, False, None), (3, True, "https://c.com"), (4, False, "https://d.com/1"), (4, False, "https://d.com/1#x")]
    links += [(5, True, "https://e.com")] + [(5, False, f"https://e.com/{i}") for i in range(21)]
    errors = edges.link_errors(spark.createDataFrame(links, "product_id bigint, is_own boolean, url string"))
    assert "Join" not in plan(errors) and "Union" not in plan(errors)
    assert sorted(map(tuple, errors.collect())) == [(1, "OWN_URL"), (3, "COMPETITORS"), (4, "DUPLICATE"), (5, "COMPETITORS")]


def test_places_compute_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(100, numPartitions=4).mapInArrow(look, "id bigint")
    assert [tuple(r) for r in listing.with_place(rows, text.F.col("id").desc()).orderBy("place").limit(2).collect()] == [(99, 1), (98, 2)]
    assert read.value == 100


def test_parts_are_in_every_match(spark):
    """Patterns of facts are looked at only where a text has a part that each match has; optional letters and groups are no such parts."""
    assert text.needles(r"(?:dry|wavy)\s+hair|(?:ab|cd)x?|no sul(?:f|ph)ates?|خال[يٍ]?\s+من") == {"hair", "ab", "cd", "no sul", "خال"}
    assert text.needles(r"\d+(?:[.,]\d+)?\s?(?:ml|g)(?![a-z])") == set()
    assert sum(not text.needles(p) for _, _, p in lexicon.ATTRIBUTES) == 1
    facts = ["all hair types", "dry skin", "خال من سلفات", "خالي  من العطور", "طبيب الجلد", "مختبرة من قبل", "avoid contact with eyes", "12.5 fl. oz", "vitamin c", "country of origin", "واقي الشمس", "no parabens"]
    rows = spark.createDataFrame([(f"xx {f} yy",) for f in facts], "t string")
    assert [bool(r[0]) for r in rows.select(text.F.size(text.detect_attributes(rows.t)) > 0).collect()] == [True] * len(facts)


def test_shelf_is_computed_once(spark, sf_dir):
    """What is made of listings reads them, not the observations that they come from; who owns a store is asked of the sources alone."""
    for name in ("o09_c07_pitches", "o09_first_pitches", "o11_summary", "e10_store_cards"):
        assert "lineitem" not in plan(registry.QUERIES[name](spark, sf_dir)), name
    assert "max_by" not in plan(registry.QUERIES["o02_reference_retailers"](spark, sf_dir))


def test_retailers_hold_no_pairs_in_hash_tables(spark):
    """Products of a store are counted once each, null not at all, without a distinct count's hash tables of pairs."""
    sources = [(1, 7, "failed", 1), (1, 7, "success", 2), (2, 7, "success", 3), (None, 7, "success", 4), (1, 8, "failed", 5)]
    rows = spark.createDataFrame(sources, "product_id bigint, retailer_id bigint, scraping_status string, last_scraped_at bigint")
    stats = listing.retailer_stats(spark.createDataFrame([(7,), (8,), (9,)], "retailer_id bigint"), rows)
    found = sorted((r["retailer_id"], r["product_count"], r["last_scraped_at"], r["failed"], r["succeeded"], r["health"]) for r in stats.collect())
    assert found == [(7, 2, 4, 1, 3, "degraded"), (8, 1, 5, 1, 0, "failing"), (9, 0, None, 0, 0, "idle")]
    assert "distinct" not in plan(stats)


def test_compare_run_reads_observations_once(spark, sf_dir):
    """Sources, checks, newest observations and the analysis are written once; the result reads them and no line of an order."""
    assert "lineitem" not in plan(registry.QUERIES["p15_compare_run"](spark, sf_dir))


def test_words_are_made_once(spark, sf_dir):
    """No filter on the number of a text's words goes beneath, to a task that reads the file and makes all of them once more."""
    assert "Filter (size(regexp_extract_all" not in plan(registry.QUERIES["t06_d13_d14_term_counts"](spark, sf_dir))


def test_top_terms_miss_no_pair(spark):
    """Pairs of frequent words alone are counted; the first terms are those of all, with ties, repeats, empty texts and a null group."""
    texts = [("a", "argan oil argan oil"), ("a", "argan oil of oil argan"), ("a", "zinc argan oil"), ("a", None), ("b", "the 12"), ("b", "rare words alone"), (None, "shea shea shea"), (None, ""), ("", "shea oil")]
    rows = spark.createDataFrame([(g, i, t) for i, (g, t) in enumerate(texts)], "lang string, doc_id int, t string")
    place = text.F.expr("row_number() OVER (PARTITION BY lang ORDER BY documents DESC, occurrences DESC, term)")
    usage = text.term_counts(rows, ["lang", "doc_id"], "t").groupBy("lang", "term").agg(text.F.count("*").alias("documents"), text.F.sum("n").alias("occurrences"))
    for n in (1, 2, 3, 50):
        every = {tuple(r) for r in usage.withColumn("place", place).where(text.F.col("place") <= n).collect()}
        assert {tuple(r) for r in text.top_terms(rows, "lang", "doc_id", "t", n).collect()} == every
    assert {("a", "argan oil", 3, 4, 3), (None, "shea shea", 1, 2, 2), ("b", "rare words", 1, 1, 3)} <= every


def test_store_words_go_before_pairs(spark, sf_dir):
    """A store's word is judged as a word, not by cutting up every pair that was made with it; nothing is broadcast to be compared."""
    gap = plan(registry.QUERIES["t07_g11_keyword_gap"](spark, sf_dir))
    assert "arrays_overlap" not in gap and "Filter (size(" not in gap and "Broadcast" not in gap


def test_overview_computes_sources_once(spark, sf_dir):
    """Sources, their newest observations, and the points on either side of the window's start: lines are read for each of these once."""
    assert plan(registry.QUERIES["p17_overview"](spark, sf_dir)).count("FileScan parquet [l_") == 4
    # One window by product and currency, one by product, on one sort.
    market = plan(pricing.select_market(spark.createDataFrame([], SOURCE)))
    assert [len(re.findall(rf"- {step} ", market)) for step in ("Window", "Sort", "Exchange")] == [2, 1, 1]


SOURCE = "product_id int, source_id int, retailer_id int, is_own_store boolean, sort_order int, success boolean, price double, currency string, availability string"


def test_overview_has_every_product(spark):
    """A product without sources has empty lists; a source of an unknown store counts in the market but has no row."""
    frame = spark.createDataFrame
    products = frame([(1, "a", "B", "1", "USD", None), (2, "b", "B", "1", "USD", None)], "product_id int, name string, brand string, size string, currency string, last_checked_at timestamp")
    sources = [(10, 1, 5, True, 0, "success", None), (11, 1, 6, False, 1, "success", None), (12, 1, 7, False, 2, "failed", None)]
    sources = frame(sources, "source_id int, product_id int, retailer_id int, is_own_store boolean, sort_order int, scraping_status string, last_error string")
    at = datetime(2001, 1, 1)
    seen = [(s, 1, price, price, "USD", "in_stock", at, 1, 1) for s, price in ((10, 10.0), (11, 8.0))]
    seen = frame(seen, "source_id int, product_id int, price double, original_price double, currency string, availability string, scraped_at timestamp, order_key int, order_line int")
    stores = frame([(5, "Own", "own.com"), (7, "Seven", "seven.com")], "retailer_id int, retailer_name string, domain string")
    found = {r["product_id"]: r for r in bundle.product_overviews(products, stores, sources, seen, datetime(2000, 1, 1)).collect()}
    assert (found[2]["analysis"], found[2]["rows"], found[2]["history"]) == (None, [], [])
    assert [(r["source_id"], r["retailer_name"], r["price"], r["error"]) for r in found[1]["rows"]] == [(10, "Own", 10.0, None), (12, "Seven", None, "Scrape failed")]
    assert found[1]["analysis"]["market_minimum"] == 8.0 and len(found[1]["history"]) == 2


def test_themes_by_words_are_those_of_patterns(spark):
    """What words and parts are looked up for is what each list's pattern says, at boundaries, in phrases, and where parts begin in or with others."""
    listed = [one for _, _, en, ar in lexicon.THEMES for one in [*text._alternatives(en), *text._alternatives(ar)]]
    plain = [re.sub(r"\(\?:ing\)\?", "ing", re.sub(r"\\s[*+]", "  ", one)).replace("?", "") for one in listed]
    texts = [t for p in plain for t in (p, f"x {p}.", f"{p}s", f"_{p}", f"é{p}é {p}", f"شعر{p}ناعم", p.upper())]
    texts += ["result", "improve", "work", "hydrate", "hairloss", "hair\tloss", "fall out", "a-price-b", "price_", "والشحن سريع", "غاليتنا", "لمعانناعم", "ſhipping", "PRİCE", " price", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    normal = text.normalize_arabic(text.F.lower(rows.t))
    patterns = [(name, normal.rlike(f"(?<![A-Za-z0-9_])(?:{en})(?![A-Za-z0-9_])|{ar}")) for name, _, en, ar in lexicon.THEMES]
    found = rows.select("t", text.detect_themes(rows.t).alias("found"), *[holds.alias(name) for name, holds in patterns]).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["found"] == [name for name, _ in patterns if r[name]], r["t"]


def test_review_texts_are_cleaned_as_before(spark):
    texts = ["a b", " a  b ", "a \t b\n", "\ta", "x  y", "x y  z", "fine  READ  more", "fine read more ", "Read More", "read more\xa0", "a\xa0b c", "é   é﻿", "é  é read more", "read more is fine", "  ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    space = r"[\s\xa0  ﻿]"
    whole = text.F.trim(text.F.regexp_replace(text.F.regexp_replace(rows.t, rf"(?i){space}*read more{space}*$", ""), rf"{space}+", " "))
    assert all(r[0] == r[1] for r in rows.select(text.clean_review(rows.t), whole).collect())


def test_words_of_the_lexicons_say_something(spark):
    texts = ["good bad", "GOOD! broken", "لا انصح به", "لا أنصح", "ما  انصح good good", "ممتاز والممتاز", "fast slow slow", "12", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    sign = lambda w: text.F.when(w.isin(text.POSITIVE), 1).otherwise(0) - text.F.when(w.isin(text.NEGATIVE), 1).otherwise(0)
    score = text.F.aggregate(text.tokens(rows.t), text.F.lit(0), lambda total, w: total + sign(w)) - text.F.when(text.normalize_arabic(text.F.lower(rows.t)).rlike(r"لا\s*انصح|ما\s*انصح"), 2).otherwise(0)
    for found, n in rows.select(text.text_sentiment(rows.t), score).collect():
        assert found == ("positive" if n > 0 else "negative" if n < 0 else "neutral")


def test_reviews_are_judged_once(spark, sf_dir):
    """Insights come of one count of the reviews: a text's themes are found in one place of the plan, in no filter."""
    for name in ("d17_q16_insight_counts", "u17_i02_campaign", "v08_campaign_slice", "g12_top_themes", "u09_store_rules"):
        assert "lineitem" not in plan(registry.QUERIES[name](spark, sf_dir)), name
    for name in ("u13_brand_insights", "u14_competitor_weaknesses", "u15_store_issues", "d15_theme_stats"):
        shown = plan(registry.QUERIES[name](spark, sf_dir))
        assert shown.count("lineitem.parquet") == 1 and not re.search(r"Filter [^\n]*(?:aggregate|RLIKE|regexp)", shown), name


def test_report_reads_lines_once_a_table(spark, sf_dir):
    """Sections read sources, newest observations, compliance and alerts that are written once; the report itself reads no prices of lines."""
    shown = plan(registry.QUERIES["v15_report_entries"](spark, sf_dir))
    assert "l_tax" not in shown and "l_returnflag" not in shown


def test_alerts_are_raised_in_one_read(spark, sf_dir):
    d = history.Domain(spark, sf_dir)
    pairs = alerts.with_previous(alerts.with_own_flag(d.observations, d.sources))
    columns = ["type", "product_id", "source_id", "step", "change_percentage", "scraped_at"]
    both = alerts.price_changes(pairs).select(*columns).unionByName(alerts.stock_outs(pairs).select(*columns))
    found = alerts.raised(pairs)
    assert plan(found).count("l_returnflag") and len(re.findall("Window ", plan(found))) * 2 == len(re.findall("Window ", plan(both)))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, both.collect()))


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    """One pattern reads plain pages; whatever else a page has goes to the parser; the outline is the same."""
    plain = ["", "text alone", "<DIV Class='a B' id=\"\" hidden>x<br><p>y</DIV> tail", "<p>a</p></b><i>open <s>z", "<a x='1' x=\"2\">twice</a\n>", "<svg><p>no</p></svg>yes", "<ul><li class=\"review\">ä<li>ن</ul>", "<p\n data-score='4.5' >é > f</p>"]
    plain += [page.replace("{body}", "it is").replace("{stars}", "4") for page in cases.WIDGETS]
    odd = ["a &amp; b", "<p title='&quot;'>x</p>", "<!-- <p> --><p>x</p>", "<script>if (a < b) '</p>'</script><p>x</p>", "<br/>x", "<p class=a>x</p>", "a < b > c", "<p title='a>b'>x</p>", "<p title=\"<\">x", "<title>a<b></title>", "<p", "</p x>", "<x:y z:w='1'>t</x:y>", "<p a = 'b'>x", "<p a='1'b='2'>x", "<!DOCTYPE html><p>x"]
    shown = lambda page: (page.elements, page.texts)
    fast = [shown(outline.Outline(h)) for h in plain + odd]
    assert all(hasattr(outline.Outline(h), "rawdata") == (h in odd) for h in plain + odd)
    monkeypatch.setattr(outline.Outline, "_read_plain", lambda self, html: False)
    assert fast == [shown(outline.Outline(h)) for h in plain + odd]


def test_compare_run_writes_what_is_judged(spark, sf_dir, monkeypatch):
    """Addresses and former prices aren't written."""
    written_tables = []
    monkeypatch.setattr(runs, "checkpointed", lambda rows: written_tables.append(rows.columns) or rows)
    runs.p15_compare(spark, sf_dir)
    assert "url" not in written_tables[0] and "original_price" not in written_tables[2]
