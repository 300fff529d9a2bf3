"""Queries that must take in all their rows, held against plain versions."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pricescope.functions import text
from pricescope.operators import alerts, matrix
from pricescope.plans import edges, slices
from pricescope.plans import grid as grid_plans
from pricescope.plans import text as text_plans
from pricescope.sources.domain import Domain


def test_stream_takes_every_observation(spark, sf_dir):
    d = Domain(spark, sf_dir)
    pairs = alerts.with_previous(alerts.with_own_flag(d.observations, d.sources))
    batch = alerts.price_changes(pairs).select("type", "source_id").unionAll(alerts.stock_outs(pairs).select("type", "source_id"))
    want = {(r["type"], r["source_id"]): r["n"] for r in batch.groupBy("type", "source_id").agg(F.count("*").alias("n")).collect()}
    got = {(r["type"], r["source_id"]): r["n"] for r in edges.stream_alerts(spark, sf_dir).collect()}
    assert got == want and len({source // 1_000_000 % 20 for _, source in got}) == 20


def test_csv_has_every_store(spark):
    products = spark.createDataFrame([(1, "b, x", "B", "5", "USD"), (2, "A", None, None, None), (3, "c", "B", "7", "USD")], "product_id bigint, name string, brand string, size string, currency string")
    cells = [(1, r, f"Store {r:02}", r == 10, r == 10, 0 if r == 10 else 1, "out_of_stock" if r == 9 else "current", r + 0.5) for r in range(1, 31)] + [(2, 31, "Store, 31", False, False, 1, "failed", 4.0)]
    grid = spark.createDataFrame(cells, "product_id bigint, retailer_id bigint, retailer_name string, is_brand_store boolean, is_own_store boolean, sort_order int, state string, price double")
    analysis = spark.createDataFrame([(1, "EUR", 10.0, -2.5, "MARKET_ALIGNED", 9.99)], "product_id bigint, currency string, market_median double, gap_percentage double, position string, suggested_price double")
    got = [r["line"] for r in matrix.csv_export(products, grid, analysis).orderBy("place").collect()]
    rest = [r for r in range(1, 31) if r != 10]
    assert got == [
        ",".join(["Product,Brand,Size,Currency,Store 10 (official price)", *(f"Store {r:02}" for r in rest), '"Store, 31",Market median,Gap vs median (%),Position,Suggested price']),
        "A,,," + "," * 32 + ",,,",
        ",".join(['"b, x",B,5,EUR,10.5', *("Out of stock" if r == 9 else f"{r}.5" for r in rest), ",10,-2.5,Market aligned,9.99"]),
        "c,B,7,USD" + "," * 32 + ",,,",
    ]


def test_csv_sink_writes_the_whole_export(spark, sf_dir):
    lines = [r["line"] for r in grid_plans.x01_csv(spark, sf_dir).collect()]
    assert slices.a16_csv_sink(spark, sf_dir).first() == (len(lines), sum(map(len, lines)))


def test_keywords_of_any_script(spark, sf_dir):
    rows = text_plans._reviews(spark, sf_dir).where("sentiment <> 'neutral'").select("brand", "sentiment", text.tokens(F.col("body")).alias("tokens")).collect()
    counts = defaultdict(Counter)
    for r in rows:
        counts[r["brand"], r["sentiment"]].update(r["tokens"])
    got = defaultdict(dict)
    for r in text_plans.QUERIES["g10_keywords"](spark, sf_dir).collect():
        got[r["brand"], r["sentiment"]][r["term"]] = r["n"]
    assert set(got) == {k for k, c in counts.items() if c}
    for key, terms in got.items():
        assert sorted(terms.values()) == sorted(counts[key].values())[-8:] and all(counts[key][t] == n for t, n in terms.items())
    assert any(not t.isascii() for terms in got.values() for t in terms)
