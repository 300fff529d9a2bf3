"""Streams with state by source, the stored alerts, stored tables, and plans that must stay as they are."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from pricescope.functions import text
from pricescope.operators import bundle, content, pricing
from pricescope.plans import edges
from pricescope.session import checkpointed, drop_results, shared_dir
from pricescope.sources.domain import AS_OF, Domain
from pricescope.sources.layout import drop_table, store_by_source
from pricescope.streaming import sink
from pricescope.streaming.alerts import PriceWatch, alert_stream, store_alerts, stored_alerts, version_stream


def run(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def fed(spark, parts, schema, make):
    """The output of a stream that gets its rows in parts, a run for each."""
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        run(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), folder)
    return spark.read.parquet(f"{folder}/out")


def day(n):
    return datetime(2024, 1, n)


SNAPSHOT = "source_id bigint, snapshot_id bigint, captured_at timestamp, title string, description string, bullets array<string>, rating double, images int, language string"


def test_versions_that_come_back(spark):
    """A, B, A are three versions, over triggers and inside one; a look without change extends the current one; late and undated looks do nothing."""
    a, b = ("A", "text", ["x"]), ("B", "text", None)
    look = lambda source, i, n, copy, rating=None: (source, i, day(n) if n else None, *copy, rating, 1, "en")
    parts = [
        [look(1, 1, 1, a, 4.0), look(2, 2, 1, a), look(2, 3, 2, b), look(2, 4, 3, a)],
        [look(1, 5, 3, b), look(1, 6, 2, a), look(1, 7, None, a)],
        [look(1, 8, 2, b), look(1, 9, 5, a, 3.0), look(1, 10, 6, a, 5.0)],
    ]
    rows = fed(spark, parts, SNAPSHOT, version_stream).collect()
    of = lambda source: sorted((r["snapshot_id"], r["version"], r["fresh"], tuple(r["changed"])) for r in rows if r["source_id"] == source)
    assert of(2) == [(2, 1, True, ()), (3, 2, True, ("title", "bullets")), (4, 3, True, ("title", "bullets"))]
    assert of(1) == [(1, 1, True, ()), (5, 2, True, ("title", "bullets")), (6, 1, False, ()), (9, 3, True, ("title", "bullets")), (10, 3, False, ())]
    batch = content.versions(spark.createDataFrame([x for p in parts for x in p if x[0] == 2], SNAPSHOT))
    assert sorted((r["version"], r["since"]) for r in batch.collect()) == [(1, day(1)), (2, day(2)), (3, day(3))]
    kept = content.versions(spark.createDataFrame([look(5, 1, 1, a, 4.0), look(5, 2, 2, a, 2.0)], SNAPSHOT)).first()
    assert (kept["rating"], kept["last_seen"]) == (2.0, day(2))


OBSERVATION = "source_id bigint, price double, availability string, scraped_at timestamp, order_key bigint, order_line int"


def test_alerts_of_late_and_undated_rows(spark):
    parts = [
        [(1, 10.0, "in_stock", day(2), 1, 1), (2, None, None, day(1), 1, 1), (1, 99.0, None, None, 9, 9)],
        [(1, 5.0, "in_stock", day(1), 2, 1), (2, 4.0, "out_of_stock", day(2), 2, 1)],
        [(1, 11.0, "out_of_stock", day(3), 3, 1), (1, 12.0, "out_of_stock", day(3), 3, 2), (2, float("nan"), "in_stock", day(3), 3, 1), (2, 4.0, "out_of_stock", day(4), 4, 1)],
    ]
    got = sorted(((r["type"], r["source_id"], r["previous_price"], r["price"]) for r in fed(spark, parts, OBSERVATION, alert_stream).collect()), key=repr)
    assert got == sorted([("OUT_OF_STOCK", 2, None, 4.0), ("OUT_OF_STOCK", 1, None, 11.0), ("OUT_OF_STOCK", 2, None, 4.0), ("PRICE_CHANGE", 1, 10.0, 11.0), ("PRICE_CHANGE", 1, 11.0, 12.0)], key=repr)


def test_stored_alerts_of_late_and_undated_rows(spark):
    """Batches that meet the state as a table raise what the state functions raise; a batch that is run again stores the same, an empty one keeps the state."""
    parts = [
        [(1, 10.0, "in_stock", day(2), 1, 1), (2, None, None, day(1), 1, 1), (1, 99.0, None, None, 9, 9)],
        [(1, 5.0, "in_stock", day(1), 2, 1), (2, 4.0, "out_of_stock", day(2), 2, 1)],
        [],
        [(1, 11.0, "out_of_stock", day(3), 3, 1), (1, 12.0, "out_of_stock", day(3), 3, 2), (2, float("nan"), "in_stock", day(3), 3, 1), (2, 4.0, "out_of_stock", day(4), 4, 1)],
        [(1, 12.0, "in_stock", day(3), 0, 1), (3, 1.0, "out_of_stock", day(1), 1, 1)],
    ]
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    for i, rows in enumerate([[], *parts]):
        for _again in range(2):
            store_alerts(spark.createDataFrame(rows, OBSERVATION), i, folder)
    got = sorted(((r["type"], r["source_id"], r["previous_price"], r["price"]) for r in stored_alerts(spark, folder).collect()), key=repr)
    assert got == sorted([("OUT_OF_STOCK", 2, None, 4.0), ("OUT_OF_STOCK", 1, None, 11.0), ("OUT_OF_STOCK", 2, None, 4.0), ("PRICE_CHANGE", 1, 10.0, 11.0), ("PRICE_CHANGE", 1, 11.0, 12.0)], key=repr)


def test_alert_stream_looks_up_no_source_on_its_own(spark, sf_dir, monkeypatch):
    """Large batches meet the stored state in one shuffle; observations are made once, not for each part."""
    made = []
    monkeypatch.setattr(edges, "checkpointed", lambda rows: made.append(rows) or checkpointed(rows))
    monkeypatch.setattr(PriceWatch, "handleInputRows", None)
    assert edges.stream_alerts(spark, sf_dir).count() > 0
    assert len(made) == 2


def test_state_can_be_forgotten(spark):
    """Such a stream runs on, as its state goes by the clock: it is only planned here."""
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    spark.createDataFrame([], OBSERVATION).write.parquet(folder)
    stream = alert_stream(spark.readStream.schema(OBSERVATION).parquet(folder), forget=3_600_000)
    assert stream.isStreaming and "ProcessingTime" in stream._jdf.queryExecution().analyzed().toString()


ALERT = "alert_id string, status string, created_at timestamp"


def test_stored_alerts(spark):
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    batch = lambda *rows: spark.createDataFrame(list(rows), ALERT)
    table = lambda: sorted(((r["alert_id"], r["status"]) for r in sink.read_alerts(spark, folder, ALERT).collect()))
    first = batch(("a", "new", datetime(2024, 1, 5)), ("b", "new", datetime(2024, 2, 5)), ("b", "new", datetime(2024, 2, 5)), ("n", "new", None))
    sink.merge_alerts(first, folder, ALERT)
    assert table() == [("a", "new"), ("b", "new"), ("n", "new")]
    assert sink.mark_alerts(spark, folder, ALERT) == 3 and sink.mark_alerts(spark, folder, ALERT) == 0
    # The same batch again, and one with rows of a known partition and of a new one.
    sink.merge_alerts(first, folder, ALERT)
    sink.merge_alerts(batch(("a", "new", datetime(2024, 1, 5)), ("c", "new", datetime(2024, 1, 9)), ("d", "new", datetime(2024, 3, 1)), ("m", "new", None)), folder, ALERT)
    assert table() == [("a", "read"), ("b", "read"), ("c", "new"), ("d", "new"), ("m", "new"), ("n", "read")]
    assert sink.expire_alerts(spark, folder, datetime(2024, 3, 10), 30) == ["2024-01"]
    assert table() == [("b", "read"), ("d", "new"), ("m", "new"), ("n", "read")]
    live = sink.live_alerts(spark, folder, ALERT, datetime(2024, 3, 10), 30)
    assert [r["alert_id"] for r in live.collect()] == ["d"]
    assert "PartitionFilters: [isnotnull(month" in plan_of(live)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_observations_stored_by_source(spark, sf_dir):
    """What is grouped or ordered by source needs no exchange."""
    table = f"stored_{uuid.uuid4().hex}"
    stored = store_by_source(Domain(spark, sf_dir).observations, table, buckets=4)
    before = F.expr("lag(price) OVER (PARTITION BY source_id ORDER BY scraped_at, order_key, order_line, price)")
    assert "Exchange" not in plan_of(pricing.latest_per_source(stored)) and "Exchange" not in plan_of(stored.withColumn("before", before))
    drop_table(spark, table)


def test_points_are_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(bundle.newest_points(Domain(spark, sf_dir).observations, datetime.fromisoformat(AS_OF), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_terms_are_counted_inside_their_row(spark, sf_dir):
    rows = text.term_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "doc_id"], "text")
    assert "Exchange" not in plan_of(rows)
    counts = text.term_counts(spark.createDataFrame([(1, "Fresh oils, the fresh oils of 12 shops"), (2, None), (3, "of the")], "id int, t string"), ["id"], "t")
    assert {(r["term"], r["n"]) for r in counts.collect()} == {("fresh", 2), ("oils", 2), ("fresh oils", 2), ("shops", 1)}


def test_results_can_be_dropped(spark):
    held = checkpointed(spark.range(5))
    assert held.count() == 5 and drop_results(spark) >= 1 and drop_results(spark) == 0
