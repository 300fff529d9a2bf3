"""Price-change and stock-out alerts, and versions of page copy, over streams. State is one small row for each source.

A source's state is the newest observation (or snapshot) by its own time. A late row never replaces a newer one and raises no alert, so a stream whose
rows come in order of time gives the batch rules' results. Rows without a time can't be placed: they raise nothing and change no
state. States live in RocksDB, keyed by source, so their number is bounded by disk; with ``forget`` those of sources that nobody has
seen for so long go.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pricescope.functions.numeric import is_valid_price
from pricescope.operators.alerts import LEAST_CHANGE
from pricescope.operators.content import REFRESHED, TRACKED
from pricescope.session import remove

#: Times are microseconds inside the state functions.
ALERTS = "type string, source_id bigint, previous_price double, price double, at bigint"
SEEN = "price double, availability string, at bigint"
#: What a look at a page tells: a new version with the fields that changed, or that the current one still stands.
LOOKS = "source_id bigint, version bigint, fresh boolean, changed array<string>, at bigint, snapshot_id bigint, rating double, images int, language string"
VERSION = "version bigint, digests array<string>, at bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _valid(price: float | None) -> bool:
    return price is not None and 0 < price < float("inf")


class PriceWatch(StatefulProcessor):
    """Alerts of one source: its last observation against each new one."""

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", SEEN, self.forget) if self.forget else handle.getValueState("last", SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        fresh = [r for r in rows if r.at is not None and (last is None or r.at >= last[2])]
        low = lambda price: float("-inf") if price is None else price
        for r in sorted(fresh, key=lambda r: (r.at, r.order_key, r.order_line, low(r.price))):
            if last is not None:
                if _valid(last[0]) and _valid(r.price) and abs(r.price - last[0]) >= LEAST_CHANGE:
                    yield Row(type="PRICE_CHANGE", source_id=key[0], previous_price=last[0], price=r.price, at=r.at)
                if r.availability == "out_of_stock" and last[1] != "out_of_stock":
                    yield Row(type="OUT_OF_STOCK", source_id=key[0], previous_price=None, price=r.price, at=r.at)
            last = (r.price, r.availability, r.at)
        if fresh:
            self.last.update(last)

    def close(self) -> None:
        pass


class VersionWatch(StatefulProcessor):
    """Versions of one page: a look whose copy differs from the last one's is a new version, though it may have been there before."""

    def init(self, handle) -> None:
        self.current = handle.getValueState("current", VERSION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.current.get() if self.current.exists() else None
        version, digests, since = state or (0, None, None)
        fresh = [r for r in rows if r.at is not None and (since is None or r.at >= since)]
        for r in sorted(fresh, key=lambda r: (r.at, r.snapshot_id)):
            now = [hashlib.sha256(json.dumps(r[f]).encode()).hexdigest() for f in TRACKED]
            changed = [f for f, a, b in zip(TRACKED, now, digests or now, strict=True) if a != b]
            is_new = digests is None or bool(changed)
            version += is_new
            yield Row(source_id=key[0], version=version, fresh=is_new, changed=changed, at=r.at, snapshot_id=r.snapshot_id, **{f: r[f] for f in REFRESHED})
            digests, since = now, r.at
        if fresh:
            self.current.update((version, digests, since))

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state of any size needs the store on disk; queries that are started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def alert_stream(observations: DataFrame, forget: int | None = None) -> DataFrame:
    """Alerts of a streaming table of competitors' observations.

    ``forget``: milliseconds after which an unseen source's state goes. That is by the clock, so such a stream runs on: don't start it with
    ``availableNow``, which waits for its end.
    """
    keep_state_on_disk(observations.sparkSession)
    wanted = observations.select("source_id", "price", "availability", F.unix_micros("scraped_at").alias("at"), "order_key", "order_line")
    found = wanted.groupBy("source_id").transformWithState(PriceWatch(forget), ALERTS, "Append", "ProcessingTime" if forget else "None")
    return found.withColumn("scraped_at", F.timestamp_micros("at")).drop("at")


def version_stream(snapshots: DataFrame) -> DataFrame:
    """Every look at a page, with its version: new versions have ``fresh``, others only extend theirs."""
    keep_state_on_disk(snapshots.sparkSession)
    wanted = snapshots.select("source_id", "snapshot_id", F.unix_micros("captured_at").alias("at"), *TRACKED, *REFRESHED)
    looks = wanted.groupBy("source_id").transformWithState(VersionWatch(), LOOKS, "Append", "None")
    return looks.withColumn("captured_at", F.timestamp_micros("at")).drop("at")


#: A stored row: an alert by its type, or the newest observation of a source.
NEWEST = "NEWEST"
STORED = "source_id bigint, previous_price double, price double, availability string, scraped_at timestamp"


def store_alerts(batch: DataFrame, batch_id: int, folder: str) -> None:
    """The rules of ``PriceWatch`` for a batch of a stream as one sort by source: for large batches, in which most sources have new rows.

    Each batch stores its alerts and the newest observation of every source so far as Parquet (``batch=<id>/type=<type>``). Those of the batch
    before are the state: they meet the new rows in one shuffle, no source is looked up on its own, and a batch that is run again stores the
    same. A row older than its source's newest is late. States before the last two batches go.
    """
    spark = batch.sparkSession
    rows = batch.where("scraped_at IS NOT NULL").select("source_id", "price", "availability", "scraped_at", "order_key", "order_line", F.lit(1).alias("fresh"))
    if batch_id > 0:
        state = spark.read.schema(f"{STORED}, type string").parquet(f"{folder}/batch={batch_id - 1}").where(F.col("type") == NEWEST)
        rows = rows.unionByName(state.select("source_id", "price", "availability", "scraped_at", F.lit(0).alias("fresh")), allowMissingColumns=True)
    over = "OVER (PARTITION BY source_id ORDER BY scraped_at, fresh, order_key, order_line, price)"
    held = rows.withColumns(
        {
            "previous": F.expr(f"lag(struct(price, availability)) {over}"),
            "last": F.expr(f"lead(1) {over}").isNull(),
            # Late rows stand before their source's state.
            "known": F.expr("max(CASE WHEN fresh = 0 THEN scraped_at END) OVER (PARTITION BY source_id)"),
        }
    )
    before, now = F.col("previous.price"), F.col("price")
    judged = (F.col("fresh") == 1) & F.col("previous").isNotNull() & F.coalesce(F.col("scraped_at") >= F.col("known"), F.lit(True))
    moved = judged & is_valid_price(before) & is_valid_price(now) & (F.abs(now - before) >= LEAST_CHANGE)
    went = judged & (F.col("availability") == "out_of_stock") & ~F.col("previous.availability").eqNullSafe("out_of_stock")
    kinds = F.array_compact(F.array(F.when(moved, "PRICE_CHANGE"), F.when(went, "OUT_OF_STOCK"), F.when(F.col("last"), NEWEST)))
    found = held.select("source_id", before.alias("previous_price"), "price", "availability", "scraped_at", F.explode(kinds).alias("type"))
    found.withColumn("previous_price", F.when(F.col("type") == "PRICE_CHANGE", F.col("previous_price"))).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/batch={batch_id}")
    remove(spark, f"{folder}/batch={batch_id - 2}/type={NEWEST}")


def stored_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """(type, source_id, previous_price, price, scraped_at) of all batches that ``store_alerts`` stored."""
    rows = spark.read.schema(f"{STORED}, batch bigint, type string").option("basePath", folder).parquet(folder)
    return rows.where(F.col("type") != NEWEST).select("type", "source_id", "previous_price", "price", "scraped_at")
