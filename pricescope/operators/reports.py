"""Role reports: decisions, key figures with deltas, headline, recipients and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key figures of each audience, in order.
KPIS = {
    "ceo": ["compared", "overpriced", "underpriced", "aligned", "belowOfficial", "newAlerts"],
    "sales": ["restocks", "unlisted", "storesWithGaps", "belowOfficial", "stockOuts", "unopenedDoors"],
    "marketing": ["contentScore", "needsWork", "notCaptured", "rewrites", "ourWeaknesses", "competitorWeaknesses"],
    "all": ["compared", "overpriced", "underpriced", "belowOfficial", "restocks", "storesWithGaps", "contentScore", "needsWork", "rewrites", "ourWeaknesses"],
}
PRIORITIES = ["high", "medium", "low"]


def decisions(analysis: DataFrame, products: DataFrame, n: int = 12) -> DataFrame:
    """The products more than ten percent off their market, farthest first, and what to do."""
    off = analysis.where("status = 'OK' AND abs(gap_percentage) > 10").join(products.select("product_id", "name"), "product_id")
    top = off.orderBy(F.abs("gap_percentage").desc(), "name", "product_id").limit(n)
    return top.select("product_id", "name", "gap_percentage", F.when(F.col("gap_percentage") > 0, "lower").otherwise("raise").alias("direction"), (F.col("suggested_price") - F.col("own_price")).alias("price_change"))


def price_actions(decided: DataFrame) -> DataFrame:
    """The first two products to lower and the first to raise, by priority, then by place."""
    place = F.expr("row_number() OVER (PARTITION BY direction ORDER BY abs(gap_percentage) DESC, name, product_id)")
    chosen = decided.withColumn("place", place).where("(direction = 'lower' AND place <= 2) OR (direction = 'raise' AND place = 1)")
    priority = F.when((F.col("direction") == "lower") & (F.abs("gap_percentage") >= 25), "high").otherwise("medium")
    listed = chosen.withColumn("priority", priority)
    return sort_actions(listed, F.when(F.col("direction") == "lower", F.col("place")).otherwise(100))


def sort_actions(actions: DataFrame, index: Column) -> DataFrame:
    """By priority, keeping the order within one; ``rank`` numbers the result."""
    key = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return actions.withColumn("__key", key).withColumn("__index", index).withColumn("rank", F.expr("row_number() OVER (ORDER BY __key, __index)")).drop("__key", "__index")


def headline(actions: DataFrame) -> DataFrame:
    """One row: status and the numbers that it rests on."""
    counted = actions.agg(F.count("*").alias("actions"), F.count_if(F.col("priority") == "high").alias("urgent"))
    return counted.withColumn("status", F.when(F.col("urgent") > 0, "critical").when(F.col("actions") > 0, "attention").otherwise("healthy"))


def previous_snapshot(logs: DataFrame, audience: str) -> DataFrame:
    """The key figures saved with the last report of an audience that reached somebody."""
    sent = logs.where((F.col("audience") == audience) & F.exists("results", lambda r: r["status"] == "sent"))
    return sent.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(1).select("kpis")


def key_figures(values: DataFrame, previous: DataFrame, audience: str) -> DataFrame:
    """(kpi, place, value, delta) of an audience; figures without a value are left out. ``previous`` has at most one row."""
    order = F.array(*[F.lit(k) for k in KPIS[audience]])
    wanted = values.where(F.col("kpi").isin(KPIS[audience]) & F.col("value").isNotNull()).withColumn("place", F.array_position(order, F.col("kpi")))
    before = previous.select(F.explode("kpis").alias("kpi", "before"))
    return wanted.join(before, "kpi", "left").select("kpi", "place", "value", (F.col("value") - F.col("before")).alias("delta"))


def group_recipients(recipients: DataFrame, wanted: DataFrame) -> DataFrame:
    """(audience, emails): each recipient's audience is as asked, or the team's own; ids count once; inactive ones are reported apart."""
    joined = wanted.dropDuplicates(["recipient_id"]).join(recipients, "recipient_id", "left")
    audience = F.when(F.coalesce(F.col("audience"), F.lit("auto")) == "auto", F.col("team")).otherwise(F.col("audience"))
    usable = F.coalesce("is_active", F.lit(False))
    return joined.groupBy(F.when(usable, audience).otherwise("rejected").alias("audience")).agg(
        F.array_join(F.array_sort(F.collect_list(F.coalesce(F.lower("email"), F.col("recipient_id").cast("string")))), ",").alias("emails")
    )


def report_history(logs: DataFrame, n: int = 20) -> DataFrame:
    count = lambda status: F.size(F.filter("results", lambda r: r["status"] == status))
    rows = logs.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(n)
    return rows.select("log_id", "audience", count("sent").alias("sent"), count("failed").alias("failed"))
