"""A generated catalog with a year of weekly prices, the same for the same seed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

#: Size of the catalog.
PRODUCTS, STORES, WEEKS = 10, 5, 53


def generator(seed: int):
    """Even numbers in [0, 1) from a 32-bit state."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        return state / 2**32

    return draw


def catalog(spark: SparkSession, seed: int = 42, end: datetime = datetime(2024, 12, 30)) -> DataFrame:
    """Observations of every product and store by week. The last source of the last product fails: its last two weeks are missing."""
    draw = generator(seed)
    rows = []
    for p in range(PRODUCTS):
        base = 20 + 80 * draw()
        for s in range(STORES):
            level = base * (0.85 + 0.3 * draw())
            for w in range(WEEKS):
                level *= 1 + (draw() - 0.5) * 0.04
                if p == PRODUCTS - 1 and s == STORES - 1 and w >= WEEKS - 2:
                    continue
                out = p == 0 and s == 1 and w == WEEKS - 1
                rows.append((p * STORES + s, p, s, round(level, 2), None, "USD", "out_of_stock" if out else "in_stock", end - timedelta(weeks=WEEKS - 1 - w), w, 1))
    columns = "source_id bigint, product_id bigint, retailer_id bigint, price double, original_price double, currency string, availability string, scraped_at timestamp, order_key bigint, order_line int"
    return spark.createDataFrame(rows, columns)
