"""Known results of the pricing rules."""

import pytest

from pricescope.operators import pricing

COLUMNS = "product_id bigint, source_id bigint, retailer_id bigint, is_own_store boolean, sort_order int, success boolean, price double, currency string, availability string"


def rows(product, own, competitors, currency="USD"):
    listed = [(own, True, currency, "in_stock")] + [(c, True, currency, "in_stock") if not isinstance(c, tuple) else c for c in competitors]
    return [(product, product * 100 + i, i, i == 0, i, ok, p, cur, av) for i, (p, ok, cur, av) in enumerate(listed)]


def analyse(spark, *groups):
    data = [r for g in groups for r in g]
    stats = pricing.market_stats(pricing.select_market(spark.createDataFrame(data, COLUMNS)))
    return {r["product_id"]: r for r in pricing.analyse(stats).collect()}


def test_examples(spark):
    got = analyse(
        spark,
        rows(1, 32.0, [35.0, 31.0, 37.0]),
        rows(2, 30.0, [35.0, 34.0, 36.0]),
        rows(3, 32.0, []),
        rows(4, 35.0, [35.0, 35.0, 35.0]),
        rows(5, 32.0, [0.0, -4.0, float("nan"), (None, True, "USD", "in_stock"), 35.0]),
        rows(6, 0.0, [35.0, 31.0, 37.0]),
        rows(7, 32.0, [35.0, (36.0, False, None, None), 37.0]),
        rows(8, 32.0, [35.0, (20.0, True, "USD", "out_of_stock")]),
        rows(9, 32.0, [(35.0, True, "EUR", "in_stock"), (31.0, True, None, "in_stock")]),
    )
    spec = got[1]
    assert (spec["market_minimum"], spec["market_maximum"], spec["market_average"], spec["market_median"]) == (31, 37, 34.33, 35)
    assert (spec["versus_average"], spec["versus_minimum"], spec["versus_maximum"], spec["gap_percentage"]) == (-6.8, 3.23, -13.51, -8.57)
    assert (spec["position"], spec["suggested_price"]) == ("SLIGHTLY_UNDERPRICED", 34.65)
    assert (got[2]["gap_percentage"], got[2]["position"], got[2]["suggested_price"], got[2]["change_amount"]) == (-14.29, "UNDERPRICED", 34.3, 4.3)
    assert (got[3]["status"], got[3]["reason"]) == ("INSUFFICIENT_DATA", "NO_COMPETITOR_PRICES")
    assert (got[4]["gap_percentage"], got[4]["position"], got[4]["equal"]) == (0, "MARKET_ALIGNED", 3)
    assert (got[5]["successful_competitor_count"], got[5]["market_median"]) == (1, 35)
    assert (got[6]["reason"], got[6]["market_median"]) == ("NO_OWN_PRICE", 35)
    assert (got[7]["market_median"], got[7]["competitor_count"], got[7]["successful_competitor_count"]) == (36, 3, 2)
    assert got[8]["market_median"] == 35
    assert (got[9]["market_median"], got[9]["successful_competitor_count"]) == (31, 1)


@pytest.mark.parametrize(
    ("gap", "band"),
    [(-14.29, "UNDERPRICED"), (-10.01, "UNDERPRICED"), (-10.0, "SLIGHTLY_UNDERPRICED"), (-5.01, "SLIGHTLY_UNDERPRICED"), (-5.0, "MARKET_ALIGNED"), (5.0, "MARKET_ALIGNED"), (5.01, "SLIGHTLY_OVERPRICED"), (10.0, "SLIGHTLY_OVERPRICED"), (10.01, "OVERPRICED")],
)
def test_bands(spark, gap, band):
    from pyspark.sql import functions as F

    from pricescope.functions.numeric import gap_position

    assert spark.range(1).select(gap_position(F.lit(gap))).first()[0] == band


def test_rounding(spark):
    from pyspark.sql import functions as F

    from pricescope.functions.numeric import round_half_up, round_money

    got = spark.range(1).select(round_money(F.lit(1234 * 0.99), F.lit("JPY")), round_money(F.lit(12.345 * 0.98), F.lit("KWD")), round_money(F.lit(1.005), F.lit(None)), round_half_up(F.lit(-2.5))).first()
    assert tuple(got) == (1222, 12.098, 1.01, -2)


def test_late_rows_do_not_replace_newer_ones(spark):
    from datetime import datetime

    data = [(1, 5.0, None, "USD", "in_stock", datetime(2024, 1, 2), 1, 1), (1, 9.0, None, "USD", "in_stock", datetime(2024, 1, 1), 2, 1)]
    observed = spark.createDataFrame(data, "source_id bigint, price double, original_price double, currency string, availability string, scraped_at timestamp, order_key bigint, order_line int")
    assert pricing.latest_per_source(observed).first()["price"] == 5.0
