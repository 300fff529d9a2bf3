"""Known results of text, listing and alert rules."""

from pyspark.sql import functions as F

from pricescope.functions import text
from pricescope.operators import alerts, listing, matrix


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens(spark):
    words = lambda t: one(spark, text.tokens(F.lit(t)))
    assert words("The Argan OIL shampoo is for dry hair, 400 ml") == ["argan", "oil", "shampoo", "dry", "hair"]
    assert words("Add to cart - fast shipping - argan") == ["fast", "argan"]
    assert words("الشَّعر شعر") == ["شعر", "شعر"]
    assert words("للشعر والبشرة") == ["شعر", "بشره"]


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, "Sulfate free shampoo. Sulfate free and gentle")], "id int, t string")
    counts = {r["term"]: r["n"] for r in text.term_counts(rows, ["id"], "t").collect()}
    assert counts["sulfate free"] == 2 and counts["shampoo"] == 1 and "free gentle" not in counts


def test_csv_text(spark):
    csv = lambda t: one(spark, matrix.csv_text(F.lit(t)))
    assert csv("=SUM(A1)") == "'=SUM(A1)" and csv('a "b", c') == '"a ""b"", c"' and csv(None) == ""


def test_page_numbers(spark):
    shown = lambda current, total: " ".join(spark.range(1).select(listing.page_numbers(F.lit(current), F.lit(total))).first()[0])
    assert shown(5, 10) == "1 … 4 5 6 … 10" and shown(1, 1) == "1" and shown(2, 3) == "1 2 3" and shown(1, 4) == "1 2 … 4"

def test_gap_alerts(spark):
    gaps = spark.createDataFrame([(1, 4.0, 12.5), (2, None, -14.29), (3, 11.0, 15.0), (4, -12.0, -20.0), (5, 10.0, 10.0)], "product_id bigint, previous_gap double, current_gap double")
    assert {(r["product_id"], r["type"]) for r in alerts.gap_alerts(gaps).collect()} == {(1, "OVERPRICED"), (2, "UNDERPRICED")}
