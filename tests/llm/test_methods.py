"""Methods against plain versions: inclusion of documents by weight, certified rules, and ways that only large tables take."""

import os

import numpy as np
import pytest
from conftest import TABLES, plain
from pyspark.sql import functions as F

from pricescope.llm import mixing, quality_rules
from pricescope.llm.oracles import ORACLES


def levels(words, target, cap=3):
    """Expected copies by weight: min(cap, weight * level), with the words of each weight given."""
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        total = sum(min(cap, w * middle) * n for w, n in words.items())
        low, high = (middle, high) if total < target else (low, middle)
    return {w: min(cap, w * low) for w in words}


def test_inclusion_follows_the_weights(spark):
    """300 sources of 40 documents of equal size: over the sources, a weight's mean copies are those that it should have."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "lpad(id DIV 40, 3, '0') AS source", "CASE id % 4 WHEN 0 THEN 0.5D WHEN 3 THEN 2D ELSE 1D END AS wish")
    got = mixing.mix(docs, weight=F.col("wish")).join(docs.select("doc_id", "wish"), "doc_id").withColumn("kind", F.col("source").cast("int") % 3)
    sums = got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).toPandas()
    assert (abs(sums.taken - sums.target) <= 10).all()
    for r in got.groupBy("kind", "wish").agg(F.avg("copies").alias("copies"), F.count("*").alias("n"), F.avg("target").alias("target"), F.min("copies").alias("low"), F.max("copies").alias("high")).collect():
        want = levels({0.5: 100, 1.0: 200, 2.0: 100}, r["target"])[r["wish"]]
        p = want - np.floor(want)
        assert abs(r["copies"] - want) <= 4 * np.sqrt(p * (1 - p) / r["n"]) + 0.02
        assert r["low"] >= np.floor(want + 1e-9) and r["high"] <= np.ceil(want - 1e-9)


def test_inclusion_with_unequal_sizes(spark):
    """200 sources of 40 documents of 1 to 400 words: by weight and class of size, documents are taken as often as they should be."""
    docs = spark.range(8_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id * 7919 % 401 AS int)) AS text", "lpad(id DIV 40, 3, '0') AS source", "CASE id % 3 WHEN 0 THEN 0.5D WHEN 1 THEN 2D ELSE 1D END AS wish")
    got = mixing.mix(docs, weight=F.col("wish")).join(docs.select("doc_id", "wish"), "doc_id").toPandas()
    got["p"] = 0.0
    got["floor"] = 0
    for _, rows in got.groupby("source"):
        want = levels(rows.groupby("wish")["size"].sum().to_dict(), rows.target.iloc[0])
        got.loc[rows.index, "floor"] = [int(np.floor(want[w] + 1e-9)) for w in rows.wish]
        got.loc[rows.index, "p"] = [want[w] - np.floor(want[w] + 1e-9) for w in rows.wish]
        assert abs((rows["size"] * rows.copies).sum() - rows.target.iloc[0]) <= rows["size"].median()
    assert set(got.copies - got.floor) <= {0, 1}
    got["kind"] = got["size"].map(lambda n: int(n).bit_length())
    for (_, kind), rows in got[got.p > 1e-6].groupby(["wish", "kind"]):
        if kind >= 5:
            taken, p = (rows.copies - rows.floor).sum(), rows.p
            assert abs(taken - p.sum()) <= 4 * np.sqrt((p * (1 - p)).sum()) + 0.03 * len(rows)


def test_mixing_by_shuffle_is_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = plain(mixing.mix(docs).toPandas())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert plain(mixing.mix(docs).toPandas()) == whole
    taken = mixing.mix_documents(docs)
    assert taken.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_equal_rows_are_taken_together(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 3 + [(i, "one two three four", "x") for i in range(2, 40)] + [(99, "z " * 300, "y")], "doc_id bigint, text string, source string")
    for seed in range(3):
        copies = mixing.mix(docs, seed=seed).where("doc_id = 1").select("copies").distinct().count()
        assert copies == 1


@pytest.fixture(scope="module")
def larger(sf_dir):
    """A table with enough labels for something to be certified."""
    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    return folder


def test_certified_rules_against_sql(spark, larger):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas()
    assert plain(got) == plain(connection.sql(ORACLES["op10_quality_rules"]).df())
    # The method's verdict acts beyond the base rules.
    assert (~got.base_failed & ~got.kept).any()


def test_rules_by_shuffle_are_the_same(spark, sf_dir, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" + ("##" if i % 5 == 0 else "") for k in range(60)), "en" if i % 2 else None) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(1200)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    whole = quality_rules.judge(docs, labels).select("doc_id", "kept").toPandas()
    assert whole.kept.sum() == 960
    monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", 0)
    assert plain(quality_rules.judge(docs, labels).select("doc_id", "kept").toPandas()) == plain(whole)
    # Copies of a good text are no more evidence than one: nothing is certified by them.
    same = spark.createDataFrame([(i, rows[1 if i % 5 else 0][1], "en") for i in range(1200)], "doc_id bigint, text string, lang string")
    measured = quality_rules.measure(same)
    assert quality_rules.certify(measured, labels).count() == 0
