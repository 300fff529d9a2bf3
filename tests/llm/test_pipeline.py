"""The corpus pipeline: each stage's decisions take effect, and each is held against its operator's plain version."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import groups_by_brute_force, jump

from pricescope.llm import crf_quality, decontaminate


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {}
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(stage(spark, tables[-1], sf_dir).cache())
        kept[i] = tables[-1].toPandas()
        if i < 4:
            assert tables[-1].columns == columns
    scores = crf_quality.score_documents(docs, labels).toPandas().set_index("doc_id").score
    assert set(kept[0].doc_id) == set(scores[scores >= 0.5].index)
    known = labels.toPandas().set_index("doc_id").quality
    clean = known[(known == 1)].index
    assert len(set(clean) - set(kept[0].doc_id)) <= 0.02 * len(clean)
    groups = groups_by_brute_force(dict(zip(kept[0].doc_id, kept[0].text, strict=True)), 5)
    assert set(kept[1].doc_id) == {i for i, (_, root) in groups.items() if i == root}
    hits = decontaminate.contamination(tables[2], bench).toPandas().set_index("doc_id").n_hit
    assert set(kept[2].doc_id) == set(hits[hits == 0].index)
    assert set(kept[3].doc_id) <= set(kept[2].doc_id) and kept[3].doc_id.value_counts().max() <= 3
    assert len(kept[4]) == len(kept[3])
    assert all(s == jump(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), 24) for i, s in zip(kept[4].doc_id, kept[4].shard, strict=True))


def test_run(spark, sf_dir):
    result = corpus_pipeline.run(spark, sf_dir)
    assert "shard" in result.columns and result.count() > 0


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_documents(spark, sf_dir, kind):
    rows = [(1, None, None), (2, "", "a"), (3, "same text of a few words here", "a"), (4, "same text of a few words here", "b"), (5, "word " * 50_000, "b"), (6, "twice", None), (6, "twice", None), (None, "no id", "c"), (None, None, None)]
    docs = spark.createDataFrame(rows if kind == "odd" else [], "doc_id bigint, text string, source string")
    # Columns named as the operators' own, null throughout.
    names = ["size", "shard", "rank", "node", "n", "row", "copies", "score", "target", "key", "lang"]
    docs = docs.select("*", *[F.lit(None).cast("bigint").alias(name) for name in names])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert {x for x in got} <= {(i, t) for i, t, _ in rows} and (kind == "odd" or not got)
        if i == 1 and got:
            # Copies go, rows without a doc_id and without words stay.
            assert sorted(t or "" for i, t in got if i is None) == ["", "no id"]
            assert [i for i, t in got if t == "same text of a few words here"] == [3]
            assert {1, 2, 5, 6} <= {i for i, _ in got}
        if i == 4:
            assert len(got) == docs.count() and all(0 <= r["shard"] < 24 for r in out.collect())
