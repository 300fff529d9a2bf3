"""Line deduplication, Merkle manifests and collocations against plain versions, on odd rows, and on ways that only large inputs take."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricescope.llm import collocations, crf_quality, entries, license_scan, line_dedup, merkle
from pricescope.llm.segments import find_lines

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    long = "\n".join(" ".join(rng.choice(["alpha", "Beta", "δelta"]) + str(rng.randint(0, 900)) for _ in range(9)) for _ in range(4000))
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, long, "de"), (5, "new first line\n" + long + "\n", "de"), (6, "one two three four\none two three four\nshort", None), (6, "one two three four\none two three four\nshort", None)]
    rows += [(None, "ONE two three four", "en"), (None, "one two three four", None), (7, "  One Two three FOUR\v\nééééééééé\nÉÉÉÉÉÉÉÉÉÉ", "und"), (8, "éééééééééé\nÉÉÉÉÉÉÉÉÉÉ \r\nééééééééé", "fr"), (9, "tail\n\n\n", "fr"), (-3, "one two three four", "fr")]
    return spark.createDataFrame([(i, t, lang, None if i == 3 else "s", None if i == 4 else 5, 1, 2, "x") for i, t, lang in rows], DOCS + ", n_lines int, gone int, proof string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# Lines


def plain_lines(rows, least=10):
    """(doc_id, lines, dropped, kept) of (doc_id, text) in order."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def edited(docs, **options):
    return sorted(((r["__row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.edit_lines(docs, **options).collect()), key=repr)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_lines(spark, sf_dir, odd, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert edited(docs) == plain_lines(pairs(docs))
    assert edited(odd) == plain_lines(pairs(odd)) and edited(nothing) == []
    assert edited(odd, min_chars=1) == plain_lines(pairs(odd), 1)
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] in (1, 4, 5)) == [(1, None), (4, dict(pairs(odd))[4]), (5, "new first line\n")]


def test_lines_of_large_inputs(spark, monkeypatch):
    """Filters far too small, many flushes, keys of many documents: the same result."""
    rng = random.Random(5)
    rows = [(i, "\n".join(["a line that all of them hold", f"a line of number {i % 40}", *(f"own words {rng.random()}" for _ in range(3)), "short"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain_lines(rows)
    assert edited(docs) == want
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 4096)
    monkeypatch.setattr(line_dedup, "FLUSH", 500)
    monkeypatch.setattr("pricescope.llm.common.HOT_ROWS", 50)
    assert edited(docs) == want


def test_filters_lose_no_repeat():
    """What several texts hold is in the filter of keys seen twice, whichever tasks they fall to."""
    hashes = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    n_bits = line_dedup.filter_size(10)
    assert n_bits == line_dedup.SEGMENT_BITS and all((p < n_bits).all() for p in line_dedup.positions(hashes, n_bits))
    assert line_dedup.filter_size(10**9) >= 16 * 10**9


# Trees


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, fanout=8):
    """Root and, for each node, its siblings by level as (before, after)."""
    proofs = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in held[k]:
                    proofs[leaf].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        nodes, held = [sha("".join(nodes[k] for k in run)) for run in runs], [[x for k in run for x in held[k]] for run in runs]
    return nodes[0], proofs


def plain_manifest(rows):
    """What the query returns, of (doc_id, source, lang, n_chars, text)."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(show, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: plain_tree([leaf(r) for r in order[g]]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names]) if names else ("", [])
    out = []
    for k, g in enumerate(names):
        for r, proof in zip(order[g], trees[g][1], strict=True):
            seen = leaf((*r[:4], r[4].translate(LOWER) if r[4] is not None else None)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            steps = proof + above[k]
            for before, after in steps:
                seen = sha(before + seen + after)
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join(b + a for b, a in steps)), seen, seen == root))
    return sorted(out, key=repr)


def manifest(spark, docs, monkeypatch):
    monkeypatch.setattr(entries, "read", lambda *_: docs)
    return sorted((tuple(r) for r in entries.op12_merkle_manifest(spark, "").collect()), key=repr)


def fields(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("part_rows", [20_000, 7])
def test_manifest(spark, sf_dir, monkeypatch, odd, nothing, part_rows):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table in (docs, odd, nothing, docs.limit(1)):
        assert manifest(spark, table, monkeypatch) == plain_manifest(fields(table))


def test_manifest_of_many_groups(spark, monkeypatch):
    """More groups than the fanout, each of another size; equal rows."""
    rows = [(i % 50, f"Text {i % 50}", f"g{g}", "s", 1) for g in range(11) for i in range(g * g + 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(merkle, "PART_ROWS", 13)
    assert manifest(spark, docs, monkeypatch) == plain_manifest(fields(docs))


def test_all_nodes(spark, monkeypatch):
    """Partitions and the merging of their edges make each inner node once."""
    monkeypatch.setattr(merkle, "PART_ROWS", 30)
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id < 650, 'a', null) AS lang").repartition(4)
    built = merkle.build_manifest(docs, "lang", "doc_id", ["doc_id", "text"], fanout=3)
    found = [(r["grp"], r["level"], r["idx"], r["hash"]) for r in merkle.inner_nodes(built).collect()]
    want = []
    for grp, ids in (("=a", range(650)), ("", range(650, 700))):
        nodes, level = [sha("".join(f"{len(str(v))}:{v}" for v in (i, f"text {i}"))) for i in ids], 0
        while len(nodes) > 1:
            nodes, level = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], level + 1
            want += [(grp, level, k, h) for k, h in enumerate(nodes)]
    assert sorted(found) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600), st.lists(st.integers(0, 600), max_size=6), st.integers(2, 9))
def test_mountains_meet(total, cuts, fanout):
    """Parts that begin and end anywhere emit peaks that make the same root, and no node twice."""
    leaves = [sha(str(i)) for i in range(total)]
    bounds = sorted({0, total, *(c for c in cuts if c < total)})
    nodes, records = {}, {}
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = merkle.MountainRange(total, fanout)
        for i in range(a, b):
            part.push(0, i, leaves[i])
        part.finish()
        for level, index, _, digest in part.peaks:
            assert (level, index) not in nodes
            nodes[level, index] = digest
        for level, run, children in part.records:
            assert (level, run) not in records
            records[level, run] = children
    widths = merkle.MountainRange(total, fanout).widths
    for level in range(len(widths) - 1):
        open_runs = defaultdict(dict)
        for (at, index), digest in nodes.items():
            if at == level:
                open_runs[index // fanout][index] = digest
        for run, children in open_runs.items():
            assert len(children) == min(fanout, widths[level] - run * fanout)
            nodes[level + 1, run] = merkle.node([children[i] for i in sorted(children)])
    assert nodes[len(widths) - 1, 0] == plain_tree(leaves, fanout)[0]


# Phrases


def plain_phrases(rows, least, percent=100, top=2000):
    import re

    counts, words_of = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words_of[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang][" ".join(words[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        n, kept = words_of[lang], []
        often = {p: a for p, a in found.items() if a >= least}
        for phrase, a in often.items():
            w = phrase.split(" ")
            if len(w) < 2:
                continue
            cuts = [(1000 * a * n // (often[" ".join(w[:k])] * often[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(len(b.split(" ")) > len(w) and 100 * f >= percent * a and f" {phrase} " in f" {b} " for b, f in often.items()):
                kept.append((phrase, a, often[" ".join(w[:k])], often[" ".join(w[k:])], n, score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(kept[:top])]
    return sorted(out)


def phrases(docs, **options):
    return sorted(tuple(r) for r in collocations.find_collocations(docs, **options).collect())


def test_phrases(spark, sf_dir, odd, nothing, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    want = plain_phrases(rows, 12)
    assert len(want) > 100 and phrases(docs, min_count=12) == want
    assert phrases(docs, min_count=12, top=5) == [r for r in want if r[1] <= 5]
    assert phrases(docs, min_count=20, percent=60) == plain_phrases(rows, 20, 60)
    assert phrases(docs, min_count=300) == plain_phrases(rows, 300)
    odd_rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert phrases(odd, min_count=3) == plain_phrases(odd_rows, 3) and phrases(nothing) == []
    # Sketches that are far too small let all pass; many sendings, hot keys: the same result.
    monkeypatch.setattr(collocations, "MIN_WIDTH", collocations.SEGMENT)
    monkeypatch.setattr(collocations, "MAX_WIDTH", collocations.SEGMENT)
    monkeypatch.setattr(collocations, "FLUSH", 300)
    monkeypatch.setattr("pricescope.llm.common.HOT_ROWS", 20)
    assert phrases(docs, min_count=12) == want


def test_phrases_of_equal_words(spark):
    docs = spark.createDataFrame([(i, "a a a a. b a a", "x") for i in range(40)] + [(99, None, "x"), (100, "No! no?", None)], "doc_id bigint, text string, lang string")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert phrases(docs, min_count=2) == plain_phrases(rows, 2)


def test_scores_beyond_64_bits(spark):
    from pricescope.llm.common import Scratch

    a, n, part = 4 * 10**15, 9 * 10**17, 5 * 10**15
    counts = spark.createDataFrame([("x", 0, "", n), ("x", 1, "u", part), ("x", 1, "v", part), ("x", 2, "u v", a)], "lang string, size int, phrase string, n bigint")
    got = collocations.score_phrases(counts, Scratch(spark, "test")).collect()
    assert [r["score"] for r in got] == [int(Fraction(1000 * a * n, part * part))]


# Earlier operators


def test_a_document_scores_the_weighted_mean_of_its_lines():
    """Marginals by enumeration of all labellings; the score is their mean by length, a line of no bytes counting as one."""
    from itertools import product

    rng = np.random.default_rng(3)
    text = "Some words here.\n\nNOISE ### 123\nSome words here.\nand the last of them"
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    features, lengths, first = crf_quality.line_features(data, offsets)
    x = crf_quality.with_neighbours(features, first)
    model = crf_quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), rng.normal(size=x.shape[1]), 0.7, -0.2)
    evidence = x @ model.weights
    total, good = 0.0, np.zeros(len(x))
    for labels in product((0, 1), repeat=len(x)):
        score = sum(e for e, y in zip(evidence, labels, strict=True) if y) + sum(model.good if a and b else model.bad if not a and not b else 0 for a, b in zip(labels, labels[1:], strict=False))
        weight = np.exp(score)
        total += weight
        good += weight * np.array(labels)
    size = np.maximum(lengths, 1)
    assert list(lengths) == [len(line.encode()) for line in text.split("\n")]
    assert model.scores(data, offsets)[0] == pytest.approx(((good / total) * size).sum() / size.sum())


def test_the_fit_climbs_to_the_optimum():
    """After the fit no weight can be moved to make the labelled lines likelier (penalty included): the gradient is that of the plain likelihood."""
    texts = ["a good line.\nanother one.", "@@@ ###\n123 456 789\n!!!", "fine words here.", "### bad\nnot so bad."]
    labels = np.array([1, 0, 1, 0])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    features, _, first = crf_quality.line_features(data, offsets)
    model = crf_quality.fit(features, first, labels, steps=4000)
    x = (crf_quality.with_neighbours(features, first) - model.centre) / model.scale

    def objective(weights, bad, good):
        out = 0.0
        for k, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            e, n = x[a:b] @ weights, b - a
            alpha = np.array([0.0, e[0]])
            for t in range(1, n):
                alpha = np.array([np.logaddexp(alpha[0] + bad, alpha[1]), np.logaddexp(alpha[0], alpha[1] + good) + e[t]])
            path = e.sum() + (n - 1) * good if labels[k] else (n - 1) * bad
            out += (path - np.logaddexp(*alpha)) / n / 2
        return out - crf_quality.PENALTY / 2 * (weights @ weights + bad**2 + good**2)

    best = objective(model.weights, model.bad, model.good)
    for k in range(len(model.weights)):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert objective(moved, model.bad, model.good) <= best + 1e-6
    for step in (-0.05, 0.05):
        assert objective(model.weights, model.bad + step, model.good) <= best + 1e-6
        assert objective(model.weights, model.bad, model.good + step) <= best + 1e-6


def test_a_text_of_very_many_lines(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = crf_quality.train(docs, labels)
    long = "\n".join(f"line {i} of a very long text" for i in range(200_000))
    data = np.frombuffer(long.encode(), np.uint8)
    assert len(find_lines(data, np.array([0, len(data)]))[0]) == 200_000
    score = spark.createDataFrame([(1, long)], "doc_id bigint, text string").select(crf_quality.score_of(F.col("text"), model)).first()[0]
    assert 0 <= score <= 1


def test_licenses_of_odd_rows(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "mit"), (None, mit), (5, mit), (5, mit), (6, "words before\n" + mit + "\nand after")]
    got = license_scan.find_licenses(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, matches int, license string"))
    found = sorted(((r["doc_id"], sorted({m["license"] for m in r["matches"]})) for r in got.collect()), key=repr)
    assert found == sorted([(1, []), (2, []), (3, []), (4, []), (None, ["mit"]), (5, ["mit"]), (5, ["mit"]), (6, ["mit"])], key=repr)


def test_repeated_licenses_are_quick():
    import time

    text = "\n".join([license_scan.TEMPLATES["mit"]] * 320)
    began = time.time()
    found = license_scan.matches_of(license_scan.Index(license_scan.TEMPLATES, license_scan.THRESHOLD), text)
    assert len(text) > 300_000 and time.time() - began < 4
    assert ("mit", 0, 319) in [(name, a, b) for name, _, a, b in found] and sum(name == "mit" for name, *_ in found) == 321
