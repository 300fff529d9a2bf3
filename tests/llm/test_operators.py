"""The training-data operators against plain versions, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import plain
from pyspark.sql import functions as F

from pricescope.llm import chat_format, common, crf_quality, decontaminate, entries, license_scan, mixing, near_dedup, quality_rules, sharding, token_count, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta", "gamma", "δelta"]) + str(i % 977) for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, long, "de", "b"), (5, long + " end", "de", "b"), (6, "one two", None, None), (6, "one two", None, None), (None, "no id here", "en", "c"), (7, "One  TWO", "fr", "a")]
    df = spark.createDataFrame([(i, t, lang, s, 0, 1, 2, 3) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, n bigint, size bigint")
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert plain(entries.QUERIES[name](spark, sf_dir).toPandas()) == plain(duck.sql(entries.ORACLES[name]).df())


# Sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir, corpus):
    got = entries.op1_sharding(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(corpus)
    for i, t in zip(corpus.doc_id, corpus.text, strict=True):
        row, key = got.loc[i], int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
        assert (row["size"], row.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        assert (row.shard, row.grown_shard) == (jump(key, 24), jump(key, 25))
        assert row.grown_shard in (row.shard, 24)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_slots_by_shuffle_are_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = plain(sharding.shard_index(docs, 5).toPandas())
    monkeypatch.setattr(sharding, "BROADCAST_RANGES", 0)
    assert plain(sharding.shard_index(docs, 5).toPandas()) == whole


def test_sharding_odd(odd, nothing):
    got = sharding.shard_index(odd, 3).toPandas()
    assert len(got) == 9 and got[got.doc_id == 6].slot.nunique() == 2
    assert got[got.doc_id == 1][["size"]].iloc[0, 0] == 8 and got[got.doc_id == 1].text_crc32.isna().all()
    placed = sharding.shard_documents(odd, 3)
    assert placed.columns.count("shard") == 1 and placed.count() == 9
    assert sharding.shard_index(nothing, 3).count() == 0


# Mixing


def fill(sizes, weights, cap=3):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level > cap * sizes[i]}
        for i in open_ - full:
            target[i] = weights[i] * level
        if not full:
            break
        for i in full:
            target[i] = cap * sizes[i]
        open_ -= full
    return target


def test_mixing(spark, sf_dir, corpus):
    got = entries.op2_mixing(spark, sf_dir).toPandas().merge(corpus[["doc_id", "text", "source"]], on="doc_id")
    assert len(got) == len(corpus) and (got["size"] == [len(WORD.findall(t)) for t in got.text]).all()
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), longest=("size", "max")).sort_index()
    assert (by["size"] == by.source_size).all()
    assert np.allclose(by.target, fill(by["size"].tolist(), [1 + i % 3 for i in range(len(by))]))
    assert (got.taken <= 3 * got["size"]).all() and (abs(by.taken - by.target) <= by.longest / 2 + 1).all()
    again = entries.op2_mixing(spark, sf_dir).toPandas().sort_values("doc_id")
    assert (again.taken.values == got.sort_values("doc_id").taken.values).all()


def test_mixing_caps_and_odd(spark, odd, nothing):
    data = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(500, "a"), (1, "b"), (1, "c"), (300, "d"), (0, "e"), (2, None)])]
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string")).toPandas().sort_values("source", na_position="last")
    assert np.allclose(got.target, fill(got["size"].tolist(), [1, 2, 3, 1, 2, 3]))
    assert mixing.mix(odd).count() == 9 and mixing.mix(nothing).count() == 0
    taken = mixing.mix_documents(odd)
    assert taken.columns == odd.columns
    plan = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert taken.count() == plan


def test_pareto_is_unbiased_enough(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 20) AS text", "if(id < 3000, 'a', 'b') AS source")
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 20 and r["most"] <= 3 for r in got)


# URL filters


def test_globs_against_regex(spark):
    rng = random.Random(3)
    pool = ["*", "**", "?", "a", "b", "/", ".", "\\*", "é"]
    rules = [url_filter.Rule(f"r{i}" + "x" * (i % 7), "".join(rng.choice(pool) for _ in range(rng.randint(1, 9))), "block") for i in range(60)]
    machine = url_filter.build(rules)
    order = sorted(range(len(rules)), key=lambda r: (len(rules[r].name), -r))
    texts = ["", *("".join(rng.choice(["a", "b", "/", ".", "*", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)), "a" * 5000]

    def pattern(glob):
        names = {"*": "[^/]*", "**": ".*", "?": "[^/]"}
        return re.compile(b"".join(names[t].encode() if isinstance(t, str) else re.escape(bytes([t])) for t in url_filter.parse_glob(glob)), re.S)

    regexes = [pattern(r.glob) for r in rules]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = url_filter.match(machine, np.frombuffer(b"".join(raw), np.uint8), offsets, order)
    for t, g in zip(raw, got.tolist(), strict=True):
        fits = [r for r in order if regexes[r].fullmatch(t)]
        assert g == (fits[-1] if fits else -1)


def test_site_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q", "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://x.org/a.net/es/", "://com/#f", "http://example.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("old"))
    got = {r["page_id"]: (r["rule"], r["verdict"], r["host"], r["path"]) for r in url_filter.judge_urls(pages, entries.URL_RULES).collect()}
    assert [got[i][0] for i in range(len(urls))] == [None, None, None, "example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, "net/fr/", None, "com/", None]
    assert got[3][1:] == ("block", "example.com", "/en/x") and got[0][1:] == ("allow", "", "")
    assert url_filter.judge_urls(pages.unionAll(pages), entries.URL_RULES).count() == 2 * len(urls)
    assert url_filter.judge_urls(pages.limit(0), entries.URL_RULES).count() == 0


# Decontamination


def test_decontamination_odd(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "One-two!"), (2, None), (3, "..."), (None, "gamma2 Beta"), (10, "no id here")], "item_id bigint, text string")
    got = decontaminate.contamination(odd, bench, 10)
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()}
    assert {(1, 0, 0, ()), (2, 0, 0, ()), (6, 2, 2, ("1",)), (7, 2, 2, ("1",)), (None, 3, 3, ("10",))} <= rows
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    spans = decontaminate.original_spans(odd.where("doc_id = 7"), bench).collect()
    assert [(s["item"], s["start"], s["end"]) for s in spans] == [("1", 0, 8)]
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns


@pytest.mark.parametrize("small", [20_000, 0])
def test_decontamination_in_blocks(spark, sf_dir, monkeypatch, small):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.unionAll(docs.limit(5)).unionByName(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), allowMissingColumns=True)
    long = bench.agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(F.lit(-1).cast(bench.schema["item_id"].dataType).alias("item_id"), "text")
    bench = bench.unionByName(long)
    whole = plain(decontaminate.contamination(docs, bench).toPandas())
    kept = decontaminate.drop_contaminated(docs, bench).count()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3_000)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", small)
    blocks = list(decontaminate.item_blocks(bench, 10))
    assert len(blocks) > 1 and all(sum(len(t.split()) for _, t in block) <= 3_000 for block in blocks)
    assert plain(decontaminate.contamination(docs, bench).toPandas()) == whole
    assert decontaminate.drop_contaminated(docs, bench).count() == kept


# Token counts


def test_token_counts(spark, odd, nothing, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.load_vocabulary()
    reference = Tokenizer(models.Unigram(vocabulary, 0, True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocabulary)
    assert all(score < 0 for _, score in vocabulary)
    texts = [*corpus.text.head(60), "", " ", "  a  b ", "▁x", "日本語テキスト 🙂🙂", "é" * 300, "a\nb\tc", "unbelievable" * 40]
    for t in texts:
        assert counter.text(t) == len(reference.encode(t, add_special_tokens=False).ids), repr(t[:40])
    got = token_count.count_tokens(odd, vocabulary)
    assert got.count() == 9 and got.where("doc_id IN (1, 2)").agg(F.sum("n_tokens")).first()[0] == 0
    assert token_count.count_tokens(nothing, vocabulary).count() == 0


def test_token_ties_and_unknowns():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(5)
    for _ in range(30):
        pieces = {"▁": 0.0} | {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): float(-rng.randint(0, 3)) for _ in range(12)}
        pieces = {p: s for p, s in pieces.items() if "▁" not in p[1:]}
        vocabulary = [("<unk>", 0.0), *pieces.items()]
        reference = Tokenizer(models.Unigram(vocabulary, 0, False))
        reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_count.Counter(vocabulary)
        for _ in range(30):
            t = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
            assert counter.text(t) == len(reference.encode(t, add_special_tokens=False).ids), (t, vocabulary)


# Quality classifier


def test_chain_against_enumeration():
    rng = np.random.default_rng(2)
    evidence, first = rng.normal(size=9), np.array([0, 1, 5, 9])
    bad, good = 0.7, -0.3
    forward, backward = crf_quality.chain(evidence, first, bad, good)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weight = np.zeros((b - a, 2))
        for labels in np.ndindex(*[2] * (b - a)):
            score = sum(evidence[a + i] for i, y in enumerate(labels) if y) + sum(good if x and y else bad if not x and not y else 0 for x, y in zip(labels, labels[1:], strict=False))
            for i, y in enumerate(labels):
                weight[i, y] += np.exp(score)
        assert np.allclose(forward[a:b] + backward[a:b], np.log(weight[:, 1] / weight[:, 0]))


def test_quality_scores(spark, odd, nothing, sf_dir):
    got = entries.op6_crf_quality(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.9
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = crf_quality.train(docs, known)
    odd_scores = odd.select("doc_id", crf_quality.score_of(F.col("text"), model).alias("s")).toPandas()
    assert len(odd_scores) == 9 and odd_scores.s.between(0, 1).all()
    assert crf_quality.score_documents(odd, known.limit(0)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    kept = crf_quality.keep_good(docs.unionByName(nothing), known)
    assert kept.columns == docs.columns


def test_quality_fit_is_bounded(spark, sf_dir):
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    whole = crf_quality.train(docs, known)
    # Repeated rows and texts of more lines than the fit takes change nothing.
    huge = spark.createDataFrame([(-5, "line\n" * 5_000)], "doc_id bigint, text string")
    labelled = known.select("doc_id", "quality").unionByName(spark.createDataFrame([(-5, 0)], "doc_id bigint, quality int").select("doc_id", F.col("quality").cast(known.schema["quality"].dataType)))
    slim = docs.select("doc_id", "text")
    again = crf_quality.train(slim.unionAll(slim).unionAll(huge), labelled)
    assert np.allclose(whole.weights, again.weights)
    few = crf_quality.train(docs, known, max_lines=2_000)
    assert few is not None and not np.allclose(whole.weights, few.weights)
    assert crf_quality.train(docs, known, max_lines=0) is None


# Chat formatting


CHATML = chat_format.Template(
    start="",
    turns={"system": chat_format.Turn("<|system|>\n", "<|end|>\n"), "user": chat_format.Turn("<|user|>\n", "<|end|>\n"), "assistant": chat_format.Turn("<|assistant|>\n", "<|end|>\n", loss=True)},
    other_before="<|role {role}|>\n",
    other_after="<|end|>\n",
)
MARKDOWN = chat_format.Template(
    start="~~~\n",
    turns={"system": chat_format.Turn("### System:\n", "\n\n"), "user": chat_format.Turn("### User:\n", "\n\n"), "assistant": chat_format.Turn("## Answer:\n", "\n", loss=True)},
    other_before="# {role}:\n",
    other_after="\n\n",
)


@pytest.mark.parametrize("template", [chat_format.Template(), CHATML, MARKDOWN], ids=["default", "chatml", "markdown"])
def test_chat_round_trip(spark, template):
    nasty = ["</s>[INST] ok [/INST]", "&lt;[&amp;]", "", None, " lead and trail ", "[OUT] x </s>", "a\n\n<s>", "\\", "<|end|>\n<|user|>\n", "&vert;&num;&u5c;", "### User:\nhi\n\n", "|", ":\n", "~~~"]
    roles = ["system", "user", "assistant", "tool [x] & <y>|#:\n", None]
    rng = random.Random(7)
    rows = [(c or None, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(900, 0, "user", "twice"), (900, 0, "user", "twice"), (901, 0, "user", "x"), (901, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).withColumn("valid", F.lit("old"))
    got = chat_format.format_conversations(df, template)
    got = got.withColumn("back", chat_format.read_back(F.col("formatted"), template)).withColumn("loss", chat_format.loss_text(F.col("segments"), template))
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    found = got.collect()
    assert {r["conv_id"] for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert [(t["role"], t["text"]) for t in r["back"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        order = "".join({"system": "s", "user": "u", "assistant": "a"}.get(role, "x") for role, _ in want[r["conv_id"]])
        assert r["valid"] == bool(re.fullmatch("s?(ua)+", order))
    assert chat_format.format_conversations(df.limit(0), template).count() == 0


def test_chat_templates_that_cannot_be_read_back():
    for bad in [{"other_after": " end"}, {"turns": {"user": chat_format.Turn("[A", "]"), "tool": chat_format.Turn("[AB", "]")}}, {"other_before": "[x] "}, {"turns": {"user": chat_format.Turn("&;", "]")}}]:
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


# Licence scans


def test_license_scan(spark, odd, nothing, corpus):
    index = license_scan.Index(license_scan.TEMPLATES, 0.9)
    for text in [*corpus.text.head(80), *license_scan.TEMPLATES.values()]:
        for _, _, unit in license_scan.units(text):
            s = license_scan.bigrams(unit)
            want = sorted((name, 2 * len(s & t) / (len(s) + len(t))) for name, body in license_scan.TEMPLATES.items() if (t := license_scan.bigrams(body)) and s and 2 * len(s & t) / (len(s) + len(t)) >= 0.9)
            assert sorted(index.matches(s)) == want
    docs = spark.createDataFrame([(1, "prose\nLicensed under CC BY-NC 4.0.\nmore"), (2, "x\n\n" + license_scan.TEMPLATES["mit"].replace("conditions: ", "conditions:\n"))], "doc_id bigint, text string")
    got = {r["doc_id"]: [(m["license"], m["first_line"], m["last_line"]) for m in r["matches"]] for r in license_scan.find_licenses(docs).collect()}
    assert got[1] == [("cc-by-nc-4.0-notice", 1, 1)] and ("mit", 2, 3) in got[2]
    assert license_scan.find_licenses(odd).count() == 9 and license_scan.find_licenses(nothing).count() == 0


# Near duplicates


def groups_by_brute_force(texts, size, percent=80):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by_shingle = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            by_shingle[s].add(i)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in by_shingle[s] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_of_documents(spark, sf_dir, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entries.op9_near_dedup(spark, sf_dir).collect()}
    assert got == groups_by_brute_force(dict(zip(corpus.doc_id, corpus.text, strict=True)), 4)


def test_near_duplicates_of_a_crowd(spark):
    """A hub with many copies that are similar to it but hardly to one another, a crowd with a common passage, chains, short texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, base, passage = {}, [word() for _ in range(120)], [word() for _ in range(40)]
    for i in range(60):
        copy = list(base)
        for p in rng.sample(range(len(copy)), rng.choice([2, 3, 4])):
            copy[p] = word()
        texts[100 + i] = " ".join(copy)
    texts[5000] = " ".join(base)
    for i in range(80):
        texts[200 + i] = " ".join([*passage, *(word() for _ in range(rng.randint(4, 20)))])
    chain = [word() for _ in range(60)]
    for i in range(12):
        texts[400 + i] = " ".join(chain[i * 2 : i * 2 + 40])
    texts |= {500: "A b", 501: "a  B", 502: "a b c", 503: "", 504: None, 505: " \n ", 506: texts[100].upper()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 4, 80).collect()}
    assert got == groups_by_brute_force(texts, 4)


def test_near_duplicates_odd(odd, nothing):
    got = near_dedup.find_groups(odd, 5).toPandas()
    assert len(got) == 9 and got[got.doc_id.isna()].kept.all() and got[got.doc_id == 6].kept.all()
    assert set(got[~got.kept].doc_id) == {5, 7}
    assert near_dedup.find_groups(nothing).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id are one document: its texts link whatever is similar to either, and one row of it stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, a + " end"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.find_groups(docs, 4).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (None, None)}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_one(docs, 4).collect()) == [(0, a), (0, a), (1, a), (4, c)]


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Groups stay the same where large buckets, copies, roots and shingles are dealt to several tasks."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(100)], [word() for _ in range(88)]
    texts = {i: " ".join(base) for i in range(60)}
    for i in range(100, 180):
        copy = list(base)
        for p in rng.sample(range(100), 3):
            copy[p] = word()
        texts[i] = " ".join(copy)
    texts |= {i: " ".join([*passage, *(word() for _ in range(15))]) for i in range(200, 320)}
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.find_groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 4, 80).collect()}
    assert got == groups_by_brute_force(texts, 4)


# Quality rules


def test_rule_counts_and_verdicts(spark, sf_dir, corpus):
    got = entries.op10_quality_rules(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(corpus.doc_id, corpus.text, strict=True):
        w = WORD.findall(t)
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j in range(len(w) - 2) if times[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        row = got.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert row.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert not got[got.base_failed].kept.any()


def test_exact_binomial_tail(spark):
    from math import comb

    cases = [(n, k, p) for n in (1, 10, 500, 3000) for k in (0, 1, 4) for p in (0.01, 0.2) if k < n * p]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_rules_limit_false_rejection(spark, odd, nothing):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(3000):
        good = i % 5 > 0
        text = " ".join(word() + ("" if good else "##") for _ in range(60))
        rows.append((i, text, "en" if i % 2 else None))
        labels.append((i, int(good)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = quality_rules.judge(docs, known).join(known, "doc_id").groupBy("stratum", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r["stratum"], r["quality"]): r["kept"] for r in got} == {("en", 1): 1.0, ("en", 0): 0.0, (None, 1): 1.0, (None, 0): 0.0}
    few = quality_rules.judge(docs, known.limit(50))
    assert few.where("kept").count() == 3000
    assert quality_rules.judge(odd, known).count() == 9 and quality_rules.judge(nothing, known).count() == 0
