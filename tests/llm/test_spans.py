"""Licences that are neither a line nor a paragraph nor the whole text."""

import random

import pytest

from pricescope.llm import license_scan


def spans_by_brute_force(run, wanted, threshold):
    windows = []
    for a in range(len(run)):
        for b in range(a, len(run)):
            s = set(run[a : b + 1])
            dice = 2 * len(s & wanted) / (len(s) + len(wanted))
            if dice >= threshold:
                windows.append((-dice, b - a, a))
    taken = []
    for minus, length, a in sorted(windows):
        if all(y < a or x > a + length for x, y, _ in taken):
            taken.append((a, a + length, -minus))
    return sorted(taken)


def test_spans_by_brute_force():
    rng = random.Random(3)
    for threshold in (0.9, 0.6):
        index = license_scan.Index(license_scan.TEMPLATES, threshold)
        for _ in range(25):
            words = []
            for _ in range(rng.randint(1, 4)):
                words += rng.choices(["the", "license", "under", "licensed", "x", "mit"], k=rng.randint(0, 12))
                part = license_scan._WORDS.findall(license_scan.TEMPLATES[rng.choice(index.names[:4])].lower())
                words += [w for w in part * rng.randint(1, 2) if rng.random() > 0.05]
            run = list(zip(words, words[1:], strict=False))
            present = index.present(set(run))
            for i, wanted in enumerate(index.sets):
                want = spans_by_brute_force(run, wanted, threshold) if len(wanted) < 20 else index.spans(run, i)
                assert index.spans(run, i) == want and (i in present or not want)


def test_licenses_across_lines_and_in_lines(spark):
    mit, isc = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["isc"]
    prose = "\n\n".join(f"Some words of paragraph {i} that belong to no license at all." for i in range(40))
    parts = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    docs = [
        (1, f"{prose}\n\n{parts}\n\n{prose}"),
        (2, f"{prose}\n\n{isc.replace('copies. THE', 'copies.' + chr(10) * 2 + 'THE')}\n\n{prose}"),
        (3, "All of the text and the pictures are ours and this page is Licensed under CC BY-NC 4.0. but the rest of it is not and has its own terms."),
        (4, "a line of the paragraph before the notice\nof it: This work is licensed under the\nGNU General Public License, version 3.\nand a line of the paragraph after it"),
        (5, license_scan.TEMPLATES["apache-2.0-header"]),
        (6, prose),
        (7, "Released under the MIT License. " + mit),
    ]
    got = {r["doc_id"]: [(m["license"], m["first_line"], m["last_line"]) for m in r["matches"]] for r in license_scan.find_licenses(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {
        1: [("mit", 80, 84)],
        2: [("isc", 80, 82)],
        3: [("cc-by-nc-4.0-notice", 0, 0)],
        4: [("gpl-3.0-notice", 1, 2)],
        5: [("apache-2.0-header", 0, 0)],
        6: [],
        7: [("mit", 0, 0), ("mit-notice", 0, 0)],
    }


def best_by_brute_force(text, templates, threshold=0.9):
    """(licences, best licence, its coefficient) over all runs of words of a short text."""
    words = license_scan._WORDS.findall((text or "").lower())
    bests = {}
    for name, body in templates.items():
        wanted = license_scan.bigrams(body)
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + 2 * len(wanted) + 4) + 1):
                s = license_scan.bigrams(" ".join(words[a:b]))
                if 0.8 * len(wanted) <= len(s) <= 1.25 * len(wanted):
                    dice = 2 * len(s & wanted) / (len(s) + len(wanted))
                    if dice >= threshold:
                        bests[name] = max(bests.get(name, 0), dice)
    return bests


def test_licences_of_short_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2500")
    notices = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("notice")}
    rows = {r["doc_id"]: {m["license"]: m["dice"] for m in sorted(r["matches"], key=lambda m: m["dice"])} for r in license_scan.find_licenses(docs, notices).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert any(rows.values()) and set(rows) == set(texts)
    for i, text in texts.items():
        assert rows[i] == best_by_brute_force(text, notices), i


def test_heads_of_source_files(spark):
    code = "\n".join(f"def function_{i}(a, b):\n    return a * {i} + b" for i in range(60))
    heads = {name: body for name, body in license_scan.TEMPLATES.items() if not name.endswith("notice")}
    wrap = lambda body: "\n".join("# " + " ".join(body.split()[i : i + 12]) for i in range(0, len(body.split()), 12))
    docs = [(i, f"#!/usr/bin/env python\n# Copyright 2001 the owners\n\n{wrap(body)}\n{code}") for i, body in enumerate(heads.values())]
    got = {r["doc_id"]: r["matches"] for r in license_scan.find_licenses(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, (name, body) in enumerate(heads.items()):
        last = 3 + len(wrap(body).split("\n")) - 1
        assert (name, 3, last) in [(m["license"], m["first_line"], m["last_line"]) for m in got[i]], name


def test_templates_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("own", "use it as you like but name us"), (None, "x"), ("empty", None)], "license string, text string")
    templates = license_scan.read_templates(table)
    assert templates == {"own": "use it as you like but name us"}
    found = license_scan.find_licenses(spark.createDataFrame([(1, "please use it as you like but name us thank you"), (2, None)], "doc_id bigint, text string"), templates)
    assert {r["doc_id"]: [m["license"] for m in r["matches"]] for r in found.collect()} == {1: ["own"], 2: []}
    monkeypatch.setattr(license_scan, "MAX_TEMPLATE_CHARS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        license_scan.read_templates(table)
