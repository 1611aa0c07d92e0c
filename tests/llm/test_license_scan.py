import random
import re._parser as parser
import time

import pytest

from tidemark.llm import license_rules, license_scan, words


def found(text):
    return license_scan.detect(b" ".join(words.split_words(text)).decode(), frozenset(x.decode() for x in words.split_words(text)))


def test_contained_detections_are_dropped():
    assert [x[2] for x in found("Here is the GNU General Public License, version 3.")] == ["gpl-3.0"]
    assert [x[:3] for x in found("x SPDX-License-Identifier: MIT y")] == [(1, 5, "mit")]
    assert [x[2] for x in found("CC BY-SA 4.0")] == ["cc-by-sa"]
    assert [x[2] for x in found("Copyright (c) 2019 A. All rights reserved. Licensed under the Apache License, Version 2.0")] == ["copyright", "reserved", "apache-2.0"]
    assert found("das ist mit der und eine Erlaubnis") == []


def slow(text):
    """The whole method without gates and sweeps: every rule everywhere, every detection against every other."""
    joined = b" ".join(words.split_words(text)).decode()
    hits = set()
    for r in license_rules.rules():
        for m in r.pattern.finditer(joined):
            first = joined[: m.start()].count(" ")
            hits.add((r.priority, first, first + m[0].count(" ") + 1, r.label, r.weight))
    out = []
    for x in hits:
        inside = [y for y in hits if y is not x and y[1] <= x[1] and y[2] >= x[2]]
        if not any(y[0] < x[0] or y[0] == x[0] and (y[2] - y[1] > x[2] - x[1] or y[1:3] == x[1:3] and (y[3], -y[4]) < (x[3], -x[4])) for y in inside):
            out.append(x[1:])
    return sorted(out)


def test_every_rule_finds_its_example_through_its_gate():
    assert len(license_rules.rules()) >= 250
    for rule in license_rules.rules():
        assert rule.pattern.fullmatch(rule.example) or rule.pattern.search(rule.example), rule.text
        assert rule.gate & set(rule.example.split()), (rule.text, rule.gate)
        assert found(rule.example) == slow(rule.example) != [], rule.text


def test_every_fixed_text_of_a_rule_passes_its_gate():
    for rule in license_rules.rules():
        for text in license_rules.variants(parser.parse(rule.text)):
            text = text.replace("\0", "1")
            assert rule.gate & set(text.split()), (rule.text, text)


def test_whole_method_against_brute_force():
    rng = random.Random(4)
    pool = [r.example for r in license_rules.rules()] + ["some words", "the", "gpl", "version 2 0", "license", "and", "copyright 2020", "all rights"]
    for _ in range(150):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))
        assert found(text) == slow(text), text


def test_a_long_text_of_detections_takes_time_in_proportion():
    text = "copyright 2020 gpl all rights reserved " * 20_000
    began = time.process_time()
    assert len(found(text)) == 60_000
    assert time.process_time() - began < 10


def brute(text):
    w = [x.decode() for x in words.split_words(text)]
    out = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_base_against_brute_force(spark):
    texts = [None, "", "CC BY", "cc", "by cc by cc BY 4.0", "General  Public\nLicense all rights reserved. General public", "All Rights, Reserved cc-by", "cc", "by"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    for r in license_scan.digest(license_scan.scan(docs)).collect():
        n, base = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_scan.digest(license_scan.scan(docs.filter("doc_id < 0"))).collect() == []


NAMES = {
    "LGPL": "lgpl", "FreeBSD License": "bsd-2-clause", "0BSD": "0bsd", "AGPLv3": "agpl-3.0", "AGPL3": "agpl-3.0", "GPL2": "gpl-2.0", "GPL3": "gpl-3.0",
    "Do What The Fuck You Want To Public License": "wtfpl", "Creative Commons Zero": "cc0-1.0",
}


@pytest.mark.parametrize("name, label", NAMES.items())
def test_names_without_the_usual_keyword(name, label):
    assert label in [x[2] for x in found(f"see the {name}")]


def test_rows(spark):
    long = "word " * 300_000 + "mit license"
    rows = [(i, f"It is under the {n}.") for i, n in enumerate(NAMES)] + [(50, long), (51, "MIT license"), (51, "MIT license"), (None, "MIT license"), (52, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, found string")
    got = license_scan.digest(license_scan.scan(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(label in by[i]["labels"].split(",") for i, label in enumerate(NAMES.values()))
    assert by[50]["labels"] == "mit" and by[50]["n_words"] == 300_002 and by[None]["labels"] == "mit" and by[52]["labels"] == ""
    assert [(r["labels"], r["n_found"]) for r in got if r["doc_id"] == 51] == [("mit", 1)] * 2
