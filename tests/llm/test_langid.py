import random

import numpy as np
import pytest

from tidemark.llm import langid

PARTS = {"aa": ["the", "ing", "on", "er"], "bb": ["der", "sch", "ung", "ü"], "cc": ["ción", "ado", "los", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n=240):
    rng = random.Random(3)
    langs = list(PARTS)
    return [(i, text(rng, langs[i % 3], rng.randint(5, 60)), langs[i % 3]) for i in range(n)]


def grams(t):
    counts = {}
    for word in "".join(c.lower() if c.isalpha() else " " for c in t).split():
        w = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if g := w[i : i + n].strip() and w[i : i + n]:
                    counts[g] = counts.get(g, 0) + 1
    return counts


def test_counts_are_those_of_a_plain_count(monkeypatch):
    import pyarrow as pa

    t = "The, Über x1\nthe the. 語語言,学の " + "wörterohneleerraum" * 3
    for piece in (1 << 22, 1, 2, 3, 7, 8, 40):
        monkeypatch.setattr(langid, "_PIECE", piece)
        batch = pa.RecordBatch.from_arrays([pa.array(["aa"]), pa.array([t])], ["lang", "text"])
        got = {}
        for b in langid._learn(iter([batch])):
            for _, g, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                s = "".join(" " if p == 1 else chr(p - 1) for p in [(g >> 42), (g >> 21) & 0x1FFFFF, g & 0x1FFFFF] if p)
                got[s] = c
        assert got == grams(t)


def brute(t, profiles):
    counts = grams(t or "")
    code = lambda g: sum((1 if c == " " else ord(c) + 1) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(counts, key=lambda g: (-counts[g], rank_code(profiles, g)))[: profiles.top]
    raw = {c: r for c, r in zip(profiles.raw, profiles.raw_ranks, strict=True)}
    return [sum(abs(i - raw[code(g)][k]) if code(g) in raw and raw[code(g)][k] < profiles.top else profiles.top for i, g in enumerate(own)) for k in range(len(profiles.langs))], len(own)


def rank_code(p, g):
    number = {0: 0} | {int(c): i + 1 for i, c in enumerate(p.alphabet)}
    code = 0
    for c in g:
        code = code * p.base + (0 if c == " " else number.get(ord(c), p.base - 1))
    return code + (p.base if len(g) > 1 else 0) + (p.base**2 if len(g) > 2 else 0)


def test_held_out_accuracy_and_distances(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    train = docs.filter(~langid.held_out())
    profiles = langid.fit(train)
    plain = langid.fit(train)
    profiles.raw, profiles.raw_ranks = plain.grams, None
    order = {int(c): r for c, r in zip(plain.codes, plain.ranks, strict=True)}
    profiles.raw_ranks = [order[_code(plain, g)] for g in plain.grams]
    got = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    assert all(r["lang_pred"] == r["lang"] for r in got.values())
    for i, t, _ in rows()[:20]:
        d, n = brute(t, profiles)
        assert got[i]["score"] == pytest.approx(1 - min(d) / (n * profiles.top))


def _code(p, gram):
    chars = [(int(gram) >> s) & 0x1FFFFF for s in (42, 21, 0)]
    return rank_code(p, "".join(" " if c == 1 else chr(c - 1) for c in chars if c))


def test_odd_rows(spark):
    docs = spark.createDataFrame(rows() + [(None, "the thing", "aa"), (900, None, "aa"), (901, "", None), (902, "12 ... !", "bb"), (903, "the er", None), (903, "the er", None), (904, "漢字 ж", None), (905, "ThE onER " * 600_000, "aa")], "doc_id long, text string, lang string").withColumn("score", langid.F.lit("x"))
    got = [r for r in langid.identify(docs).collect()]
    assert len(got) == 248
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[None]["lang_pred"] == by[903]["lang_pred"] == by[905]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.identify(docs.filter("doc_id < 0"))
    assert nothing.collect() == [] and {"lang_pred", "score"} <= set(nothing.columns)
    assert {r["lang_pred"] for r in langid.identify(docs.filter("lang IS NULL")).collect()} == {"und"}


def test_profiles_of_no_languages():
    p = langid.Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), 5)
    assert p.base == 2
