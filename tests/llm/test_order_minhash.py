import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import components, order_minhash, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_banded_alignment_against_the_full_table():
    rng = random.Random(4)
    for _ in range(4000):
        a = [rng.randint(0, rng.choice([2, 9])) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.7 else [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 8)):
            if b and rng.random() < 0.6:
                b[rng.randrange(len(b))] = rng.randint(0, 9)
            elif b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 9))
        k = rng.randint(0, 12)
        d = distance(a, b)
        assert order_minhash.distance(np.array(a, np.uint32), np.array(b, np.uint32), k) == (d if d <= k else None), (a, b, k)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(x, root(x)) for x in parent} and len(got) == len(parent)
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def changed(rng, w, rate):
    out = []
    for x in w:
        r = rng.random()
        if r < rate / 2:
            out.append(f"n{rng.randint(0, 999)}")
        elif r >= rate:
            out.append(x)
    return out


def corpus():
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    shared = say(60)
    texts = [say(rng.randint(80, 200)) for _ in range(60)]
    near = [changed(rng, rng.choice(texts[:20]), rng.choice([0.01, 0.03, 0.06])) for _ in range(60)]
    hot = say(120)
    near += [changed(rng, hot, 0.02) for _ in range(80)] + [hot] * 40
    mixed = [say(60) + shared + say(60) for _ in range(30)]  # a passage in common, and nothing else
    return [" ".join(t) for t in texts + near + mixed + [say(3), say(3), ["one"]] * 2] + [None, "", "...", "?", "w1 " * 500, "w1 " * 490]


def brute(texts, threshold=0.8):
    w = [np.array([hash(x) & 0xFFFFFFFF for x in words.split_words(t)], np.uint32) for t in texts]
    parent = list(range(len(w)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(w)):
        for j in range(i):
            if len(w[i]) and len(w[j]) and order_minhash.similar(w[j], w[i], threshold):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(w))]


@pytest.fixture(scope="module")
def found(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id string, n_words int")
    return texts, brute(texts), docs


def test_classes_against_brute_force(found):
    texts, want, docs = found
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) and got[i]["is_representative"] == (want[i] == i) for i in got)


def test_one_document_of_each_class_stays(found):
    _, want, docs = found
    doubled = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    got = order_minhash.deduplicated(doubled)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, None), (5, "x y z")], "doc_id long, text string")
    assert sorted((str(r[0]), r[3]) for r in order_minhash.near_duplicates(docs).collect()) == [("4", 2), ("5", 1), ("None", 1), ("None", 2)]
    assert sorted(str(r["doc_id"]) for r in order_minhash.deduplicated(docs).collect()) == ["4", "5", "None"]
    assert order_minhash.near_duplicates(docs.filter("doc_id < 0")).collect() == []
    assert order_minhash.deduplicated(docs.filter("doc_id < 0")).collect() == []


def edited(rng, w, n):
    """w with n words, at random places, changed or left out."""
    places = set(rng.sample(range(len(w)), n))
    return [f"n{rng.randint(0, 10**6)}" if i in places else x for i, x in enumerate(w) if i not in places or rng.random() < 0.5]


def share_found(spark, texts, others):
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + others)], "i int, t string")
    made = order_minhash.described(rows, "t", ["i"], order_minhash.K, order_minhash.SKETCHES, order_minhash.PICKED).orderBy("i").collect()
    return np.mean([any(x == y for x, y in zip(made[i]["sketches"], made[i + len(texts)]["sketches"], strict=True)) for i in range(len(texts))])


@pytest.mark.parametrize("rate, least", [(0.1, 1.0), (0.15, 0.99), (0.2, 0.98)])
@pytest.mark.parametrize("size", [10, 20, 100, 300])
def test_scattered_edits_up_to_the_limit_share_a_sketch(spark, rate, least, size):
    rng = random.Random(size)
    texts = [[f"w{rng.randint(0, 3000)}" for _ in range(size)] for _ in range(300)]
    others = [edited(rng, w, int(rate * size)) for w in texts]
    assert all(order_minhash.similar(np.array([hash(x) & 0xFFFFFFFF for x in a], np.uint32), np.array([hash(x) & 0xFFFFFFFF for x in b], np.uint32), 0.8) for a, b in zip(texts[:50], others, strict=False))
    assert share_found(spark, texts, others) >= least


def test_five_words_with_one_changed_share_a_sketch(spark):
    texts = [[f"w{5 * i + j}" for j in range(5)] for i in range(100)]
    for at in range(5):
        assert share_found(spark, texts, [[*w[:at], "other", *w[at + 1 :]] for w in texts]) >= 0.9


def test_every_fifth_word_changed_shares_a_sketch(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.randint(0, 3000)}" for _ in range(100)] for _ in range(300)]
    assert share_found(spark, texts, [[f"n{i}" if i % 5 == 2 else x for i, x in enumerate(w)] for w in texts]) >= 0.95


def test_very_long_texts(spark):
    rng = random.Random(11)
    words_ = [f"w{rng.randint(0, 5000)}" for _ in range(120_000)]
    texts = [words_, edited(rng, words_, 2000), [f"v{rng.randint(0, 5000)}" for _ in range(120_000)], ["same"] * 100_000, ["same"] * 90_000, ["same"] * 70_000]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_a_group_that_shares_a_passage_keeps_its_near_copies(spark):
    """Many documents share a long passage and nothing else; among them are pairs of near copies, which must be found."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage = say(70)
    texts = [say(40) + passage + say(40) for _ in range(400)]
    pairs = [edited(rng, t, int(0.08 * len(t))) for t in texts[:60]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + pairs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    found = sum(got[400 + i] == got[i] for i in range(60))
    assert found >= 57 and sum(got[i] == i for i in range(400)) == 400


def test_a_group_that_shares_a_passage_makes_no_row_for_each_pair(spark, monkeypatch):
    """300 texts with a passage in common and two near copies among them, which must be found without comparing 44,850 pairs as rows."""
    rng = random.Random(13)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage = say(70)
    texts = [say(40) + passage + say(40) for _ in range(300)]
    texts += [edited(rng, texts[i], 12) for i in (5, 9)]
    made, aligned = [], order_minhash.aligned
    monkeypatch.setattr(order_minhash, "aligned", lambda pairs, held, threshold: made.append(pairs.count()) or aligned(pairs, held, threshold))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()}
    assert [got[300], got[301]] == [5, 9] and all(got[i] == i for i in range(300))
    assert sum(made) <= 20_000


def family(rng, n):
    """Texts of a few families, some of them just at the limit."""
    base = [[rng.randint(0, 60) for _ in range(rng.choice([5, 30, 64, 130]))] for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, int(0.35 * len(w)))):
            i, r = rng.randrange(len(w)), rng.random()
            w[i : i + 1] = [rng.randint(0, 60)] if r < 0.4 else [] if r < 0.7 and len(w) > 2 else [w[i], rng.randint(0, 60)]
        out.append(np.array(w, np.uint32))
    return out


def test_common_runs_against_counters():
    texts = family(random.Random(2), 120)
    runs = [Counter(zip(["start", *w.tolist()], [*w.tolist(), "end"], strict=True)) for w in texts]
    want = np.array([[(a & b).total() for b in runs] for a in runs])
    got = order_minhash.common_runs(texts, np.arange(120), None)
    assert (np.triu(got, 1) == np.triu(want, 1)).all()
    one, two = np.arange(0, 120, 3), np.flatnonzero(np.arange(120) % 3)
    assert (order_minhash.common_runs(texts, one, two) == want[np.ix_(one, two)]).all()


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_pairs_aligned_at_once_as_one_by_one(threshold):
    rng = random.Random(6)
    texts = family(rng, 100)
    pairs = [(rng.randrange(100), rng.randrange(100)) for _ in range(3000)]
    assert order_minhash.all_similar(texts, pairs, threshold).tolist() == [order_minhash.similar(texts[a], texts[b], threshold) for a, b in pairs]


@pytest.mark.parametrize("sides", [False, True])
@pytest.mark.parametrize("threshold", [0.8, 0.4])
def test_groups_are_joined_as_by_all_pairs(threshold, sides):
    rng = random.Random(9)
    texts = family(rng, 150)
    side = np.array([rng.random() < 0.4 for _ in texts]) if sides else None

    def parts(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == s) for s in root}

    pairs = [(i, j) for i in range(150) for j in range(i) if (not sides or side[i] != side[j]) and order_minhash.similar(texts[i], texts[j], threshold)]
    found = order_minhash.found_within(texts, list(range(150)), side, threshold)
    assert parts(found) == parts(pairs) and len(found) < 150
