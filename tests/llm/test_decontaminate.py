import hashlib
import random

from tidemark.llm import decontaminate, words

VOCABULARY = [f"w{i}" for i in range(30)] + ["ünï", "B2"]


def brute(texts, items, window=10):
    out = []
    for text in texts:
        w = words.split_words(text)
        hit, ids = set(), set()
        for item, t in items:
            v = words.split_words(t)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                part = v[k : k + window]
                for s in range(len(w) - len(part) + 1):
                    if w[s : s + len(part)] == part:
                        hit |= set(range(s, s + len(part)))
                        ids |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def make():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 6, 9, 10, 11, 14, 25]))) for i in range(12)] + [(3, "w1 w1"), (None, say(12)), (40, None), (41, ""), (42, " . ")]
    texts = [None, "", "...", items[0][1], "w1 w1 w1"]
    for _ in range(60):
        parts = [say(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 4)):
            v = rng.choice(items)[1] or ""
            v = v.split(" ")
            a = rng.randint(0, 3)
            parts += [" ".join(v[a : a + rng.randint(5, 25)]).upper().replace(" ", rng.choice([" ", ", ", "\n"])), say(rng.randint(0, 4))]
        texts.append(" ".join(parts))
    texts += texts[5:8]  # repeated rows
    return texts, items


def test_against_brute_force(spark):
    texts, items = make()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, n_words int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 7):
        got = decontaminate.digest(decontaminate.contamination(docs, benchmark, block=block)).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == brute(texts, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = docs.filter("doc_id < 0")
    items = none.withColumnRenamed("doc_id", "item_id")
    assert [tuple(r)[1:3] for r in decontaminate.digest(decontaminate.contamination(docs, items)).collect()] == [(2, 0)]
    assert decontaminate.digest(decontaminate.contamination(none, items)).collect() == []


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x " * 700_000 + "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digest(decontaminate.contamination(docs, items)).collect()] == [(700_003, 3, 1)]


def test_rows_of_one_id_stay_apart_for_any_size_of_blocks(spark):
    rows = [(1, "z a b c d e f g h i j k"), (1, "x a"), (None, "a b c d e f g h i j"), (None, "q"), (2, "m n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "m n"), (3, "x")], "item_id long, text string")
    want = sorted((str(r[0]), r[1], r[2], r[3]) for r in decontaminate.digest(decontaminate.contamination(docs, items)).collect())
    assert want == [("1", 2, 1, 1), ("1", 12, 11, 1), ("2", 2, 2, 1), ("None", 1, 0, 0), ("None", 10, 10, 1)]
    for block in (1, 2):
        got = decontaminate.digest(decontaminate.contamination(docs, items, block=block)).collect()
        assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
        assert decontaminate.uncontaminated(docs, items, block=block).count() == 1
