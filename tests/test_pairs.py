"""Results for pairs of a block, and that no plan makes the pairs where only their best are asked for."""

import difflib
import random

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import joins as J
from tidemark.operators import uncertainty as U


def rows_made(df):
    """The most rows that any operator of the executed plan gave out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_exact_tiers_make_no_pairs_and_ids_may_have_several_keys(spark):
    left = spark.createDataFrame([(i, "b", "n") for i in range(800)] + [(900, "b", "x"), (900, "b", "y"), (901, None, "x")], "id int, block string, name string")
    right = spark.createDataFrame([(i, "b", "n") for i in range(800)] + [(7, "b", "x"), (7, "b", "y"), (None, "b", "x")], "e int, block string, name string")
    out = J.tiers(left, right, [(1, "name", "name")], "block", "id", "e")
    got = {r["id"]: (r["n_candidates"], r["candidates"], r["e"]) for r in out.collect()}
    assert got == {i: (800, "0|1|2|3|4", None) for i in range(800)} | {900: (1, None, 7)}
    assert rows_made(out) < 10_000


def test_best_of_texts_is_best_of_all_pairs(spark):
    rng = random.Random(2)
    say = lambda: rng.choice([None, "".join(rng.choices("abc", k=rng.randint(1, 5)))]) if rng.random() < 0.2 else rng.choice(["abca", "abcb", "cab", "bbbb"])
    left = [(rng.randrange(25), rng.choice("xyz"), say()) for _ in range(40)] + [(90, "nulls", "a"), (91, None, "a")]
    right = [(rng.randrange(30), rng.choice("xy"), say()) for _ in range(60)] + [(90, "nulls", None), (91, "z", None), (92, "z", "abca")]
    a, b = spark.createDataFrame(left, "id int, block string, t string"), spark.createDataFrame(right, "e int, block string, t string")
    pairs = a.select("id", "block", F.col("t").alias("l")).join(b.select("e", "block", F.col("t").alias("r")), "block")
    for rule in ((0.75, 0.05, 5, 0.9), (0.3, 0.01, 20, None)):
        want = J.best_with_margin(X.sequence_ratio(pairs, "l", "r", "s"), "id", "e", "s", *rule)
        got = J.best_of_texts(a, b, "block", "id", "e", "t", X.sequence_ratio, *rule)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_best_of_texts_makes_no_pairs(spark):
    rows = [(i, "b", f"name {i % 3}") for i in range(700)]
    got = J.best_of_texts(spark.createDataFrame(rows, "id int, block string, t string"), spark.createDataFrame(rows, "e int, block string, t string"), "block", "id", "e", "t", X.sequence_ratio, 0.75, 0.05)
    assert {(r["score"], r["n_candidates"], r["ambiguous"]) for r in got.collect()} == {(1.0, 700, True)} and rows_made(got) < 10_000
    assert difflib.SequenceMatcher(None, "name 0", "name 1").ratio() < 1


def test_bigrams_as_bits_are_the_bigrams(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab", "b", "漢字漢", None, "aaaa", None] + ["".join(rng.choices("abcdefghijklmn 漢é", k=rng.randint(2, 14))) for _ in range(60)]
    texts += [t[1:5] for t in texts if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for words in (1, 8):
        p, similar = X.bigram_bits(rows, "t", words)
        structure, share = similar("l", "r")
        got = p.alias("l").join(p.alias("r"), F.col("l.k") < F.col("r.k")).select(F.col("l.t").alias("a"), F.col("r.t").alias("b"), structure.alias("s"), S.rounded_share(share).alias("g"))
        got = got.withColumns({"x": X.structure("a", "b"), "y": F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), S.rounded(X.bigram_jaccard("a", "b")))})
        assert got.count() == len(texts) * (len(texts) - 1) // 2 and got.filter("NOT s <=> x OR NOT g <=> y").collect() == []


def test_a_background_of_any_size_is_pinned(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") * 2)
    found = U.background_manifest(rows, ["id"], ["v"]).first().asDict()
    assert U.pinned_background(rows, found, ["id"], ["v"]).count() == 5000
