import re
from collections import defaultdict

from tidemark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows):
    by, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        by[r["source"]].append(r)
        sizes[r["source"]] += r["size"]
    goal = brute_targets(dict(sizes))
    for source, own in by.items():
        assert all(r["source_size"] == sizes[source] and abs(r["target"] - goal[source]) < 1e-6 * max(1, goal[source]) for r in own)
        assert all(r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in own)
        counts = {r["taken"] // r["size"] for r in own if r["size"]}
        assert not counts or max(counts) - min(counts) <= 1  # complete epochs come first
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - goal[source]) <= largest / 2 + 1e-6
    return goal


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i * 7 % 23) + " x", f"s{i % 5}" if i % 11 else None, 5) for i in range(400)]
    rows += [(None, None, None, 1), (None, "a b", "s1", 1), (7, "", "s2", 1), (7, "", "s2", 1), (8, "z\x0by\x1cq", "empty", 1), (9, None, "nothing", 1), (10, "long " * 3000, "s3", 1)]
    rows += [(5000 + i, "same text here", "s0", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs, buckets=16).collect()
    assert len(got) == len(rows)
    check(got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), buckets=16).collect()))


def test_sampled_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i) for i in range(10)] + [(99, "", "s", 1)], "doc_id long, text string, source string, size long")
    got = mixing.sampled(docs)
    assert got.columns == docs.columns and got.count() == 15
    assert all(r["size"] == r["doc_id"] for r in got.collect())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.sampled(docs).collect() == []


def test_heavier_rows_are_taken_more_often(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b", "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.mix(mixing.measure(docs).withColumn("__weight", F.when(F.col("doc_id") < 3000, 2.0).otherwise(0.5))).groupBy((F.col("doc_id") < 3000).alias("heavy"), "source").agg(F.avg("taken")).collect()
    b = {r[0]: r[2] for r in got if r[1] == "b"}
    assert b[True] > b[False] + 0.3


def test_label_weight_of_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "cde"), (None, "def")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert {r["text"]: r["__weight"] for r in mixing.label_weight(mixing.measure(docs), labels).collect()} == {"abc": 2.0, "bcd": 0.5, "cde": 1.0, "def": 1.0}


def test_many_sources_are_joined_by_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 60}") for i in range(500)], "doc_id long, text string, source string")
    assert sorted(map(str, mixing.mix(docs, small=5).collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_equal_rows_are_told_apart_at_the_edge(spark):
    rows = [(None, "a b c d", "y")] * 101 + [(i, "w " * (i % 5 + 1), "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    goal = check(got)
    taken = sorted(r["taken"] for r in got if r["source"] == "y")
    assert abs(sum(taken) - goal["y"]) <= 2 and len(set(taken)) == 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_no_range_of_keys_is_large_for_any_weight(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b", "s") for i in range(20_000)], "doc_id long, text string, source string")
    for weight in (1e-4, 0.25, 1.0, 2.0, 500.0):
        got = mixing.mix(mixing.measure(docs).withColumn("__weight", F.lit(weight))).collect()
        assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 1
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    for weight in (1e-4, 0.25, 500.0):
        sizes = spark.range(20_000).groupBy(F.floor(256 * F.log2(-F.log(u) / weight))).count().agg(F.max("count")).first()[0]
        assert sizes < 100
