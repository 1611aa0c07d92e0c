import re
import time

from pyspark.sql import functions as F

from tidemark.llm import components, scratch


def joined(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in list(parent)}


def test_no_link_of_a_large_bucket_is_lost(spark):
    """700 nodes of one bucket, each near to one other only, which no order or draw tells; every pair must be found."""
    nodes = spark.range(700).select(F.col("id").alias("node"), F.lit(10).alias("size"), F.array(F.lit(7), F.xxhash64("id")).alias("sketches"))
    partner = (F.col("a") * 0 + 699 - F.col("a")) == F.col("b")
    got = components.linked(nodes, lambda ids: ids.select(F.col("x").alias("node")), lambda pairs, _: pairs.filter(partner).select("a", "b"), lambda a, b: F.lit(True))
    assert {r["node"]: r["root"] for r in got.collect()} == joined([(i, 699 - i) for i in range(350)])


def test_pairs_between_parts_are_all_and_once(spark):
    rows = [(s, i, i % 5 + 1, i % 3 if s == 1 else 0) for s in (1, 2) for i in range(23)]
    members = spark.createDataFrame(rows, "sketch int, node int, size int, root int")
    got = sorted(map(tuple, components.between(members, lambda a, b: F.abs(a - b) < 3, part=4).collect()))
    assert got == [(a, b) for a in range(23) for b in range(a + 1, 23) if a % 3 != b % 3 and abs(a % 5 - b % 5) < 3]


def test_pairs_of_small_buckets_are_compared_once(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"), F.lit(10).alias("size"), F.array(F.col("id") % 8, F.lit(-1) - F.col("id")).alias("sketches"))
    compared = []

    def near(pairs, _):
        compared.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.filter("a + b = 20").select("a", "b")

    got = components.linked(nodes, lambda ids: ids.select(F.col("x").alias("node")), near, lambda a, b: F.lit(True))
    assert {r["node"]: r["root"] for r in got.collect()} == joined([(a, 20 - a) for a in range(10) if (20 - 2 * a) % 8 == 0])
    assert len(compared) == len(set(compared)) and {(a, 20 - a) for a in (2, 6)} <= set(compared)


def test_facts_in_place_of_sizes(spark):
    nodes = spark.range(30).select(F.col("id").alias("node"), F.array(F.lit(3)).alias("sketches"))
    facts = nodes.select("node", F.struct((F.col("node") % 3).alias("kind")).alias("size"))
    got = components.linked(nodes, lambda ids: ids.select(F.col("x").alias("node")), lambda pairs, _: pairs, lambda a, b: a["kind"] == b["kind"], facts=facts)
    assert {r["node"]: r["root"] for r in got.collect()} == {i: i % 3 for i in range(30)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllFiles().mkString(",")))
    before, set_before = shuffled(), spark.conf.get(scratch.CLEANED, None)
    out = scratch.table(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n")), "summed")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(scratch.CLEANED, None) == set_before
