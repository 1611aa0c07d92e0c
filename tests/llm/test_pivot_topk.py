import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pivot_topk


def brute(rows, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = set()
    for i, q in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        near = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out |= {(i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(near)}
    return out


def rows():
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(1500)]
    out += [(2000 + i, centres[0]) for i in range(700)]  # a hot group, with queries in it
    out += [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5100, [float("inf")] + [0.0] * 7), (None, centres[1]), (5200, []), (5300, [1.0]), (5400, [0.0] * 8), (5003, [1e30] * 8), (300, centres[2])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in out]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<float>, score int")
    for options in ({}, {"row_block": 300, "query_block": 4}, {"pivots": 3, "k": 4}):
        got = pivot_topk.top_k(df, F.col("id") % 100 == 0, **options)
        assert {tuple(r) for r in got.collect()} == brute(data, options.get("k", 10))


def test_numbers_of_an_integer_keep_its_order():
    values = sorted({s * (1 << b) + d for b in (0, 5, 61, 62, 63, 124, 125, 700, 2100) for s in (-1, 1) for d in (-1, 0, 1)})
    assert [pivot_topk.limbs(v) for v in values] == sorted(pivot_topk.limbs(v) for v in values)
    assert all(-(2**63) <= x < 2**63 for v in values for x in pivot_topk.limbs(v))


def test_large_components_take_part(spark):
    rng = random.Random(6)
    data = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 0, 0, 3, 5, 9, 20, 38]) for _ in range(4)]) for i in range(250)]
    data += [(300, [300000.0, 1.0]), (301, [262143.9, 262144.0]), (302, [1024.0]), (303, [-1024.0]), (304, [1023.999])]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in data]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for options in ({}, {"row_block": 40, "query_block": 2}):
        got = pivot_topk.top_k(df, F.col("id") % 100 == 0, **options)
        assert {tuple(r) for r in got.collect()} == brute(data, 10)


def test_queries_are_not_sent_to_far_clusters():
    rng = np.random.default_rng(3)
    centres = np.eye(6) * 5000
    x = np.rint(np.concatenate([rng.normal(0, 5, (200, 6)) + c for c in centres]))
    p = pivot_topk.Pivots(np.arange(0, 1200, 10), x[::10], float((x**2).sum(1).max()))
    far = p.distances(x, False)
    near = far.argmin(1)
    clusters = [pivot_topk.Cluster(j, int((near == j).sum()), far[near == j].min(0), far[near == j].max(0)) for j in np.unique(near)]
    ids = np.arange(1, 1200, 100)
    may = pivot_topk.routed(x[ids], ids, p, clusters, 10)
    assert may.mean() < 0.5
    for i, q in enumerate(ids):
        best = sorted((-(x[q] @ v), j) for j, v in enumerate(x) if j != q)[:10]
        assert all(may[i][[c.number for c in clusters].index(near[j])] for _, j in best)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_topk.top_k(df, F.col("id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert pivot_topk.top_k(df.filter("vec_id > 5"), F.col("id") % 100 == 0).collect() == []


def test_bounds_leave_out_far_rows():
    rng = np.random.default_rng(1)
    x = np.rint(np.concatenate([rng.normal(0, 5, (3000, 4)) + c for c in ([900, 0, 0, 0], [-900, 0, 0, 0])]))
    p = pivot_topk.Pivots(np.arange(0, 6000, 500), x[::500], float((x**2).sum(1).max()))
    seen = []
    x2 = x.view(type("Seen", (np.ndarray,), {"__getitem__": lambda s, k: (seen.append(np.size(k)) if isinstance(k, np.ndarray) else None, np.ndarray.__getitem__(s, k))[1]}))
    assert len(list(pivot_topk.best_of_block(np.arange(6000), x2, p.distances(x, False), x[:1], np.array([0]), p, 10))) == 1
    assert sum(seen) < 6000
