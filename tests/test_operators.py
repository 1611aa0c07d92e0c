"""Rules of operators that SQL can't express, or that must stop a run."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import geo as G
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import prep as P
from tidemark.operators import review as V
from tidemark.operators import serving as SV
from tidemark.operators import uncertainty as U
from tidemark.sources import tables as T
from tidemark.sources import writers


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_shared_area_of_any_rings():
    notch = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]
    bar = [(-1, 5), (11, 5), (11, 7), (-1, 7), (-1, 5)]
    n = 400
    cell = 12 / n
    counted = sum(inside(notch, -1 + (i + 0.5) * cell, -1 + (j + 0.5) * cell) and inside(bar, -1 + (i + 0.5) * cell, -1 + (j + 0.5) * cell) for i in range(n) for j in range(n)) * cell * cell
    for a, b in ((notch, bar), (notch[::-1], bar), (bar, notch[::-1])):
        assert G.shared_area(a, b) == pytest.approx(10) and abs(counted - 10) < 0.1
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert G.shared_area(square, square) == pytest.approx(16)
    assert G.shared_area(square, [(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)]) == pytest.approx(0)


def test_overlaps_of_polygons_are_not_those_of_their_boxes(spark):
    at = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    areas = spark.createDataFrame([(1, at([(0, 0), (10, 0), (0, 10), (0, 0)])), (2, at([(10, 10), (0, 10), (10, 0), (10, 10)])), (3, at([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]))], "code long, ring array<struct<x:double,y:double>>")
    got = {(r["code_a"], r["code_b"]): round(r["overlap"], 6) for r in G.overlaps(areas, 5.0, 0.5).collect()}
    assert got == {(1, 3): 16.0}


def test_projection_there_and_back(spark):
    rows = spark.createDataFrame([(190000.0 + 1000 * i, 440000.0 + 2000 * j) for i in range(5) for j in range(5)] + [(None, 1.0), (0.0, 5.0)], "x double, y double")
    out = G.standard_coordinates(rows, "x", "y").collect()
    good = {(r["x"], r["y"]): (r["x_std"], r["y_std"]) for r in out if not r["coord_missing"]}
    assert sum(r["coord_missing"] for r in out) == 2 and len(good) == 25
    for (x, y), (u, v) in good.items():
        if (x + 1000, y) in good:  # a step of a kilometre stays one but for the scales of the two grids
            a, b = good[(x + 1000, y)]
            assert abs(math.hypot(a - u, b - v) - 1000) < 1
    hall = G.shifted_datum(G.geographic(spark.createDataFrame([(197987.0, 451580.0)], "x double, y double"), "x", "y")).first()
    assert abs(hall["_lon"] - 126.9780) < 1e-4 and abs(hall["_lat"] - 37.5665) < 1e-4
    lon = spark.createDataFrame([(127.0, 37.5)], "lon double, lat double")
    x, y = G.transverse_mercator(F.col("lon"), F.col("lat"))
    plane = lon.select(x.alias("x"), y.alias("y"))
    back = G.geographic(plane, "x", "y", G.A, G.INVERSE_F, G.LAT0, G.LON0, G.K0, (G.FALSE_E, G.FALSE_N)).first()
    assert abs(back["_lon"] - 127.0) < 1e-9 and abs(back["_lat"] - 37.5) < 1e-9


def isotonic(points):
    """Least-squares monotone fit by the largest mean of lower sets, for small tables."""
    values = [y for _, y in points]
    n = len(values)
    return [max(min(sum(values[i : j + 1]) / (j + 1 - i) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_venn_abers_against_fits_by_definition(spark):
    rng = random.Random(3)
    cal = sorted((round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(40))
    cal = list({s: (s, y) for s, y in cal}.values())
    rows = spark.createDataFrame([(s, y) for s, y in cal], "p double, y int")
    got = {r["p"]: (r["p_low"], r["p_high"]) for r in U.venn_abers(rows, rows, points=400).collect()}
    for s, _ in cal:
        for label, k in ((0, 0), (1, 1)):
            # the added row shares the score of one that is there: both are one point with their mean, twice as heavy
            points = sorted([(a, float(b)) for a, b in cal] + [(s, float(label))])
            merged = []
            for a, b in points:
                if merged and merged[-1][0] == a:
                    merged[-1][1].append(b)
                else:
                    merged.append((a, [b]))
            flat = [(a, sum(b) / len(b)) for a, b in merged for _ in b]
            fit = isotonic(flat)
            assert got[s][k] == pytest.approx([f for (a, _), f in zip(flat, fit, strict=True) if a == s][0], abs=1e-9)


def test_calibration_in_the_large(spark):
    rng = random.Random(5)
    rows = [(p := rng.uniform(0.02, 0.6), int(rng.random() < 1 / (1 + math.exp(-(0.5 + 0.7 * math.log(p / (1 - p))))))) for _ in range(6000)]
    slope, a = U.calibration_slope(spark.createDataFrame([(y, p) for p, y in rows], "y int, p double"))
    assert abs(slope - 0.7) < 0.12
    assert abs(sum(1 / (1 + math.exp(-(math.log(p / (1 - p)) + a))) for p, _ in rows) / len(rows) - sum(y for _, y in rows) / len(rows)) < 1e-4


def test_a_calibration_is_chosen_only_if_it_is_better_beyond_chance(spark):
    rows = spark.createDataFrame([(i % 200, int(i % 10 < 2), 0.6) for i in range(2000)], "cluster long, y int, p double")
    good, same = lambda d: d.withColumn("p_cal", F.lit(0.2)), lambda d: d.withColumn("p_cal", F.col("p") - 1e-9 * F.pow(F.lit(-1), F.col("cluster")))
    assert U.choose_calibration(rows, {"flat": good}, "cluster", replicates=30)[0] == "flat"
    assert U.choose_calibration(rows, {"same": same}, "cluster", replicates=30)[0] == "raw"


def test_refitted_intervals_hold_their_mean(spark):
    rows = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3)) for i in range(140)], "id long, x double, y int")
    fit = lambda tr, w: (lambda m: lambda d: d.withColumn("p", F.lit(m) + F.col("x") / 100))(tr.agg(F.sum(F.col(w) * F.col("y")) / F.sum(w)).first()[0])
    out = U.refit_interval(rows, rows, fit, "id", refits=9).collect()
    assert all(r["p_low"] <= r["p_mean"] <= r["p_high"] for r in out) and out[0]["p_low"] < out[0]["p_high"]


def test_quota_carries_to_the_next_band(spark):
    rows = spark.createDataFrame([(i, "low" if i < 3 else "mid" if i < 10 else "high") for i in range(100)], "id long, band string")
    got = V.banded_quota(rows, "band", {"low": 5, "mid": 6, "high": 10}, "id").groupBy("band").count().collect()
    assert {r[0]: r[1] for r in got} == {"low": 3, "mid": 7, "high": 11}


def test_representatives_are_rows_and_weights_are_whole(spark):
    rows = spark.createDataFrame([(i, float(i // 10), float(i % 3)) for i in range(60)], "id long, a double, b double")
    out = V.nearest_to_centres(rows, ["a", "b"], "id", 6).collect()
    assert sum(r["weight"] for r in out) == 60 and len({r["id"] for r in out}) == len(out)


@pytest.mark.parametrize("broken", [
    lambda s: P.numeric(s.createDataFrame([("12x",)], "v string"), ["v"]),
    lambda s: P.yes_no(s.createDataFrame([("3",)], "v string"), ["v"]),
    lambda s: P.tenure(s.createDataFrame([(1200, 1)], "y int, m int"), "y", "m", (2024, 1), 1900, 1950, 2024),
    lambda s: P.output_columns(s.range(1), ["nothing"]),
    lambda s: P.expected(s.range(3), 4),
    lambda s: P.feature_set(["a"], {}, {}, []),
    lambda s: T.selected(s, writers.stored(s.range(3), "t"), ["nothing"]),
    lambda s: T.score_panel(s.createDataFrame([("a", 1, 0), ("b", 1, 0)], "origin string, store_id int, label int"), "label"),
    lambda s: T.policies(s.createDataFrame([("p", 5, 4)], "policy_id string, min_age int, max_age int")),
    lambda s: T.monthly_mentions(s.createDataFrame([("x", 1, "2024-01", 2), ("x", 1, "2024-01", 3)], "platform string, store_id int, month string, mention_count int"), "x"),
    lambda s: T.labelled_sample(s.createDataFrame([(1, 5)], "row_id int, store_id int"), s.createDataFrame([(1, 6, "x")], "row_id int, store_id int, label string")),
    lambda s: J.aligned(s.range(3), s.range(4), ["id"]),
    lambda s: J.flagged(s.range(3), s.createDataFrame([(1, True)], "id long, f boolean"), "f", [["id"]]),
    lambda s: SV.private_path("a/public/x", ["outputs/private"]),
    lambda s: SV.selection_outputs(s.range(1), "id", "id", [], ["id"]),
    lambda s: U.pinned_background(s.range(5), {"n_rows": 4, "keys_sha256": "", "rows_sha256": ""}, ["id"], []),
])
def test_what_must_stop_a_run(spark, broken):
    with pytest.raises(C.ContractError):
        broken(spark).collect()


def test_a_number_that_can_not_be_read_stops_a_strict_cast(spark):
    rows = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="v: x"):
        rows.select(T.strict("v", "double")).collect()


def test_bounds_with_open_ends(spark):
    rows = spark.createDataFrame([("2024-01-05", "2024-01-01", None), ("2024-01-05", None, "2024-01-04"), (None, None, None)], "d string, lower string, upper string")
    assert [r[0] for r in rows.select(P.within_bounds("d")).collect()] == [True, False, False]


def test_auc_difference_of_a_score_with_itself_is_none(spark):
    rows = spark.createDataFrame([(i, i / 500, int(i % 3 == 0)) for i in range(500)], "c long, p double, y int")
    out = U.auc_difference(rows, "p", "p", "y", "c", 10).first()
    assert out["difference"] == out["low"] == out["high"] == 0
    assert M.ranking(rows).first()["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in range(0, 500, 3) for b in range(500) if b % 3) / (167 * 333), abs=1e-3)


def test_quantiles_and_ranks_of_ranges(spark):
    from tidemark.operators.order import mean_ranks, quantiles

    rng = random.Random(9)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, 0.25, None])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    rows = spark.createDataFrame(data, "g string, v double")
    shares = [0, 0.001, 0.1, 0.5, 0.77, 0.999, 1]
    got = {r["g"]: r["q"] for r in quantiles(rows, "v", shares, ["g"]).collect()}

    def exact(values, s):
        values, place = sorted(values), s * (len(values) - 1)
        a, b = values[math.floor(place)], values[math.ceil(place)]
        return a * (1 - (place - math.floor(place))) + b * (place - math.floor(place))

    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        assert q == pytest.approx([exact([v for h, v in data if h == g and v is not None], s) for s in shares])
    whole = [v for _, v in data if v is not None]
    assert quantiles(rows, "v", [i / 50 for i in range(51)]).first()["q"] == pytest.approx([exact(whole, i / 50) for i in range(51)])
    ranks = {r["v"]: r["k"] for r in mean_ranks(rows, "v", "k").collect()}
    order = sorted(whole)
    assert ranks[None] is None and all(ranks[v] == pytest.approx(order.index(v) + (order.count(v) + 1) / 2) for v in set(whole))
