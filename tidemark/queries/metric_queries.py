"""Ranking, calibration, interval, peer, window and model queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import peers as E
from tidemark.operators.order import quantiles
from tidemark.queries.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: S.rounded(c, digits) for c in columns})


@query(
    "m02_ranking",
    """WITH g AS (SELECT l_linestatus, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY l_linestatus ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER (PARTITION BY l_linestatus ORDER BY p DESC) / sum(n) OVER (PARTITION BY l_linestatus ORDER BY p DESC) AS pr FROM g), t AS (SELECT l_linestatus, sum(n) AS n, sum(pos) AS e, sum(pos * (below + (n - pos) / 2)) AS pairs, sum(pos * pr) AS ap FROM w GROUP BY 1)
    SELECT l_linestatus, n::BIGINT AS n, e::BIGINT AS events, round_even(e / n, 6) AS base_rate, round_even(pairs / (e * (n - e)), 6) AS auc, round_even(ap / e, 6) AS ap, round_even(ap / e / (e / n), 6) AS ap_lift FROM t""",
)
def ranking(t):
    return rounded(M.ranking(t.scored(), ["l_linestatus"]), "base_rate", "auc", "ap", "ap_lift")


_BINS = "e AS (SELECT list_distinct(quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS l FROM scored), ed AS (SELECT list_sort(l) AS edges FROM e), b AS (SELECT y, p, edges, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= p)) + 1 AS bin FROM scored, ed), rt AS (SELECT bin, count(*) AS n, avg(p) AS pm, avg(y) AS o, any_value(edges) AS edges FROM b GROUP BY 1)"


@query("m03_reliability", f"WITH {_BINS} SELECT bin, n, round_even(pm, 6) AS pred_mean, round_even(o, 6) AS obs_rate, round_even(edges[bin], 6) AS p_low, round_even(edges[bin + 1], 6) AS p_high, round_even(pm - o, 6) AS gap FROM rt")
def reliability(t):
    return rounded(M.reliability(t.scored()), "pred_mean", "obs_rate", "p_low", "p_high", "gap")


@query("m03_calibration_error", f"WITH {_BINS} SELECT round_even(sum(n * abs(pm - o)) / sum(n), 6) AS ece, count(*) AS n_bins FROM rt")
def ece(t):
    return rounded(M.calibration_error(M.reliability(t.scored())), "ece")


@query("g05_brier_log_loss", "SELECT origin_no, round_even(avg((p - y) * (p - y)), 6) AS brier, round_even(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, count(*) AS n FROM scored GROUP BY 1")
def losses(t):
    return t.scored().groupBy("origin_no").agg(S.rounded(M.brier("y", "p")).alias("brier"), S.rounded(M.log_loss("y", "p")).alias("log_loss"), F.count("*").alias("n"))


@query("g06_recalibration", "SELECT DISTINCT p, round_even(1 / (1 + exp(-(0.1 + 0.8 * ln(p / (1 - p))))), 6) AS p_new, round_even(ln(p / (1 - p)), 6) AS logit FROM scored")
def recalibration(t):
    return t.scored().select("p").distinct().select("p", S.rounded(M.recalibrated("p", 0.1, 0.8)).alias("p_new"), S.rounded(M.logit("p")).alias("logit"))


_GRID = ", ".join(repr(0.5 + 0.495 * i / 199) for i in range(200))


@query(
    "m14_cutoffs",
    f"""WITH b AS (SELECT avg(y) AS base, list_sort(list_distinct(quantile_cont(p, [{_GRID}]))) AS grid, quantile_cont(p, 0.95) AS fb FROM scored), c AS (SELECT unnest(grid) AS cut FROM b),
    a AS (SELECT cut, count(*) AS n, avg(y) AS r FROM c JOIN scored ON p >= cut GROUP BY 1), f AS (SELECT min(cut) FILTER (n >= 200 AND r >= 1.01 * base) AS found, any_value(base) AS base, any_value(fb) AS fb FROM a, b)
    SELECT round_even(base, 6) AS base_rate, round_even(coalesce(found, fb), 6) AS cut_high, round_even(CASE WHEN 1.2 * base >= coalesce(found, fb) THEN base ELSE 1.2 * base END, 6) AS cut_mid, found IS NULL AS high_fallback, 1.2 * base >= coalesce(found, fb) AS mid_fallback FROM f""",
)
def cutoffs(t):
    return rounded(M.cutoffs(t.scored(), high_lift=1.01), "base_rate", "cut_high", "cut_mid")


_BAND = "CASE WHEN p >= 0.4 THEN 'high' WHEN p >= 0.25 THEN 'mid' ELSE 'low' END"


@query("a36_band_profile", f"WITH g AS (SELECT {_BAND} AS band, count(*) AS n, avg(p) AS pm, avg(y) AS o, sum(y) AS e FROM scored GROUP BY 1) SELECT band, n, round_even(n / sum(n) OVER (), 6) AS share, round_even(pm, 6) AS p_mean, round_even(o, 6) AS obs_rate, round_even(o / (sum(e) OVER () / sum(n) OVER ()), 6) AS lift FROM g")
def profile(t):
    return rounded(M.band_profile(t.scored().withColumn("band", M.band("p", F.lit(0.25), F.lit(0.4)))), "share", "p_mean", "obs_rate", "lift")


@query("m15_bands_by_origin", f"SELECT origin_no, {_BAND} AS band, count(*) AS n, sum(y)::BIGINT AS events FROM scored GROUP BY 1, 2")
def bands(t):
    return t.scored().groupBy("origin_no", M.band("p", F.lit(0.25), F.lit(0.4)).alias("band")).agg(F.count("*").alias("n"), F.sum("y").alias("events"))


@query(
    "m16_lift_crossings",
    """WITH d AS (SELECT floor(p * 20) AS k, count(*) AS n, sum(y) AS e FROM scored GROUP BY 1), c AS (SELECT k, sum(n) OVER w AS n, sum(e) OVER w AS e FROM d WINDOW w AS (ORDER BY k DESC)), l AS (SELECT k, e / n / (SELECT sum(e) / sum(n) FROM d) >= 1 AS above FROM c WHERE n >= 50),
    x AS (SELECT k, above, lag(above) OVER (ORDER BY k) AS b FROM l) SELECT count(*) FILTER (above <> b) AS crossings, count(*) FILTER (above) AS n_above, count(*) AS n_cuts FROM x""",
)
def crossings(t):
    return M.lift_crossings(t.scored(), 20)


@query("m09_cluster_bootstrap")
def bootstrap(t):
    high = (F.col("p") >= 0.4).cast("int")
    sums = {"n": F.count("*"), "e": F.sum("y"), "nh": F.sum(high), "eh": F.sum(high * F.col("y"))}
    return rounded(M.cluster_bootstrap(t.scored(), "cluster", sums, (F.col("eh") / F.nullif(F.col("nh"), F.lit(0))) / (F.col("e") / F.col("n"))), "q2_5", "q50", "q97_5")


@query("m10_poisson_weights")
def poisson(t):
    w = t.spark.range(20000).select(M.hashed_poisson(F.lit(1), F.col("id")).alias("w"))
    return w.groupBy("w").agg(F.count("*").alias("n"))


_Z = "1.96"


def _wilson(k, n):
    return f"({k} / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})", f"{_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n})"


@query("a37_wilson", f"WITH g AS (SELECT cluster, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM scored GROUP BY 1) SELECT cluster, round_even({_wilson('k', 'n')[0]} - {_wilson('k', 'n')[1]}, 6) AS low, round_even({_wilson('k', 'n')[0]} + {_wilson('k', 'n')[1]}, 6) AS high FROM g")
def wilson(t):
    g = t.scored().groupBy("cluster").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("cluster", S.rounded(low).alias("low"), S.rounded(high).alias("high"))


@query(
    "a37_newcombe",
    f"""WITH g AS (SELECT origin_no, sum(y) FILTER (l_linestatus = 'F')::DOUBLE AS k1, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS n1, sum(y) FILTER (l_linestatus = 'O')::DOUBLE AS k2, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS n2 FROM scored GROUP BY 1),
    w AS (SELECT *, {_wilson('k1', 'n1')[0]} - {_wilson('k1', 'n1')[1]} AS l1, {_wilson('k1', 'n1')[0]} + {_wilson('k1', 'n1')[1]} AS u1, {_wilson('k2', 'n2')[0]} - {_wilson('k2', 'n2')[1]} AS l2, {_wilson('k2', 'n2')[0]} + {_wilson('k2', 'n2')[1]} AS u2, k1 / n1 AS p1, k2 / n2 AS p2 FROM g WHERE n1 > 0 AND n2 > 0)
    SELECT origin_no, round_even(p1 - p2, 6) AS difference, round_even(p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), 6) AS low, round_even(p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2)), 6) AS high FROM w""",
)
def newcombe(t):
    f, o = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    g = t.scored().groupBy("origin_no").agg(F.sum(F.when(f, F.col("y"))).alias("k1"), F.count_if(f).alias("n1"), F.sum(F.when(o, F.col("y"))).alias("k2"), F.count_if(o).alias("n2")).filter("n1 > 0 AND n2 > 0")
    d, low, high = M.newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return g.select("origin_no", S.rounded(d).alias("difference"), S.rounded(low).alias("low"), S.rounded(high).alias("high"))


def _smd(w):
    return f"""WITH l AS (SELECT (o_orderpriority = '1-URGENT')::INT AS t, {w} AS w, v.variable, v.x FROM (SELECT *, unnest([{{'variable': 'o_totalprice', 'x': o_totalprice}}, {{'variable': 'o_custkey', 'x': o_custkey::DOUBLE}}]) AS v FROM orders)),
    a AS (SELECT variable, t, sum(w * x) / sum(w) AS m, greatest(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 0) * count(*) / greatest(count(*) - 1, 1) AS s2 FROM l GROUP BY 1, 2)
    SELECT variable, round_even(max(m) FILTER (t = 1), 3) AS mean_treated, round_even(max(m) FILTER (t = 0), 3) AS mean_control, round_even((max(m) FILTER (t = 1) - max(m) FILTER (t = 0)) / sqrt((max(s2) FILTER (t = 1) + max(s2) FILTER (t = 0)) / 2), 5) AS smd,
    abs((max(m) FILTER (t = 1) - max(m) FILTER (t = 0)) / sqrt((max(s2) FILTER (t = 1) + max(s2) FILTER (t = 0)) / 2)) > 0.1 AS imbalanced FROM a GROUP BY 1"""


def arms(t):
    return t.orders.select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("t"), "o_totalprice", "o_custkey", (1 + F.col("o_orderkey") % 4).cast("double").alias("w"))


@query("a30_covariate_balance", _smd("1.0"))
def balance(t):
    out = M.smd(arms(t), "t", ["o_totalprice", "o_custkey"])
    return rounded(rounded(out, "mean_treated", "mean_control", digits=3), "smd", digits=5)


@query("a33_weighted_balance", _smd("(1 + o_orderkey % 4)::DOUBLE"))
def weighted_balance(t):
    out = M.smd(arms(t), "t", ["o_totalprice", "o_custkey"], "w")
    return rounded(rounded(out, "mean_treated", "mean_control", digits=3), "smd", digits=5)


@query("a31_weighted_means", "SELECT o_orderstatus, round_even(avg(o_totalprice), 3) AS plain, round_even(sum((1 + o_orderkey % 4) * o_totalprice) / sum(1 + o_orderkey % 4), 3) AS weighted, round_even(pow(sum(1 + o_orderkey % 4), 2) / sum((1 + o_orderkey % 4) * (1 + o_orderkey % 4)), 4) AS effective_n FROM orders GROUP BY 1")
def weighted_means(t):
    w = (1 + F.col("o_orderkey") % 4).cast("double")
    o = t.orders.withColumn("w", w)
    return o.groupBy("o_orderstatus").agg(S.rounded(F.avg("o_totalprice"), 3).alias("plain"), S.rounded(F.sum(w * F.col("o_totalprice")) / F.sum(w), 3).alias("weighted"), S.rounded(M.effective_size("w"), 4).alias("effective_n"))


@query("a32_association", "SELECT round_even(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def association(t):
    return t.lineitem.agg(S.rounded(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.count("*").alias("n"))


@query("a34_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2 AS a, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2 AS b FROM supplier) SELECT round_even(corr(a, b), 6) AS spearman, count(*) AS n FROM r")
def spearman(t):
    return rounded(M.spearman(t.supplier, "s_acctbal", "s_nationkey"), "spearman")


@query("a34_eta_squared", "WITH m AS (SELECT avg(c_acctbal) AS m FROM customer), g AS (SELECT c_mktsegment, avg(c_acctbal) AS gm, count(*) AS n FROM customer GROUP BY 1) SELECT (SELECT count(*) FROM customer) AS n, round_even((SELECT sum(n * (gm - m) * (gm - m)) FROM g, m) / (SELECT sum((c_acctbal - m) * (c_acctbal - m)) FROM customer, m), 6) AS eta_squared")
def eta(t):
    return rounded(M.eta_squared(t.customer, "c_mktsegment", "c_acctbal"), "eta_squared")


@query("p08_winsorised", "WITH l AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round_even(greatest(least(c_acctbal, hi), lo), 6) AS c_acctbal_w, c_acctbal < lo OR c_acctbal > hi AS c_acctbal_outlier FROM customer, l")
def winsorised(t):
    return rounded(M.winsorised(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal"), "c_acctbal_w")


@query("g07_normalised_weights", "SELECT c_custkey, round_even((1 + c_custkey % 5) / avg(1 + c_custkey % 5) OVER (), 6) AS w FROM customer")
def normalised(t):
    raw = (1 + F.col("c_custkey") % 5).cast("double")
    mean = t.customer.agg(F.avg(raw).alias("m"))
    return t.customer.crossJoin(F.broadcast(mean)).select("c_custkey", S.rounded(raw / F.col("m")).alias("w"))


@query("a17_distance_quantiles", "SELECT c_mktsegment, round_even(quantile_cont(c_acctbal, 0.5), 4) AS p50, round_even(quantile_cont(c_acctbal, 0.9), 4) AS p90, count(*) FILTER (c_acctbal <= 0) AS n_0, count(*) FILTER (c_acctbal <= 3000) AS n_3000, count(*) FILTER (c_acctbal <= 6000) AS n_6000 FROM customer GROUP BY 1")
def distances(t):
    b = F.col("c_acctbal")
    q = quantiles(t.customer, "c_acctbal", [0.5, 0.9], ["c_mktsegment"]).select("c_mktsegment", *[S.rounded(F.get("q", F.lit(k)), 4).alias(n) for k, n in enumerate(("p50", "p90"))])
    return t.customer.groupBy("c_mktsegment").agg(*[F.count_if(b <= v).alias(f"n_{v}") for v in (0, 3000, 6000)]).join(q, "c_mktsegment")


@query("a26_subgroups", "WITH r AS (SELECT y, p, unnest([{'dim': 'status', 'grp': l_linestatus}, {'dim': 'origin', 'grp': origin_no::VARCHAR}, {'dim': 'all', 'grp': 'all'}]) AS g FROM scored) SELECT g.dim AS dim, g.grp AS grp, count(*) AS n, sum(y)::BIGINT AS events, round_even(avg(y), 6) AS rate, round_even(avg(p) - avg(y), 6) AS gap, round_even(avg((p >= 0.4)::INT), 6) AS high_share FROM r GROUP BY 1, 2")
def subgroups(t):
    g = F.explode(F.array(F.struct(F.lit("status").alias("dim"), F.col("l_linestatus").alias("grp")), F.struct(F.lit("origin").alias("dim"), F.col("origin_no").cast("string").alias("grp")), F.struct(F.lit("all").alias("dim"), F.lit("all").alias("grp"))))
    return t.scored().withColumn("g", g).groupBy("g.dim", "g.grp").agg(F.count("*").alias("n"), F.sum("y").alias("events"), S.rounded(F.avg("y")).alias("rate"), S.rounded(F.avg("p") - F.avg("y")).alias("gap"), S.rounded(F.avg((F.col("p") >= 0.4).cast("int"))).alias("high_share"))


@query("a27_rate_gap", "WITH g AS (SELECT origin, avg((area > 100000)::INT) FILTER (event_12m = 1) AS e, avg((area > 100000)::INT) FILTER (event_12m = 0) AS n FROM panel GROUP BY 1) SELECT origin, round_even(e, 6) AS rate_event, round_even(n, 6) AS rate_none, round_even(e - n, 6) AS gap FROM g")
def gap(t):
    has, e = (F.col("area") > 100000).cast("int"), F.col("event_12m")
    g = t.panel().groupBy("origin").agg(F.avg(F.when(e == 1, has)).alias("rate_event"), F.avg(F.when(e == 0, has)).alias("rate_none"))
    return rounded(g.withColumn("gap", F.col("rate_event") - F.col("rate_none")), "rate_event", "rate_none", "gap")


@query("a35_expanding_base_rate", "WITH g AS (SELECT origin_no, sum(event_12m) AS e, count(*) AS n FROM panel GROUP BY 1) SELECT origin_no, round_even(e / n, 6) AS rate, round_even(sum(e) OVER w / sum(n) OVER w, 6) AS train_rate FROM g WINDOW w AS (ORDER BY origin_no RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)")
def expanding(t):
    g = t.panel().groupBy("origin_no").agg(F.sum("event_12m").alias("e"), F.count("*").alias("n"))
    w = W.orderBy("origin_no").rangeBetween(W.unboundedPreceding, -5)
    return g.select("origin_no", S.rounded(F.col("e") / F.col("n")).alias("rate"), S.rounded(F.sum("e").over(w) / F.sum("n").over(w)).alias("train_rate"))


@query("a28_missing_vs_outcome", "SELECT round_even(avg(event_12m) FILTER (area < 100000), 6) AS rate_small, round_even(avg(event_12m) FILTER (area >= 100000), 6) AS rate_large, round_even(avg((area < 100000)::INT) FILTER (event_12m = 1), 6) AS small_of_events FROM panel")
def outcome(t):
    e, small = F.col("event_12m"), F.col("area") < 100000
    return t.panel().agg(S.rounded(F.avg(F.when(small, e))).alias("rate_small"), S.rounded(F.avg(F.when(~small, e))).alias("rate_large"), S.rounded(F.avg(F.when(e == 1, small.cast("int")))).alias("small_of_events"))


_SHARE = "(rank() OVER (PARTITION BY {by} ORDER BY area) + (count(*) OVER (PARTITION BY {by}, area) - 1) / 2) / count(area) OVER (PARTITION BY {by})"


@query("w05_peer_percentile", f"SELECT store_id, round_even({_SHARE.format(by='gu, biz_type')}, 6) AS peer_pct, round_even(quantile_cont(area, 0.5) OVER (PARTITION BY gu, biz_type), 4) AS peer_median, count(area) OVER (PARTITION BY gu, biz_type) AS peer_n FROM panel WHERE origin = '2000Q2' AND gu IS NOT NULL")
def peers(t):
    p = t.panel().filter("origin = '2000Q2' AND gu IS NOT NULL").select("store_id", "gu", "biz_type", "area")
    return rounded(rounded(E.peer_statistics(p, "area", ["gu", "biz_type"]).select("store_id", "peer_pct", "peer_median", "peer_n"), "peer_pct"), "peer_median", digits=4)


@query(
    "w06_peer_fallback",
    f"""WITH q AS (SELECT store_id, dong, gu, biz_type, area FROM panel WHERE origin = '2000Q2' AND gu IS NOT NULL), s AS (SELECT store_id, {_SHARE.format(by='dong, biz_type')} AS p0, count(area) OVER (PARTITION BY dong, biz_type) AS n0, {_SHARE.format(by='gu, biz_type')} AS p1, count(area) OVER (PARTITION BY gu, biz_type) AS n1,
    {_SHARE.format(by='biz_type')} AS p2 FROM q) SELECT store_id, round_even(CASE WHEN n0 >= 30 THEN p0 WHEN n1 >= 30 THEN p1 ELSE p2 END, 6) AS peer_pct, (CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 ELSE 2 END)::BIGINT AS peer_level FROM s""",
)
def fallback(t):
    p = t.panel().filter("origin = '2000Q2' AND gu IS NOT NULL").select("store_id", "dong", "gu", "biz_type", "area")
    return rounded(E.peer_fallback(p, "area", [["dong", "biz_type"], ["gu", "biz_type"], ["biz_type"]]).select("store_id", "peer_pct", "peer_level"), "peer_pct")


@query("w12_recent_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, md5('1:' || o_orderkey)) AS r FROM orders) WHERE r <= 3")
def recent(t):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.md5(F.concat(F.lit("1:"), F.col("o_orderkey").cast("string")))))
    return t.orders.withColumn("r", r).filter("r <= 3").select("o_custkey", "o_orderkey")


FACTORS = {"size": ["a"], "age": ["b"], "place": ["c", "d"]}


def explained(t, shift=0):
    rows = t.part.select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_partkey") % 7 / 7).alias("c"), (F.col("p_partkey") % 3 / 3).alias("d"))
    background = t.part.filter(f"p_partkey % 40 = {1 + shift}").select((F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_partkey") % 7 / 7).alias("c"), (F.col("p_partkey") % 3 / 3).alias("d"), F.col("p_partkey").alias("_o")).orderBy("_o").limit(64).drop("_o")
    score = lambda v: 1 / (1 + F.exp(-(v["a"] - v["b"] + v["c"] * v["d"])))
    return E.shapley(rows, background, FACTORS, score, "p_partkey")


def _explained(shift=0):
    cols = "p_size / 50 AS a, p_retailprice / 2000 AS b, p_partkey % 7 / 7 AS c, p_partkey % 3 / 3 AS d"
    take = lambda bit, c: f"CASE WHEN (mask & {bit}) <> 0 THEN r.{c} ELSE g.{c} END"
    value = f"1 / (1 + exp(-({take(1, 'a')} - {take(2, 'b')} + {take(4, 'c')} * {take(4, 'd')})))"
    wide = ", ".join(f"max(v) FILTER (mask = {m}) AS v{m}" for m in range(8))
    part = lambda i, j, k: f"(v{i} - v0) / 3 + (v{i + j} - v{j}) / 6 + (v{i + k} - v{k}) / 6 + (v7 - v{7 - i}) / 3"
    return f"""(SELECT p_partkey, v0 AS base, v7 AS score, unnest(['size', 'age', 'place']) AS factor, unnest([{part(1, 2, 4)}, {part(2, 1, 4)}, {part(4, 1, 2)}]) AS contribution FROM (SELECT p_partkey, {wide} FROM
        (SELECT r.p_partkey, mask, avg({value}) AS v FROM (SELECT p_partkey, {cols} FROM part) r, (SELECT {cols} FROM part WHERE p_partkey % 40 = {1 + shift} ORDER BY p_partkey LIMIT 64) g, range(8) m(mask) GROUP BY 1, 2) GROUP BY 1))"""


@query("m23_factor_shapley", f"SELECT p_partkey, factor, round_even(contribution, 6) AS contribution, round_even(base, 6) AS base, round_even(score, 6) AS score FROM {_explained()}")
def shapley(t):
    return rounded(explained(t), "contribution", "base", "score")


def _direction(c):
    return f"CASE WHEN abs({c}) < 0.001 THEN 'neutral' WHEN {c} > 0 THEN 'up' ELSE 'down' END"


@query("m26_two_backgrounds", f"SELECT a.factor, count(*) AS n, count(*) FILTER ({_direction('a.contribution')} <> {_direction('b.contribution')}) AS n_sensitive FROM {_explained()} a JOIN {_explained(1)} b ON a.p_partkey = b.p_partkey AND a.factor = b.factor GROUP BY 1")
def sensitivity(t):
    return E.compare_explanations(explained(t), explained(t, 1), "p_partkey").groupBy("factor").agg(F.count("*").alias("n"), F.count_if("sensitive").alias("n_sensitive"))


@query("w08_top_factor", f"WITH x AS (SELECT p_partkey, arg_max(factor, contribution) AS top_factor FROM {_explained()} GROUP BY 1) SELECT top_factor, count(*) AS n FROM x GROUP BY 1")
def top(t):
    return E.top_factor(explained(t), "p_partkey").groupBy("top_factor").agg(F.count("*").alias("n"))


def modelled(t):
    return t.panel().select("store_id", "origin", "origin_no", "event_12m", F.col("area"), F.col("age_months").cast("double").alias("age"), F.when(F.col("store_id") % 4 != 0, F.col("dong").cast("double")).alias("dong"), "biz_type")


@query("m01_boosted_trees")
def boosted(t):
    p = modelled(t)
    score = ML.boosted(p.filter("origin_no <= 7992"), ["area", "age", "dong"], "event_12m", trees=5, depth=3)
    return rounded(M.ranking(score(p.filter("origin_no = 7998")).withColumn("y", F.col("event_12m")), ["origin"]), "auc", "ap", "base_rate", "ap_lift", digits=2)


@query("m06_rolling_scores")
def rolling(t):
    out = ML.rolling_scores(modelled(t), lambda train: ML.logistic(train, ["area", "age", "dong"], "event_12m", 0.01), range(7984, 7996), ["store_id"], "event_12m", least=5)
    return rounded(M.ranking(out, ["origin_no"]).select("origin_no", "n", "events", "auc"), "auc", digits=2)


@query("m04_calibrators")
def calibrators(t):
    rows = t.scored()
    a, b = ML.platt(rows.filter("origin_no < 7992"))
    out = ML.isotonic(rows.filter("origin_no < 7992"))(rows.filter("origin_no >= 7992")).withColumn("p_platt", M.recalibrated("p", a, b))
    return out.agg(*[S.rounded(M.brier("y", c), 4).alias(n) for n, c in (("raw", "p"), ("isotonic", "p_cal"), ("platt", "p_platt"))], F.count("*").alias("n"))


@query(
    "m17_rate_table",
    """WITH tr AS (SELECT * FROM panel WHERE origin_no <= 7992), c0 AS (SELECT biz_type, gu, avg(event_12m) AS r, count(*) AS n FROM tr GROUP BY 1, 2), c1 AS (SELECT biz_type, avg(event_12m) AS r, count(*) AS n FROM tr GROUP BY 1)
    SELECT p.store_id, round_even(CASE WHEN c0.n >= 30 THEN c0.r WHEN c1.n >= 30 THEN c1.r ELSE (SELECT avg(event_12m) FROM tr) END, 6) AS p FROM panel p LEFT JOIN c0 ON c0.biz_type = p.biz_type AND c0.gu = p.gu LEFT JOIN c1 ON c1.biz_type = p.biz_type WHERE origin_no = 7998""",
)
def rates(t):
    p = t.panel()
    return rounded(ML.rate_table(p.filter("origin_no <= 7992"), p.filter("origin_no = 7998"), ["biz_type", "gu"], "event_12m").select("store_id", "p"), "p")


@query("m22_permutation_importance")
def importance(t):
    p = modelled(t).filter("origin_no = 7998").withColumn("y", F.col("event_12m"))
    score = ML.logistic(modelled(t).filter("origin_no <= 7992"), ["area", "age"], "event_12m", 0.01)
    base = M.ranking(score(p)).select("auc").first()[0]
    parts = [M.ranking(score(ML.permuted(p, [c], "store_id", 3))).select(F.lit(c).alias("column"), F.bround(base - F.col("auc"), 2).alias("drop")) for c in ("area", "age")]
    return parts[0].unionByName(parts[1])


@query("m28_treatment_effect")
def effect(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("d"), (F.col("o_totalprice") / 1e5).alias("y"), (F.col("c_acctbal") / 1e4).alias("x1"), (F.col("c_nationkey") / 25).alias("x2"))
    return rounded(ML.treatment_effect(o, ["x1", "x2"], "d", "y", "o_orderkey"), "ate", "se", "low", "high", digits=4)


@query("m07_holdout")
def holdout(t):
    return t.stores().groupBy(ML.holdout("store_id").alias("held_out")).agg(F.count("*").alias("n"))
