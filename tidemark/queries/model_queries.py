"""Calibration, intervals, tuning, explanations and treatment models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import peers as E
from tidemark.operators import uncertainty as U
from tidemark.queries.metric_queries import explained, modelled, rounded
from tidemark.queries.registry import query


@query("m05_calibration_slope", "SELECT 0.0::DOUBLE AS mean_error, corr(ln(p / (1 - p)), y) > 0 AS slope_is_positive FROM scored")
def slope(t):
    b, a = U.calibration_slope(t.scored())
    shifted = 1 / (1 + F.exp(-(U.clipped_logit("p") + a)))
    return t.scored().agg(S.rounded(F.avg(shifted) - F.avg("y"), 4).alias("mean_error"), F.lit(b > 0).alias("slope_is_positive"))


@query("m08_chosen_calibration")
def chosen(t):
    rows = t.scored()
    fit, select = rows.filter("origin_no < 7990"), rows.filter("origin_no BETWEEN 7990 AND 7995")
    a, b = ML.platt(fit)
    name, figures = U.choose_calibration(select, {"platt": lambda r: r.withColumn("p_cal", M.recalibrated("p", a, b)), "isotonic": ML.isotonic(fit)}, "cluster", replicates=50)
    return t.spark.createDataFrame([(name, round(figures["raw"], 4))], "chosen string, raw_brier double")


@query("m09_loss_difference", "SELECT round_even(avg(pow(0.25 - y, 2) - pow(p - y, 2)), 6) AS difference FROM scored")
def loss(t):
    out = U.loss_difference(t.scored().withColumn("flat", F.lit(0.25)), "flat", "p", "y", "cluster", 50)
    return out.select(S.rounded("difference").alias("difference"))


@query(
    "m09_auc_difference",
    """WITH r AS (SELECT y, least(floor(p * 1000), 999) AS a, least(floor((l_quantity / 51) * 1000), 999) AS b FROM scored), l AS (SELECT y, unnest([{'m': 'a', 'k': a}, {'m': 'b', 'k': b}]) AS c FROM r), g AS (SELECT c.m AS m, c.k AS k, sum(y) AS pos, count(*) - sum(y) AS neg FROM l GROUP BY 1, 2),
    w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY m ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), u AS (SELECT m, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY 1) SELECT round_even(max(auc) FILTER (m = 'a') - max(auc) FILTER (m = 'b'), 6) AS difference FROM u""",
)
def auc(t):
    out = U.auc_difference(t.scored().withColumn("q", F.col("l_quantity") / 51), "p", "q", "y", "cluster", 30)
    return out.select(S.rounded("difference").alias("difference"))


@query("m10_rate_gap_bootstrap", "SELECT origin, round_even(avg((area > 100000)::INT) FILTER (event_12m = 1) - avg((area > 100000)::INT) FILTER (event_12m = 0), 6) AS gap FROM panel GROUP BY 1")
def gap(t):
    out = U.rate_gap(t.panel().withColumn("has", (F.col("area") > 100000).cast("int")), "has", "event_12m", "origin", "pnu", 40)
    return out.select("origin", S.rounded("gap").alias("gap"))


@query("m11_refit_interval")
def refit(t):
    p = modelled(t)
    out = U.refit_interval(p.filter("origin_no <= 7992"), p.filter("origin_no = 7998"), lambda tr, w: ML.logistic(tr, ["area", "age"], "event_12m", 0.01, w), "store_id", refits=3)
    return out.agg(F.count("*").alias("n"), F.count_if((F.col("p_low") > F.col("p_mean")) | (F.col("p_high") < F.col("p_mean"))).alias("n_outside"))


@query("m12_venn_abers", "SELECT count(*) AS n, 0::BIGINT AS n_wrong FROM scored WHERE origin_no >= 7995")
def abers(t):
    rows = t.scored()
    out = U.venn_abers(rows.filter("origin_no < 7995"), rows.filter("origin_no >= 7995"), points=20)
    return out.agg(F.count("*").alias("n"), F.count_if(~S.flag((F.col("p_low") <= F.col("p_high")) & F.col("p_point").between(0, 1))).alias("n_wrong"))


@query(
    "m13_interval_diagnostics",
    """WITH r AS (SELECT y, p * 0.8 AS lo, least(p * 1.3, 1) AS hi, (p * 0.8 + least(p * 1.3, 1)) / 2 AS mid FROM scored), e AS (SELECT list_distinct(quantile_cont(mid, [.1, .2, .3, .4, .5, .6, .7, .8, .9])) AS l FROM r), b AS (SELECT *, len(list_filter(l, lambda x: x <= mid)) AS b FROM r, e),
    g AS (SELECT b, avg(y) AS o, avg(lo) AS l, avg(hi) AS h FROM b GROUP BY 1) SELECT round_even((SELECT avg(hi - lo) FROM r), 6) AS mean_width, round_even((SELECT quantile_cont(hi - lo, 0.5) FROM r), 6) AS median_width, round_even((SELECT quantile_cont(hi - lo, 0.9) FROM r), 6) AS p90_width, round_even(avg((o BETWEEN l AND h)::INT), 6) AS bin_coverage, count(*) AS n_bins FROM g""",
)
def diagnostics(t):
    rows = t.scored().withColumns({"p_low": F.col("p") * 0.8, "p_high": F.least(F.col("p") * 1.3, F.lit(1.0))})
    return rounded(U.interval_diagnostics(rows), "mean_width", "median_width", "p90_width", "bin_coverage")


@query("m15_relative_bands", "WITH c AS (SELECT quantile_cont(p, 0.5) AS m, quantile_cont(p, 0.9) AS h FROM scored) SELECT CASE WHEN p >= h THEN 'high' WHEN p >= m THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM scored, c GROUP BY 1")
def relative(t):
    return U.relative_bands(t.scored(), "p", 0.5, 0.9).groupBy("band").agg(F.count("*").alias("n"))


@query("m16_window_cutoffs", "WITH o AS (SELECT DISTINCT origin_no AS t FROM scored) SELECT t AS origin_no, round_even(quantile_cont(p, 0.9), 6) AS cut, count(*) AS n FROM o JOIN scored s ON s.origin_no < t AND s.origin_no >= t - 4 GROUP BY 1")
def windows(t):
    return rounded(U.window_cutoffs(t.scored(), "origin_no", 4), "cut")


@query("m18_logistic_baseline")
def baseline(t):
    p = modelled(t)
    score = ML.logistic_baseline(p.filter("origin_no <= 7992"), "event_12m", "age", ["area"], ["biz_type"])
    return rounded(M.ranking(score(p.filter("origin_no = 7998")).withColumn("y", F.col("event_12m")), ["origin"]).select("origin", "n", "auc"), "auc", digits=2)


@query("m19_tuned_settings")
def tuned(t):
    grid = [{"ridge": 0.01}, {"ridge": 1.0}]
    rows = U.tuned(modelled(t), grid, lambda tr, ridge: ML.logistic(tr, ["area", "age"], "event_12m", ridge), "event_12m", "origin_no", [7994])
    return t.spark.createDataFrame([(r["origin"], float(r["ridge"]), round(r["auc"], 2)) for r in rows], "origin long, ridge double, auc double")


@query("m20_recalibrated_by_origin")
def recalibrated(t):
    oof = t.scored().filter("origin_no BETWEEN 7984 AND 7990")
    out, used = U.recalibrated_by_origin(oof, "origin_no")
    applied = t.spark.createDataFrame([(u["origin"], u["applied"]) for u in used], "origin_no long, applied boolean")
    return out.join(F.broadcast(applied), "origin_no").groupBy("origin_no", "applied").agg(F.count("*").alias("n"), S.rounded(M.brier("y", "p_cal"), 3).alias("brier"))


@query("m21_adoption", "SELECT unnest(['keep', 'na']) AS policy, unnest([true, false]) AS meets_rule, 'not_adopted' AS verdict")
def adoption(t):
    rows = t.spark.createDataFrame([("keep", 0.001, 0.001, 0.0), ("na", 0.001, 0.01, 0.0)], "policy string, auc_ci_low double, ece_increase double, slope_dev_increase double")
    return U.adopted(rows).select("policy", "meets_rule", "verdict")


@query("m22_group_importance")
def group(t):
    p = modelled(t).filter("origin_no = 7998").withColumn("y", F.col("event_12m"))
    score = ML.logistic(modelled(t).filter("origin_no <= 7992"), ["area", "age"], "event_12m", 0.01)
    base = M.ranking(score(p)).select("auc").first()[0]
    return M.ranking(score(ML.permuted(p, ["area", "age"], "store_id", 3))).select(F.lit("area,age").alias("columns"), F.bround(F.lit(base) - F.col("auc"), 2).alias("drop"))


@query("m24_inner_driver")
def driver(t):
    cols = lambda df: df.select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_partkey") % 7 / 7).alias("c"))
    score = lambda v: 1 / (1 + F.exp(-(v["a"] - v["b"] + v["c"])))
    background = cols(t.part).orderBy(F.xxhash64("p_partkey")).limit(32).drop("p_partkey")
    out = E.inner_driver(cols(t.part), background, ["a"], ["b", "c"], score, "p_partkey", F.lit(1))
    return out.groupBy("driver").agg(F.count("*").alias("n"))


@query("m25_background_manifest", "WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 40 = 1) SELECT count(*) AS n_rows, sha256(string_agg(p_partkey::VARCHAR, chr(10) ORDER BY p_partkey::VARCHAR)) AS keys_sha256, sha256(string_agg(p_partkey || '|' || p_size, chr(10) ORDER BY p_partkey || '|' || p_size)) AS rows_sha256 FROM b")
def manifest(t):
    b = t.part.filter("p_partkey % 40 = 1").select("p_partkey", "p_size")
    found = U.background_manifest(b, ["p_partkey"], ["p_size"])
    return U.background_manifest(U.pinned_background(b, found.first().asDict(), ["p_partkey"], ["p_size"]), ["p_partkey"], ["p_size"])


@query("m27_propensity", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 9 = 0) AS no_x, 0::BIGINT AS no_z, count(*) FILTER (o_orderkey % 9 <> 0) AS n_complete, sum((o_orderstatus = 'F')::INT) FILTER (o_orderkey % 9 <> 0)::BIGINT AS n_treated FROM orders")
def propensity(t):
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("d"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_custkey") % 10 / 10).alias("z"))
    return U.propensity(rows, "d", ["x", "z"])[1]


@query("m29_split_designs")
def designs(t):
    p = modelled(t).filter("origin_no <= 7992").withColumn("y", F.col("event_12m"))
    fit = lambda tr: ML.logistic(tr, ["area", "age"], "event_12m", 0.01)
    drawn = F.pmod(F.xxhash64("store_id", "origin_no"), F.lit(100)) < 20
    parts = {"random_rows": (p.filter(~drawn), p.filter(drawn)), "held_out_stores": (p.filter(~ML.holdout("store_id")), p.filter(ML.holdout("store_id"))), "later_origins": (p.filter("origin_no < 7988"), p.filter("origin_no = 7992"))}
    rows = [(k, round(M.ranking(fit(a)(b)).select("auc").first()[0], 1)) for k, (a, b) in parts.items()]
    return t.spark.createDataFrame(rows, "design string, auc double")


@query("m30_serving_rows", "SELECT count(*) AS n, count(*) FILTER (p_size > 40) AS n_high, count(*) * 3 AS n_factors FROM part")
def serving(t):
    from tidemark.plans import master as MA

    scored = t.part.select(F.col("p_partkey").alias("store_id"), (F.col("p_size") / 50).alias("p"), "p_type")
    out = MA.serve(scored, explained(t).withColumnRenamed("p_partkey", "store_id"), F.lit(0.5), F.lit(0.81), ["p_type"])
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("band") == "high").alias("n_high"), F.sum("n_factors").alias("n_factors"))


@query("m32_band_rule_values", "SELECT origin_no, round_even(avg(y), 6) AS base_rate, round_even(1.2 * avg(y), 6) AS mid, round_even(quantile_cont(p, 0.95), 6) AS high FROM scored GROUP BY 1")
def band_values(t):
    return rounded(M.band_rule_values(t.scored(), "origin_no"), "base_rate", "mid", "high")


@query("m33_feature_variants", "SELECT unnest(['as_is', 'missing', 'lower_bound', 'excluded']) AS variant, unnest([count(*), count(*), count(*), count(*) FILTER (p_partkey % 4 <> 0)]) AS n, unnest([sum(p_size), sum(p_size) FILTER (p_partkey % 4 <> 0), sum(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_size END), sum(p_size) FILTER (p_partkey % 4 <> 0)])::BIGINT AS total FROM part")
def variants(t):
    rows = t.part.select("p_partkey", F.col("p_size").alias("posts"), F.lit(1).alias("low"), (F.col("p_partkey") % 4 == 0).alias("cut"))
    parts = [df.agg(F.lit(k).alias("variant"), F.count("*").alias("n"), F.sum("posts").alias("total")) for k, df in U.feature_variants(rows, ["posts"], "cut", {"posts": "low"}).items()]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


@query("m34_agreement", """WITH r AS (SELECT p_partkey AS k, unnest(['x', 'y', 'z']) AS f, unnest([p_size / 50.0, (p_partkey % 7) / 7.0 - 0.3, 0.2]) AS a, unnest([p_size / 60.0, (p_partkey % 5) / 5.0 - 0.3, 0.2]) AS b FROM part), t AS (SELECT k, arg_max(f, (a, f)) AS ta, arg_max(f, (b, f)) AS tb, count(*) FILTER (abs(a) >= 0.001 AND abs(b) >= 0.001) AS n, count(*) FILTER (abs(a) >= 0.001 AND abs(b) >= 0.001 AND sign(a) = sign(b)) AS s FROM r GROUP BY 1)
    SELECT round_even(avg((ta = tb)::INT), 6) AS top1_agreement, round_even(sum(s) / sum(n), 6) AS sign_agreement, count(*) AS n FROM t""")
def stability(t):
    def made(size, m):
        k = F.col("p_partkey")
        return t.part.select(k, F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), v.alias("contribution")) for n, v in (("x", F.col("p_size") / F.lit(float(size))), ("y", k % m / F.lit(float(m)) - 0.3), ("z", F.lit(0.2)))])).alias("r")).select(k, "r.factor", "r.contribution")

    return rounded(U.agreement(made(50, 7), made(60, 5), "p_partkey"), "top1_agreement", "sign_agreement")


@query(
    "a30_balance_table",
    """WITH r AS (SELECT (o_orderpriority = '1-URGENT')::INT AS t, o_totalprice AS x, (o_custkey % 3 = 0)::INT AS b, o_orderstatus AS s FROM orders), c AS (SELECT 'x' AS variable, 'continuous' AS kind, t, avg(x) AS m, var_samp(x) AS s2 FROM r GROUP BY t UNION ALL SELECT 'b', 'binary', t, avg(b), avg(b) * (1 - avg(b)) FROM r GROUP BY t
    UNION ALL SELECT 's=' || l, 'level', t, avg((s = l)::INT), avg((s = l)::INT) * (1 - avg((s = l)::INT)) FROM r, (SELECT DISTINCT o_orderstatus AS l FROM orders) GROUP BY l, t), w AS (SELECT variable, kind, max(m) FILTER (t = 1) AS a, max(m) FILTER (t = 0) AS b, (max(s2) FILTER (t = 1) + max(s2) FILTER (t = 0)) / 2 AS s FROM c GROUP BY 1, 2)
    SELECT variable, kind, round_even(a, 4) AS mean_treated, round_even(b, 4) AS mean_control, round_even((a - b) / sqrt(nullif(s, 0)), 5) AS smd, coalesce(abs((a - b) / sqrt(nullif(s, 0))) > 0.1, false) AS imbalanced FROM w""",
)
def balance(t):
    rows = t.orders.select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("t"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 3 == 0).cast("int").alias("b"), F.col("o_orderstatus").alias("s"))
    return rounded(rounded(M.balance_table(rows, "t", ["x"], ["b"], ["s"]), "mean_treated", "mean_control", digits=4), "smd", digits=5)


@query("m01_categories_as_sets")
def categories(t):
    p = modelled(t)
    score = ML.boosted(p.filter("origin_no <= 7992"), ["area", "age"], "event_12m", trees=4, depth=3, categories=["biz_type"])
    return rounded(M.ranking(score(p.filter("origin_no = 7998")).withColumn("y", F.col("event_12m")), ["origin"]).select("origin", "n", "events", "auc"), "auc", digits=2)
