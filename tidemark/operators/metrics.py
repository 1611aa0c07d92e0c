"""Statistics of scored rows as aggregations: ranking, calibration, bands, intervals, balance, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import mean_ranks, quantiles
from tidemark.semantics import col


def ranking(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """n, events, base_rate, auc (ties count half), ap (steps at different scores) and its lift over the base rate.

    Rows are first summed to one for each score; the windows run over these.
    """
    per = scored.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    up, down = W.partitionBy(*by).orderBy(p), W.partitionBy(*by).orderBy(F.desc(p))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("pairs", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    precision = F.sum("pos").over(down) / F.sum("n").over(down)
    per = per.withColumn("ap_part", F.col("pos") * precision)
    out = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("events"), F.sum("pairs").alias("pairs"), F.sum("ap_part").alias("ap_part"))
    rate, both = F.col("events") / F.col("n"), F.col("events") * (F.col("n") - F.col("events"))
    ap = F.when(F.col("events") > 0, F.col("ap_part") / F.col("events"))
    return out.select(*by, "n", "events", rate.alias("base_rate"), F.when(both > 0, F.col("pairs") / both).alias("auc"), ap.alias("ap"), F.when(rate > 0, ap / rate).alias("ap_lift"))


def brier(y: str | Column, p: str | Column) -> Column:
    return F.avg(F.pow(col(p) - col(y), 2))


def log_loss(y: str | Column, p: str | Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.least(col(p), F.lit(1 - eps)), F.lit(eps))
    return -F.avg(col(y) * F.ln(q) + (1 - col(y)) * F.ln(1 - q))


def logit(p: str | Column) -> Column:
    return F.ln(col(p) / (1 - col(p)))


def recalibrated(p: str | Column, intercept: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-(intercept + slope * logit(p))))


def reliability(scored: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Rows by bins of equal counts: different quantiles are the edges, a bin is open on its right."""
    edges = quantiles(scored, p, [i / bins for i in range(bins + 1)]).select(F.array_sort(F.array_distinct("q")).alias("edges"))
    rows = scored.crossJoin(F.broadcast(edges))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = rows.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(p))) + 1)
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("pred_mean"), F.avg(y).alias("obs_rate"), F.element_at(F.first("edges"), F.col("bin")).alias("p_low"), F.try_element_at(F.first("edges"), F.col("bin") + 1).alias("p_high"))
    return out.withColumn("gap", F.col("pred_mean") - F.col("obs_rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.count("*").alias("n_bins"))


def band(p: str | Column, mid: Column, high: Column) -> Column:
    """A score equal to a limit is in the upper band."""
    return F.when(col(p) >= high, "high").when(col(p) >= mid, "mid").otherwise("low")


def cutoffs(scored: DataFrame, high_lift: float = 2.0, mid_lift: float = 1.2, least: int = 200, points: int = 200, low: float = 0.5, top: float = 0.995, fallback: float = 0.95, y: str = "y", p: str = "p") -> DataFrame:
    """The limits of the bands: high is the first quantile from below whose upper group is large and risky enough.

    Candidates are quantiles, a fixed number; the rows above each come from one pass that sums rows by the last candidate they pass.
    """
    grid = [low + (top - low) * i / (points - 1) for i in range(points)]
    found = quantiles(scored, p, [*grid, fallback]).select(F.array_sort(F.array_distinct(F.slice("q", 1, points))).alias("grid"), F.element_at("q", -1).alias("fallback"))
    base = scored.agg(F.avg(y).alias("base_rate")).crossJoin(found)
    rows = scored.crossJoin(F.broadcast(base.select("grid"))).withColumn("k", F.size(F.filter("grid", lambda g: g <= F.col(p))))
    per = rows.filter("k > 0").groupBy("k", F.try_element_at(F.col("grid"), F.col("k")).alias("cut")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    above = W.orderBy(F.desc("k"))
    per = per.withColumn("n", F.sum("n").over(above)).withColumn("pos", F.sum("pos").over(above)).crossJoin(F.broadcast(base))
    ok = (F.col("n") >= least) & (F.col("pos") / F.col("n") >= high_lift * F.col("base_rate"))
    found = per.agg(F.min(F.when(ok, F.col("cut"))).alias("found")).crossJoin(base)
    high = F.coalesce("found", "fallback")
    mid = mid_lift * F.col("base_rate")
    return found.select("base_rate", high.alias("cut_high"), F.when(mid >= high, F.col("base_rate")).otherwise(mid).alias("cut_mid"), F.col("found").isNull().alias("high_fallback"), (mid >= high).alias("mid_fallback"))


def band_profile(banded: DataFrame, y: str = "y", p: str = "p", name: str = "band") -> DataFrame:
    per = banded.groupBy(name).agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.avg(y).alias("obs_rate"), F.sum(y).alias("events"))
    whole = W.partitionBy()
    return per.select(name, "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), "p_mean", "obs_rate", (F.col("obs_rate") / (F.sum("events").over(whole) / F.sum("n").over(whole))).alias("lift"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    rate = k / n
    middle = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Difference of two rates and its interval, from the Wilson limits of each."""
    (l1, u1), (l2, u2) = wilson(k1, n1, z), wilson(k2, n2, z)
    d = k1 / n1 - k2 / n2
    return d, d - F.sqrt(F.pow(k1 / n1 - l1, 2) + F.pow(u2 - k2 / n2, 2)), d + F.sqrt(F.pow(u1 - k1 / n1, 2) + F.pow(k2 / n2 - l2, 2))


def hashed_poisson(replicate: Column, cluster: Column, seed: int = 7) -> Column:
    """A Poisson(1) weight that depends on nothing but the replicate and the cluster."""
    u = (F.pmod(F.xxhash64(F.lit(seed), replicate, cluster), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    limits, total, term = [], 0.0, 0.36787944117144233
    for k in range(1, 12):
        total += term
        limits.append(total)
        term /= k
    weight = F.lit(0)
    for limit in limits:
        weight = weight + (u > limit).cast("int")
    return weight


def cluster_bootstrap(scored: DataFrame, cluster: str, sums: dict[str, Column], statistic: Column, replicates: int = 200, seed: int = 7, levels: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Quantiles of a statistic of sums, clusters drawn anew: rows are summed to clusters first, then clusters are weighted."""
    per = scored.groupBy(cluster).agg(*[v.alias(k) for k, v in sums.items()])
    drawn = per.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", hashed_poisson(F.col("replicate"), F.col(cluster), seed)).filter("w > 0")
    each = drawn.groupBy("replicate").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in sums]).select(statistic.alias("value"))
    return each.agg(F.count("value").alias("replicates"), *[F.percentile("value", F.lit(q)).alias(f"q{q * 100:g}".replace(".", "_")) for q in levels])


def smd(rows: DataFrame, treated: str, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Standardised difference of each column's means between the arms, weighted if a weight is named."""
    long = rows.select(F.col(treated).alias("t"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("t", "w", "v.*").filter("x IS NOT NULL")
    arm = long.groupBy("variable", "t").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.count("*").alias("n"))
    mean = F.col("sx") / F.col("sw")
    spread = F.greatest(F.col("sxx") / F.col("sw") - mean * mean, F.lit(0.0)) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    arm = arm.select("variable", "t", mean.alias("m"), spread.alias("s2"))
    pick = lambda c, t: F.max(F.when(F.col("t") == t, F.col(c)))
    both = arm.groupBy("variable").agg(pick("m", 1).alias("mean_treated"), pick("m", 0).alias("mean_control"), pick("s2", 1).alias("v1"), pick("s2", 0).alias("v0"))
    d = (F.col("mean_treated") - F.col("mean_control")) / F.sqrt(F.nullif((F.col("v1") + F.col("v0")) / 2, F.lit(0.0)))
    return both.select("variable", "mean_treated", "mean_control", d.alias("smd"), (F.abs(d) > 0.1).alias("imbalanced"))


def effective_size(weight: str | Column) -> Column:
    return F.pow(F.sum(col(weight)), 2) / F.sum(col(weight) * col(weight))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = mean_ranks(mean_ranks(known, "_a", "ra"), "_b", "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def eta_squared(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of a value's variance that lies between groups."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    mean2 = F.col("s") * F.col("s") / F.col("n")
    return t.select("n", ((F.col("between") - mean2) / (F.col("ss") - mean2)).alias("eta_squared"))


def winsorised(rows: DataFrame, c: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    limits = quantiles(rows, c, [low, high]).select(F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi"))
    out = rows.crossJoin(F.broadcast(limits))
    return out.withColumn(f"{c}_w", F.greatest(F.least(F.col(c), F.col("_hi")), F.col("_lo"))).withColumn(f"{c}_outlier", (F.col(c) < F.col("_lo")) | (F.col(c) > F.col("_hi"))).drop("_lo", "_hi")


def summary_row(by: DataFrame, metric: str) -> DataFrame:
    """One row for a model: its metric's mean and range over origins (n, rate and the metric of each), the rate of all rows."""
    return by.agg(F.avg(metric).alias(f"{metric}_mean"), (F.max(metric) - F.min(metric)).alias(f"{metric}_range"), F.count("*").alias("n_origins"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("rate"))


def weighted_series(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted and plain means by group, as figures show them."""
    return rows.groupBy(by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"), F.avg(value).alias("plain"))


def band_rule_values(scored: DataFrame, origin: str, y: str = "y", p: str = "p", lift: float = 1.2, share: float = 0.95) -> DataFrame:
    """For each origin what the band rules would give: its base rate, the cut-off of a lift over it, and that of a share of the scores."""
    per = scored.groupBy(origin, F.col(p).alias("_p")).agg(F.count("*").alias("_n"), F.sum(y).alias("_e"))
    return per.groupBy(origin).agg((F.sum("_e") / F.sum("_n")).alias("base_rate"), (lift * F.sum("_e") / F.sum("_n")).alias("mid"), F.percentile("_p", F.lit(share), F.col("_n")).alias("high"))


def balance_table(rows: DataFrame, treated: str, continuous: Sequence[str], binary: Sequence[str], categories: Sequence[str], flag: float = 0.1) -> DataFrame:
    """(variable, kind, mean_treated, mean_control, smd, imbalanced): means of columns, shares of yes, and shares of each level (a missing one too).

    Shares are compared with the spread that a share has. Everything is one pass over long rows.
    """
    cells = [F.struct(F.lit(c).alias("variable"), F.lit(k).alias("kind"), F.col(c).cast("double").alias("x")) for k, cs in (("continuous", continuous), ("binary", binary)) for c in cs]
    long = rows.select(F.col(treated).alias("t"), F.explode(F.array(*cells)).alias("v")).select("t", "v.*").filter("x IS NOT NULL")
    arm = long.groupBy("variable", "kind", "t").agg(F.avg("x").alias("m"), F.var_samp("x").alias("s2"))
    if categories:
        levels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("l")) for c in categories]))
        size = rows.groupBy(F.col(treated).alias("t")).agg(F.count("*").alias("n"))
        each = rows.select(F.col(treated).alias("t"), levels.alias("v")).groupBy("t", "v.c", "v.l").agg(F.count("*").alias("k"))
        grid = each.select("c", "l").distinct().crossJoin(F.broadcast(size))
        per = grid.join(each, ["t", "c", "l"], "left")
        arm = arm.unionByName(per.select(F.concat_ws("=", "c", "l").alias("variable"), F.lit("level").alias("kind"), "t", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("m"), F.lit(None).cast("double").alias("s2")))
    spread = F.when(F.col("kind") == "continuous", F.col("s2")).otherwise(F.col("m") * (1 - F.col("m")))
    pick = lambda c, t: F.max(F.when(F.col("t") == t, c))
    both = arm.groupBy("variable", "kind").agg(pick(F.col("m"), 1).alias("mean_treated"), pick(F.col("m"), 0).alias("mean_control"), ((pick(spread, 1) + pick(spread, 0)) / 2).alias("_s"))
    d = (F.col("mean_treated") - F.col("mean_control")) / F.sqrt(F.nullif(F.col("_s"), F.lit(0.0)))
    return both.select("variable", "kind", "mean_treated", "mean_control", d.alias("smd"), F.coalesce(F.abs(d) > flag, F.lit(False)).alias("imbalanced"))


def lift_crossings(scored: DataFrame, steps: int, target: float = 1.0, least: int = 50, y: str = "y", p: str = "p") -> DataFrame:
    """How often the lift of the rows above a cut-off crosses a target as the cut-off falls; cut-offs with few rows above are left out."""
    d = scored.groupBy(F.floor(F.col(p) * steps).alias("k")).agg(F.count("*").alias("n"), F.sum(y).alias("e"))
    w = W.orderBy(F.desc("k"))  # a row for each step
    c = d.withColumn("cn", F.sum("n").over(w)).withColumn("ce", F.sum("e").over(w)).filter(F.col("cn") >= least).crossJoin(F.broadcast(d.agg((F.sum("e") / F.sum("n")).alias("base"))))
    c = c.withColumn("above", F.col("ce") / F.col("cn") / F.col("base") >= target).withColumn("b", F.lag("above").over(W.orderBy("k")))
    return c.agg(F.count_if(F.col("above") != F.col("b")).alias("crossings"), F.count_if("above").alias("n_above"), F.count("*").alias("n_cuts"))
