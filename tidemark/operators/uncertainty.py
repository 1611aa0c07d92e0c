"""Calibration checks, intervals and choices by rule: small tables of sums are made first, and only they are iterated over."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import contracts as C
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators.order import quantiles


def clipped_logit(p: str | Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(S.col(p), F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def calibration_slope(scored: DataFrame, y: str = "y", p: str = "p") -> tuple[float, float]:
    """(slope of a logistic fit on the score's logit, what must be added to the logits for the mean to be right).

    Rows are summed by logit to four digits, 280,000 sums at most; the second number is found on them by Newton's steps.
    """
    sums = scored.select(F.bround(clipped_logit(p), 4).alias("l"), F.col(y).cast("double").alias("y")).groupBy("l").agg(F.count("*").alias("n"), F.sum("y").alias("e")).cache()
    try:
        flat = sums.select(F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("e").alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("e")).alias("w")))).alias("r"), "l").select("l", "r.y", "r.w").filter("w > 0")
        slope = ML.weighted_platt(flat, "l", "y", "w")[1]
        a, mean = 0.0, sums.agg(F.sum("e") / F.sum("n")).first()[0]
        for _ in range(50):
            q = 1 / (1 + F.exp(-(F.col("l") + a)))
            f, d = sums.agg(F.sum(q * F.col("n")) / F.sum("n"), F.sum(q * (1 - q) * F.col("n")) / F.sum("n")).first()
            step = (f - mean) / max(d, 1e-12)
            a -= max(min(step, 2.0), -2.0)
            if abs(step) < 1e-10:
                break
        return slope, a
    finally:
        sums.unpersist()


def loss_difference(scored: DataFrame, a: str, b: str, y: str, cluster: str, replicates: int = 200) -> DataFrame:
    """Brier score of a less that of b, with its bootstrap limits over clusters: one row."""
    d = (F.pow(F.col(a) - F.col(y), 2) - F.pow(F.col(b) - F.col(y), 2)).cast("double")
    out = M.cluster_bootstrap(scored, cluster, {"d": F.sum(d), "n": F.count("*")}, F.col("d") / F.col("n"), replicates)
    return scored.agg(F.avg(d).alias("difference")).crossJoin(out)


def choose_calibration(scored: DataFrame, candidates: dict[str, Callable[[DataFrame], DataFrame]], cluster: str, y: str = "y", p: str = "p", replicates: int = 200) -> tuple[str, dict]:
    """The candidate of least Brier score on the rows to select on, if it is better than the raw score beyond chance, else raw.

    A candidate gives rows a column p_cal. Each is scored once; only its mean loss and one interval reach the driver.
    """
    losses = {"raw": scored.agg(M.brier(y, p)).first()[0]}
    made = {name: apply(scored) for name, apply in candidates.items()}
    for name, rows in made.items():
        losses[name] = rows.agg(M.brier(y, "p_cal")).first()[0]
    best = min(losses, key=lambda k: (losses[k], k != "raw", k))
    if best == "raw":
        return "raw", losses
    found = loss_difference(made[best], "p_cal", p, y, cluster, replicates).first().asDict()
    return (best if found["difference"] < 0 and found["q97_5"] < 0 else "raw"), {**losses, **found}


def auc_difference(scored: DataFrame, a: str, b: str, y: str, cluster: str, replicates: int = 100, bins: int = 1000, seed: int = 7) -> DataFrame:
    """AUC of a less that of b with bootstrap limits over clusters: one row.

    Scores are put into `bins` equal steps. Rows are summed by cluster and step before they meet the replicates' weights, so that what is
    multiplied are sums.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).alias("k")) for n, c in (("a", a), ("b", b))]))
    sums = scored.select(cluster, cells.alias("_c"), F.col(y).alias("_y")).groupBy(cluster, "_c.m", "_c.k").agg(F.sum("_y").alias("e"), F.count("*").alias("n"))
    weighted = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", F.when(F.col("replicate") == 0, 1).otherwise(M.hashed_poisson(F.col("replicate"), F.col(cluster), seed)))
    per = weighted.filter("w > 0").groupBy("replicate", "m", "k").agg(F.sum(F.col("w") * F.col("e")).alias("pos"), F.sum(F.col("w") * (F.col("n") - F.col("e"))).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy("replicate", "m").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    auc = per.withColumn("_b", below).groupBy("replicate", "m").agg((F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    each = auc.groupBy("replicate").agg((F.max(F.when(F.col("m") == "a", F.col("auc"))) - F.max(F.when(F.col("m") == "b", F.col("auc")))).alias("d"))
    return each.agg(F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("difference"), *[F.percentile(F.when(F.col("replicate") > 0, F.col("d")), F.lit(q)).alias(n) for n, q in (("low", 0.025), ("high", 0.975))])


def rate_gap(rows: DataFrame, has: str, event: str, origin: str, cluster: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """For each origin the share with a feature among events less that among others, with Poisson bootstrap limits over clusters."""
    sums = rows.groupBy(origin, cluster).agg(*[F.sum(c).alias(n) for n, c in (("n1", F.col(event)), ("h1", F.col(event) * F.col(has)), ("n0", 1 - F.col(event)), ("h0", (1 - F.col(event)) * F.col(has)))])
    w = F.when(F.col("replicate") == 0, 1).otherwise(M.hashed_poisson(F.col("replicate"), F.col(cluster), seed))
    each = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("w", w).filter("w > 0")
    each = each.groupBy(origin, "replicate").agg((F.try_divide(F.sum(F.col("w") * F.col("h1")), F.sum(F.col("w") * F.col("n1"))) - F.try_divide(F.sum(F.col("w") * F.col("h0")), F.sum(F.col("w") * F.col("n0")))).alias("d"))
    return each.groupBy(origin).agg(F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("gap"), *[F.percentile(F.when(F.col("replicate") > 0, F.col("d")), F.lit(q)).alias(n) for n, q in (("low", 0.025), ("high", 0.975))])


def refit_interval(train: DataFrame, rows: DataFrame, fit: Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]], cluster: str, refits: int = 30, level: float = 0.9, seed: int = 7) -> DataFrame:
    """rows with p_low, p_high and p_mean over models refitted on clusters drawn with weights; a model is a column, so that rows aren't moved.

    fit(train, weight column) gives a function that adds p.
    """
    for k in range(refits):
        drawn = train.withColumn("_w", M.hashed_poisson(F.lit(k + 1), F.col(cluster), seed).cast("double")).filter("_w > 0")
        rows = fit(drawn, "_w")(rows).withColumnRenamed("p", f"_p{k}")
    each = F.array_sort(F.array(*[f"_p{k}" for k in range(refits)]))

    def at(q: float) -> Column:  # linear between the two nearest
        place = q * (refits - 1)
        low = math.floor(place)
        a, b = F.get(each, F.lit(low)), F.get(each, F.lit(min(low + 1, refits - 1)))
        return a + (b - a) * (place - low)

    mean = F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / refits
    return rows.withColumns({"p_low": at((1 - level) / 2), "p_high": at((1 + level) / 2), "p_mean": mean}).drop(*[f"_p{k}" for k in range(refits)])


def _pool(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Isotonic means of (score, sum, weight), ascending: (last score, value) of each pool."""
    pools: list[list[float]] = []
    for x, s, w in points:
        pools.append([s, w, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, w2, x2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + w2, x2]
    return [(x, s / w) for s, w, x in pools]


def venn_abers(calibration: DataFrame, rows: DataFrame, y: str = "y", p: str = "p", points: int = 200, digits: int = 4) -> DataFrame:
    """rows with p_low and p_high, the isotonic values of a score if it stood among the calibration rows as no event or as an event, and p_point.

    Calibration rows are summed by score to `digits` digits, 10 ** digits sums at most; the fits run over these for `points` quantiles of the score;
    between them values are linear.
    """
    sums = calibration.groupBy(F.bround(p, digits).alias("s")).agg(F.sum(F.col(y).cast("double")).alias("e"), F.count("*").cast("double").alias("n")).orderBy("s").collect()
    table = [(r["s"], r["e"], r["n"]) for r in sums]
    total = sum(n for _, _, n in table)
    grid, seen, k = [], 0.0, 0
    for s, _, n in table:
        seen += n
        took = False
        while k < points and k / max(points - 1, 1) * total <= seen:
            took, k = True, k + 1
        if took:
            grid.append(s)
    low, high = [], []
    for g in grid:
        for label, out in ((0.0, low), (1.0, high)):
            own = [(s, e + label * (s == g), n + (s == g)) for s, e, n in table]
            out.append(next(v for x, v in _pool(own) if x >= g))

    table_of = lambda values: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(u).alias("u"), F.lit((v - u) / (b - a) if b > a else 0.0).alias("slope")) for a, b, u, v in zip(grid, [*grid[1:], grid[-1]], values, [*values[1:], values[-1]], strict=True)])
    s = F.greatest(F.least(F.col(p), F.lit(grid[-1])), F.lit(grid[0]))

    def value(values: list[float]) -> Column:
        piece = F.element_at(F.filter(table_of(values), lambda t: t["a"] <= s), -1)
        return piece["u"] + (s - piece["a"]) * piece["slope"]

    lo, hi = value([min(a, b) for a, b in zip(low, high, strict=True)]), value([max(a, b) for a, b in zip(low, high, strict=True)])
    out = rows.withColumn("p_low", lo).withColumn("p_high", hi)
    return out.withColumn("p_point", F.col("p_high") / (1 - F.col("p_low") + F.col("p_high")))


def interval_diagnostics(rows: DataFrame, y: str = "y", low: str = "p_low", high: str = "p_high", bins: int = 10) -> DataFrame:
    """One row: widths of the intervals, and the share of bins of the middle whose event rate lies between the mean limits."""
    mid, width = (F.col(low) + F.col(high)) / 2, F.col(high) - F.col(low)
    edges = sorted(set(quantiles(rows.select(mid.alias("_m")), "_m", [k / bins for k in range(1, bins)]).first()["q"]))
    number = F.lit(0)
    for e in edges:
        number = number + (mid >= e).cast("int")
    per = rows.withColumn("_b", number).groupBy("_b").agg(F.avg(y).alias("o"), F.avg(low).alias("l"), F.avg(high).alias("h"))
    covered = per.agg(F.avg(F.col("o").between(F.col("l"), F.col("h")).cast("int")).alias("bin_coverage"), F.count("*").alias("n_bins"))
    widths = quantiles(rows.select(width.alias("_w")), "_w", [0.5, 0.9]).select(F.get("q", F.lit(0)).alias("median_width"), F.get("q", F.lit(1)).alias("p90_width"))
    return rows.agg(F.avg(width).alias("mean_width")).crossJoin(widths).crossJoin(covered)


def relative_bands(rows: DataFrame, p: str, mid: float, high: float) -> DataFrame:
    """Bands by shares of the rows themselves: high from the quantile `high` on, mid from `mid` on."""
    cut = quantiles(rows, p, [mid, high]).select(F.get("q", F.lit(0)).alias("_m"), F.get("q", F.lit(1)).alias("_h"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("band", M.band(p, F.col("_m"), F.col("_h"))).drop("_m", "_h")


def window_cutoffs(scored: DataFrame, origin: str, size: int, p: str = "p", share: float = 0.9) -> DataFrame:
    """For each origin a cut-off from the rows of the `size` origins before it (all before it, if size is 0)."""
    origins = scored.select(F.col(origin).alias("_t")).distinct()
    span = (F.col(origin) < F.col("_t")) & ((F.col(origin) >= F.col("_t") - size) if size else F.lit(True))
    counts = scored.groupBy(origin, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    return counts.join(F.broadcast(origins), span).groupBy("_t").agg(F.percentile("_p", F.lit(share), F.col("_n")).alias("cut"), F.sum("_n").alias("n")).withColumnRenamed("_t", origin)


def inner_split(origins: Sequence[int], embargo: int = ML.EMBARGO) -> tuple[list[int], int]:
    """(origins to fit on, the last one to choose by); the embargo is kept where that leaves any, else the gap is none."""
    last = origins[-1]
    fit = [o for o in origins if o < last - embargo] or [o for o in origins if o < last]
    return fit, last


def tuned(panel: DataFrame, grid: Sequence[dict], fit: Callable[..., Callable[[DataFrame], DataFrame]], y: str, origin: str, tests: Sequence[int]) -> list[dict]:
    """For each tested origin the setting of best AUC on the last training origin, and the AUC of a fit with it on all of them.

    Each fit is a job on one slice of the panel; what reaches the driver is an AUC a setting and origin.
    """
    origins = sorted(r[0] for r in panel.select(origin).distinct().collect())
    auc = lambda rows: M.ranking(rows.withColumn("y", F.col(y))).select("auc").first()[0] or 0.0
    out = []
    for test in tests:
        train = [o for o in origins if o < test - ML.EMBARGO]
        inner, last = inner_split(train)
        scores = [auc(fit(panel.filter(F.col(origin).isin(inner)), **g)(panel.filter(F.col(origin) == last))) for g in grid]
        best = max(range(len(grid)), key=lambda k: (scores[k], -k))
        out.append({"origin": test, **grid[best], "auc": auc(fit(panel.filter(F.col(origin).isin(train)), **grid[best])(panel.filter(F.col(origin) == test)))})
    return out


def recalibrated_by_origin(oof: DataFrame, origin: str, embargo: int = ML.EMBARGO, y: str = "y", p: str = "p") -> tuple[DataFrame, list[dict]]:
    """Out-of-time scores recalibrated by the last origin whose labels were complete; a slope that isn't above 0 would turn the order and isn't used."""
    origins = sorted(r[0] for r in oof.select(origin).distinct().collect())
    parts, used = [], []
    for t in origins:
        before = [o for o in origins if o < t - embargo]
        a, b = ML.platt(oof.filter(F.col(origin) == before[-1]), y, p) if before else (0.0, 1.0)
        applied = bool(before) and b > 0
        used.append({"origin": t, "from_origin": before[-1] if before else None, "applied": applied, "intercept": a, "slope": b})
        rows = oof.filter(F.col(origin) == t)
        parts.append(rows.withColumn("p_cal", M.recalibrated(p, a, b) if applied else F.col(p)))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out, used


#: What an extension must gain in AUC at least, and may cost in calibration error and in slope.
GAIN, ERROR, SLOPE = 0.0, 0.002, 0.05


def adopted(summary: DataFrame, auc_low: float = GAIN, ece: float = ERROR, slope: float = SLOPE) -> DataFrame:
    """Whether each policy's extension meets the fixed rule, and whether all do (the verdict).

    summary: policy, auc_ci_low, ece_increase, slope_dev_increase.
    """
    meets = (F.col("auc_ci_low") > auc_low) & (F.col("ece_increase") <= ece) & (F.col("slope_dev_increase") <= slope)
    rows = summary.withColumn("meets_rule", S.flag(meets))
    every = rows.agg(F.bool_and("meets_rule").alias("_all"))
    return rows.crossJoin(F.broadcast(every)).withColumn("verdict", F.when(F.col("_all"), "candidate").otherwise("not_adopted")).drop("_all")


def background_manifest(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row that pins a background: how many rows, a hash of its sorted keys and one of keys with values."""
    line = lambda cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])
    joined = lambda cs: F.sha2(F.array_join(F.sort_array(F.collect_list(line(cs))), "\n"), 256)
    return rows.agg(F.count("*").alias("n_rows"), joined(key).alias("keys_sha256"), joined([*key, *columns]).alias("rows_sha256"))


def pinned_background(rows: DataFrame, manifest: dict, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A background that is what its manifest says; another one stops the run. It may be of any size; an explanation bounds what it takes itself."""
    found = background_manifest(rows, key, columns).first().asDict()
    if found != manifest:
        raise C.ContractError("the background isn't the one of the manifest")
    return rows


def agreement(a: DataFrame, b: DataFrame, key: str, factor: str = "factor", value: str = "contribution", dead: float = 0.001) -> DataFrame:
    """One row: share of rows whose largest factor is the same in two explanations, and of factors whose sign is, values near 0 left out."""
    x, y = a.select(key, factor, F.col(value).alias("_a")), b.select(key, factor, F.col(value).alias("_b"))
    both = x.join(y, [key, factor])
    per = both.groupBy(key).agg(F.max_by(factor, F.struct("_a", factor)).alias("_ta"), F.max_by(factor, F.struct("_b", factor)).alias("_tb"), F.count_if((F.abs("_a") >= dead) & (F.abs("_b") >= dead)).alias("_n"), F.count_if((F.abs("_a") >= dead) & (F.abs("_b") >= dead) & (F.signum("_a") == F.signum("_b"))).alias("_s"))
    return per.agg(F.avg((F.col("_ta") == F.col("_tb")).cast("int")).alias("top1_agreement"), (F.sum("_s") / F.sum("_n")).alias("sign_agreement"), F.count("*").alias("n"))


def propensity(rows: DataFrame, treated: str, covariates: Sequence[str], ridge: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(complete rows with p, their treated score; one row with how many were left out and why)"""
    complete = rows.dropna(subset=list(covariates))
    report = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in covariates]).crossJoin(complete.agg(F.count("*").alias("n_complete"), F.sum(treated).alias("n_treated")))
    return ML.logistic(complete, covariates, treated, ridge)(complete), report


def feature_variants(df: DataFrame, columns: Sequence[str], cut: str, lower: dict[str, str]) -> dict[str, DataFrame]:
    """Four treatments of features that were cut off when collected: as they are, missing for cut rows, lower bounds for them, and cut rows left out."""
    flag = S.flag(F.col(cut))
    return {
        "as_is": df, "missing": df.withColumns({c: F.when(~flag, F.col(c)) for c in columns}),
        "lower_bound": df.withColumns({c: F.when(flag, F.col(lower[c])).otherwise(F.col(c)) for c in columns}), "excluded": df.filter(~flag),
    }
