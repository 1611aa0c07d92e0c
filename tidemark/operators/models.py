"""Models as table functions on pyspark.ml: boosted trees with a bin for missing values, logistic, calibrators, splits, effects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import ContractError
from tidemark.operators.order import quantiles

#: How many quarters lie between the last training origin and the one tested, and the fewest origins to train on.
EMBARGO, LEAST_ORIGINS = 4, 4


def check_predictors(columns: Sequence[str], roles: dict[str, str]) -> Sequence[str]:
    """Only predictors may reach a model."""
    bad = [c for c in columns if roles.get(c) != "predictor"]
    if bad:
        raise ContractError(f"not predictors: {bad}")
    return columns


def bin_edges(train: DataFrame, columns: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Different quantiles of each column; a column without a value in training gets none and is left out."""
    found = train.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c])) for c in columns if found[c]}


def binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """_x_ columns: number of the bin, -1 for a missing value."""
    def number(c: str) -> Column:
        total = F.lit(0)
        for e in edges[c]:
            total = total + (F.col(c) > e).cast("int")
        return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), -1).otherwise(total).cast("double")

    return df.withColumns({f"_x_{c}": number(c) for c in edges})


def boosted_stages(edges: dict, indexed: Sequence[str], trees: int, depth: int, rate: float, seed: int) -> list:
    gbt = GBTClassifier(labelCol="_y", featuresCol="_v", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=64, predictionCol="_c").setProbabilityCol("_p").setRawPredictionCol("_r")
    return [VectorAssembler(inputCols=[*[f"_x_{c}" for c in edges], *indexed], outputCol="_v"), gbt]


def boosted(train: DataFrame, columns: Sequence[str], y: str, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 1, categories: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A function that adds p to rows. Missing values have a bin of their own, so that trees can split on them.

    Categories (of 60 values at most) are split as sets of values; a missing or unknown one is a value of its own.
    """
    edges = bin_edges(train, columns)
    if categories:
        from pyspark.ml.feature import StringIndexer

        index = StringIndexer(inputCols=list(categories), outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
        if too_many := [c for c, labels in zip(categories, index.labelsArray, strict=True) if len(labels) > 60]:
            raise ContractError(f"too many values for a category: {too_many}")
        plain = boosted_stages(edges, [f"_i_{c}" for c in categories], trees, depth, rate, seed)
        made = Pipeline(stages=plain).fit(index.transform(binned(train.withColumn("_y", F.col(y).cast("double")), edges)))
        extra = [f"_i_{c}" for c in categories]
        return lambda rows: made.transform(index.transform(binned(rows, edges))).withColumn("p", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_c", *extra, *[f"_x_{c}" for c in edges])
    model = Pipeline(stages=boosted_stages(edges, [], trees, depth, rate, seed)).fit(binned(train.withColumn("_y", F.col(y).cast("double")), edges))
    return lambda rows: model.transform(binned(rows, edges)).withColumn("p", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_c", *[f"_x_{c}" for c in edges])


def logistic(train: DataFrame, columns: Sequence[str], y: str, ridge: float = 0.0, weight: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Logistic baseline: medians for missing values with a flag for each, standardised inside the fit."""
    medians = {c: (r := quantiles(train, c, [0.5]).first()) and r["q"][0] for c in columns}
    known = [c for c in columns if medians[c] is not None]

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in known} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in known})

    stage = VectorAssembler(inputCols=[f"_f_{c}" for c in known] + [f"_m_{c}" for c in known], outputCol="_v")
    lr = LogisticRegression(labelCol="_y", featuresCol="_v", regParam=ridge, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", maxIter=50, **({"weightCol": weight} if weight else {}))
    model = Pipeline(stages=[stage, lr]).fit(filled(train.withColumn("_y", F.col(y).cast("double"))))
    return lambda rows: model.transform(filled(rows)).withColumn("p", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_c", *[f"_{k}_{c}" for c in known for k in "fm"])


def isotonic(train: DataFrame, y: str = "y", p: str = "p") -> Callable[[DataFrame], DataFrame]:
    """Monotone calibration, fitted on rows summed by score."""
    per = train.groupBy(F.col(p).alias("_p")).agg(F.avg(y).alias("_y"), F.count("*").cast("double").alias("_w"))
    model = IsotonicRegression(labelCol="_y", featuresCol="_p", weightCol="_w", predictionCol="p_cal").fit(per)
    return lambda rows: model.transform(rows.withColumn("_p", F.col(p).cast("double"))).drop("_p")


def platt(train: DataFrame, y: str = "y", p: str = "p", eps: float = 1e-6) -> tuple[float, float]:
    """(intercept, slope) of a logistic recalibration of the score's logit; scores of 0 and 1 count as eps beside them."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return weighted_platt(train.select(F.col(y).cast("double").alias("_y"), F.ln(q / (1 - q)).alias("_l"), F.lit(1.0).alias("_w")), "_l", "_y", "_w")


def weighted_platt(rows: DataFrame, logit: str, y: str, weight: str) -> tuple[float, float]:
    data = VectorAssembler(inputCols=[logit], outputCol="_v").transform(rows)
    model = LogisticRegression(labelCol=y, featuresCol="_v", weightCol=weight, regParam=0.0, maxIter=100).fit(data)
    return float(model.intercept), float(model.coefficients[0])


def logistic_baseline(train: DataFrame, y: str, spline: str, logged: Sequence[str], categories: Sequence[str], ridge: float = 0.01) -> Callable[[DataFrame], DataFrame]:
    """The published baseline: a spline of one column, logarithms of others (medians for missing values), a column for each level of
    categories (the most frequent one for missing values), all standardised inside the fit."""
    from tidemark.operators.prep import spline_basis, spline_knots

    medians = {c: quantiles(train, c, [0.5]).first()["q"][0] for c in [spline, *logged]}
    knots = spline_knots(train, spline)
    levels = {c: [r[0] for r in train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(100).collect()] for c in categories}

    def made(df: DataFrame) -> DataFrame:
        cols = {f"_s{i}": b for i, b in enumerate(spline_basis(F.coalesce(F.col(spline).cast("double"), F.lit(float(medians[spline]))), knots))}
        cols |= {f"_l_{c}": F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))), F.lit(0.0))) for c in logged}
        cols |= {f"_c_{c}_{i}": (F.coalesce(F.col(c), F.lit(v[0])) == x).cast("double") for c, v in levels.items() for i, x in enumerate(v[1:])}
        return VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.withColumns(cols)).drop(*cols)

    model = LogisticRegression(labelCol="_y", featuresCol="_v", regParam=ridge, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", maxIter=50).fit(made(train.withColumn("_y", F.col(y).cast("double"))))
    return lambda rows: model.transform(made(rows)).withColumn("p", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_c")


def rolling_folds(origins: Sequence[int], embargo: int = EMBARGO, least: int = LEAST_ORIGINS) -> list[tuple[list[int], int]]:
    """(training origins, tested origin): training ends more than the embargo before the test, so that its labels are complete."""
    out = []
    for test in sorted(origins):
        train = [o for o in sorted(origins) if o < test - embargo]
        if len(train) >= least:
            out.append((train, test))
    return out


def rolling_scores(panel: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], origins: Sequence[int], keys: Sequence[str], y: str, origin: str = "origin_no", embargo: int = EMBARGO, least: int = LEAST_ORIGINS) -> DataFrame:
    """Out-of-time scores of every origin that has enough before it."""
    parts = []
    for train, test in rolling_folds(origins, embargo, least):
        scored = fit(panel.filter(F.col(origin).isin(train)))(panel.filter(F.col(origin) == test))
        parts.append(scored.select(*keys, origin, F.col(y).alias("y"), "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holdout(key: str | Column, share: int = 20, seed: int = 1) -> Column:
    """Whether a key, with all its rows, is held out."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key), F.lit(100)) < share


def rate_table(train: DataFrame, rows: DataFrame, cell: Sequence[str], y: str, least: int = 30) -> DataFrame:
    """Event rate of the cell, of its first key where the cell is small, of all rows where that is."""
    fine = train.groupBy(*cell).agg(F.avg(y).alias("_r0"), F.count("*").alias("_n0"))
    coarse = train.groupBy(cell[0]).agg(F.avg(y).alias("_r1"), F.count("*").alias("_n1"))
    whole = train.agg(F.avg(y).alias("_r2"))
    out = rows.join(fine, list(cell), "left").join(coarse, cell[0], "left").crossJoin(F.broadcast(whole))
    return out.withColumn("p", F.when(F.col("_n0") >= least, F.col("_r0")).when(F.col("_n1") >= least, F.col("_r1")).otherwise(F.col("_r2"))).drop("_r0", "_r1", "_r2", "_n0", "_n1")


def permuted(rows: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rows whose columns come, together, from another row: the order of keys meets the order of hashes.

    Row numbers are given inside parts of a hash of the key, of 50,000 rows each or so, so that no task orders all rows.
    """
    from pyspark.sql import Window as W

    parts = max(64, rows.count() // 50_000)
    h = F.xxhash64(F.lit(seed), F.col(key))
    a = rows.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(parts))).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(key)))
    b = rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).alias("_b"), h.alias("_h"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    b = b.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h"))).drop("_h")
    return a.join(b, ["_b", "_r"]).withColumns({c: F.col(f"_s_{c}") for c in columns}).drop("_b", "_r", *[f"_s_{c}" for c in columns])


def treatment_effect(rows: DataFrame, covariates: Sequence[str], treated: str, outcome: str, key: str, folds: int = 5, cut: float = 0.05, repeats: int = 1, learner: str = "linear", seed: int = 1) -> DataFrame:
    """Cross-fitted doubly robust average effect: one row with ate, se, limits, n and how many were treated.

    Each fold's nuisance models (linear, or boosted trees) come from the other folds; the orthogonal score is a plain column, its mean and
    spread one aggregation. With repeats, folds are drawn anew each time: the median of the effects counts, and its error takes in how far they lie apart.
    """
    if repeats > 1:
        once = [treatment_effect(rows, covariates, treated, outcome, key, folds, cut, 1, learner, seed + k).first().asDict() for k in range(repeats)]
        median = lambda v: sorted(v)[len(v) // 2] if len(v) % 2 else sum(sorted(v)[len(v) // 2 - 1 : len(v) // 2 + 1]) / 2
        ate = median([r["ate"] for r in once])
        se = median([r["se"] ** 2 + (r["ate"] - ate) ** 2 for r in once]) ** 0.5
        return rows.sparkSession.createDataFrame([(ate, se, ate - 1.96 * se, ate + 1.96 * se, once[0]["n"], once[0]["n_treated"])], "ate double, se double, low double, high double, n long, n_treated long")
    assembler = VectorAssembler(inputCols=list(covariates), outputCol="_v")
    data = assembler.transform(rows.select(key, F.col(treated).cast("double").alias("_d"), F.col(outcome).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in covariates]).dropna())
    data = data.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)))
    parts = None
    for k in range(folds):
        train, test = data.filter(F.col("_fold") != k), data.filter(F.col("_fold") == k)
        if learner == "boosted":
            ps = GBTClassifier(labelCol="_d", featuresCol="_v", maxIter=20, maxDepth=3, seed=seed, predictionCol="_pc").setProbabilityCol("_ps").setRawPredictionCol("_pr").fit(train)
            g1, g0 = (GBTRegressor(labelCol="_y", featuresCol="_v", maxIter=20, maxDepth=3, seed=seed, predictionCol=f"_g{k}").fit(train.filter(F.col("_d") == k)) for k in (1, 0))
        else:
            ps = LogisticRegression(labelCol="_d", featuresCol="_v", regParam=0.01, probabilityCol="_ps", rawPredictionCol="_pr", predictionCol="_pc").fit(train)
            g1, g0 = (LinearRegression(labelCol="_y", featuresCol="_v", regParam=0.01, predictionCol=f"_g{k}").fit(train.filter(F.col("_d") == k)) for k in (1, 0))
        scored = g0.transform(g1.transform(ps.transform(test))).withColumn("_e", F.greatest(F.least(vector_to_array("_ps")[1], F.lit(1 - cut)), F.lit(cut))).select("_d", "_y", "_e", "_g1", "_g0")
        parts = scored if parts is None else parts.unionByName(scored)
    psi = F.col("_g1") - F.col("_g0") + F.col("_d") * (F.col("_y") - F.col("_g1")) / F.col("_e") - (1 - F.col("_d")) * (F.col("_y") - F.col("_g0")) / (1 - F.col("_e"))
    out = parts.agg(F.avg(psi).alias("ate"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"), F.sum("_d").cast("long").alias("n_treated"))
    return out.select("ate", "se", (F.col("ate") - 1.96 * F.col("se")).alias("low"), (F.col("ate") + 1.96 * F.col("se")).alias("high"), "n", "n_treated")
