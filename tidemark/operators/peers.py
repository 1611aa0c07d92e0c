"""Peers of a row and the explanation of its score."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import numbered, quantiles_of
from tidemark.semantics import average_rank_share


def peer_statistics(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Each row's place among its peers, their number and their median."""
    table = numbered(rows, value, by)
    medians = quantiles_of(table, [0.5], by).select(*by, F.get("q", F.lit(0)).alias("peer_median"), F.col("total").alias("peer_n"))
    places = table.select(*by, F.col("value").alias("_v"), ((F.col("upto") - F.col("n") + (F.col("n") + 1) / 2) / F.col("total")).alias("peer_pct"))
    placed = rows.join(places.withColumnRenamed("_v", value), [*by, value], "left")
    return placed.join(medians, list(by), "left").withColumn("peer_n", F.coalesce("peer_n", F.lit(0)))


def peer_fallback(rows: DataFrame, value: str, levels: Sequence[Sequence[str]], least: int = 30) -> DataFrame:
    """Place among the peers of the first level that has enough; a coarser level always has all of its rows."""
    out, share, level = rows, None, None
    for i, by in enumerate(levels):
        n = F.count(value).over(W.partitionBy(*by))
        out = out.withColumn(f"_p{i}", average_rank_share(value, by)).withColumn(f"_n{i}", n)
        ok = F.col(f"_n{i}") >= least if i < len(levels) - 1 else F.lit(True)
        share = F.when(ok, F.col(f"_p{i}")) if share is None else share.when(ok, F.col(f"_p{i}"))
        level = F.when(ok, i) if level is None else level.when(ok, i)
    return out.withColumn("peer_pct", share).withColumn("peer_level", level).drop(*[f"_{k}{i}" for i in range(len(levels)) for k in "pn"])


def shapley(rows: DataFrame, background: DataFrame, factors: dict[str, Sequence[str]], score: Callable[[dict[str, Column]], Column], key: str, most_background: int = 1000) -> DataFrame:
    """(key, factor, contribution, base): exact Shapley values of factors, each a group of columns.

    Each row meets each of a bounded number of background rows and each of 2^F coalitions, whose columns come from the row, the others from the
    background. Means by row and coalition are taken before coalitions are compared, so what is shuffled is 2^F numbers for each row.
    """
    names = list(factors)
    n = len(names)
    if n > 12 or background.count() > most_background:
        raise ValueError(f"at most 12 factors and {most_background} background rows")
    columns = [c for group in factors.values() for c in group]
    b = background.select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    each = rows.select(key, *columns).crossJoin(F.broadcast(b)).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    taken = {c: F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.col(f"_b_{c}")) for i, name in enumerate(names) for c in factors[name]}
    value = each.groupBy(key, "mask").agg(F.avg(score(taken)).alias("v"))
    whole = value.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("mask", "v"))).alias("m"))
    weights = {m: math.factorial(bin(m).count("1")) * math.factorial(n - bin(m).count("1") - 1) / math.factorial(n) for m in range(2**n - 1)}
    parts = []
    for i, name in enumerate(names):
        total = F.lit(0.0)
        for m in (m for m in range(2**n) if not m >> i & 1):
            total = total + weights[m] * (F.element_at("m", F.lit(m | 1 << i)) - F.element_at("m", F.lit(m)))
        parts.append(F.struct(F.lit(name).alias("factor"), total.alias("contribution")))
    return whole.select(key, F.element_at("m", F.lit(0)).alias("base"), F.element_at("m", F.lit(2**n - 1)).alias("score"), F.explode(F.array(*parts)).alias("x")).select(key, "x.factor", "x.contribution", "base", "score")


def top_factor(long: DataFrame, key: str) -> DataFrame:
    return long.groupBy(key).agg(F.max_by("factor", F.struct("contribution", F.expr("-ascii(factor)"))).alias("top_factor"), F.max("contribution").alias("top_contribution"))


def compare_explanations(a: DataFrame, b: DataFrame, key: str, dead: float = 0.001) -> DataFrame:
    """Two explanations of the same rows side by side: whether a factor's direction differs."""
    from tidemark.operators.publish import direction

    x = a.select(key, "factor", direction("contribution", dead).alias("direction_a"), F.col("contribution").alias("contribution_a"))
    y = b.select(key, "factor", direction("contribution", dead).alias("direction_b"), F.col("contribution").alias("contribution_b"))
    return x.join(y, [key, "factor"]).withColumn("sensitive", F.col("direction_a") != F.col("direction_b"))


def ranked(long: DataFrame, keys: Sequence[str], contribution: str, tie: str) -> DataFrame:
    """rank: the place of each row of a key by contribution, largest first, ties by a given order."""
    return long.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(contribution), tie)))


def category_totals(long: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str], value: str, needed: str) -> DataFrame:
    """Sums of a value by category, a column each with 0 for none, and whether a category is there at all."""
    return long.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(category) == c, F.col(value))), F.lit(0.0)).alias(c) for c in categories], (F.count_if(F.col(category) == needed) > 0).alias("available"))


def inner_driver(rows: DataFrame, background: DataFrame, others: Sequence[str], inner: Sequence[str], score: Callable[[dict[str, Column]], Column], key: str, sign: Column) -> DataFrame:
    """For each row the column of one factor that acts most in the factor's direction (sign: 1 or -1), all other columns together being one player."""
    long = shapley(rows, background, {"_others": list(others), **{c: [c] for c in inner}}, score, key).filter("factor <> '_others'")
    return long.groupBy(key).agg(F.max_by("factor", F.struct(F.col("contribution") * sign, "factor")).alias("driver"), F.max(F.col("contribution") * sign).alias("driver_value"))
