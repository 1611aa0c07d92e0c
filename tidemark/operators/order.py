"""Exact quantiles and ranks of a whole column, without a task that has all of it.

Rows are first summed to one for each different value, so that equal rows weigh nothing. The values are dealt to ranges, written, and
numbered inside their range; how many rows the ranges before have is a sum over as many rows as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, upto, total): each different value that isn't null, how often it occurs, how many rows of its group are not above it, and
    how many the group has."""
    from tidemark.sources.writers import stored

    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    values = df.filter(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("value")).agg(F.count("*").alias("n"))
    ranged = values.repartitionByRange(*names, "value").withColumn("_range", F.spark_partition_id())
    table = df.sparkSession.read.schema(ranged.schema).parquet(stored(ranged, "ranges"))  # where a value lies must not change between the passes
    sizes = table.groupBy(*names, "_range").agg(F.sum("n").alias("_n"))
    w = W.partitionBy(*names)
    sizes = sizes.withColumn("_before", F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).withColumn("total", F.sum("_n").over(w)).drop("_n")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*names, "_range"]]
    joined = table.alias("t").join(sizes.alias("s"), same).select("t.*", "s._before", "s.total")
    upto = F.col("_before") + F.sum("n").over(W.partitionBy(*names, "_range").orderBy("value"))
    return joined.withColumn("upto", upto).select(*[F.col(n).alias(k) for n, k in zip(names, by, strict=True)], "value", "n", "upto", "total")


def quantiles(df: DataFrame, c: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): the quantiles of a column for some shares, linear between neighbours; null for a group without a value."""
    return quantiles_of(numbered(df, c, by), shares, by).drop("total")


def quantiles_of(table: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """quantiles() of a numbered() column, with how many values each group has (total).

    A value covers places upto - n to upto - 1 of its group. Places are joined by which 4096th of the group they lie in, so that a value meets
    the few that are sought there and no others.
    """
    part = lambda place: F.floor(place * 4096 / F.col("total"))
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    rows = table.select(*by, "value", first.alias("_first"), last.alias("_last"), F.explode(F.sequence(part(first), part(last))).alias("_part"))
    sizes = table.groupBy(*by).agg(F.max("total").alias("total"))
    sought = sizes.select(*by, "total", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_i", "_s")).withColumn("_at", (F.col("total") - 1) * F.col("_s"))
    sought = sought.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_part", part(F.col("_place")))
    sought = sought.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)], "total", "_i", (F.col("_at") - F.floor("_at")).alias("_f"), "_place", F.col("_part").alias("_sought"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(by)]
    on = [F.col("_part") == F.col("_sought"), F.col("_place").between(F.col("_first"), F.col("_last")), *same]
    found = rows.join(sought, on).groupBy(*by, "total", "_i").agg(F.min("value").cast("double").alias("_l"), F.max("value").cast("double").alias("_h"), F.max("_f").alias("_f"))
    q = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.col("_l") * (1 - F.col("_f")) + F.col("_h") * F.col("_f"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", q.alias("_q"))))  # one for each share
    return found.groupBy(*by).agg(F.transform(ordered, lambda x: x["_q"]).alias("q"), F.max("total").alias("total"))


def mean_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """df with the rank of a column's value among all rows, ties at their mean rank; null for a null."""
    ranks = numbered(df, c).select(F.col("value").alias("_v"), (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(c) == F.col("_v"), "left").drop("_v")
