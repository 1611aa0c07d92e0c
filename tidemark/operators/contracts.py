"""Contracts: each gives one row of counters, so that many of them are one aggregation, or raises where a plan must stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.semantics import flag


class ContractError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    if not duplicate_keys(df, keys).limit(1).isEmpty():
        raise ContractError(f"{name}: {', '.join(keys)} not unique")
    return df


def counters(df: DataFrame, rules: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows break each rule; an unknown condition doesn't."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(flag(rule)).alias(name) for name, rule in rules.items()])


def require(df: DataFrame, rules: dict[str, Column], name: str = "table") -> DataFrame:
    found = counters(df, rules).first().asDict()
    broken = {k: v for k, v in found.items() if k != "n_rows" and v}
    if broken:
        raise ContractError(f"{name}: {broken}")
    return df


def fingerprint(df: DataFrame, keys: Sequence[str], label: str, origin: str = "origin") -> DataFrame:
    """What an enrichment must leave as it was: rows, keys, duplicates, events and the label's bytes."""
    key = F.struct(*keys)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.col(keys[0])).alias("n_stores"), (F.count("*") - F.count_distinct(key)).alias("n_duplicates"),
        F.sum(label).alias("n_events"), F.count_distinct(origin).alias("n_origins"), F.bit_xor(F.xxhash64(*keys, label)).alias("label_hash"),
    )


def verify_step(before: DataFrame, after: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row: which parts of the fingerprint a step changed."""
    a, b = fingerprint(before, keys, label), fingerprint(after, keys, label)
    same = [(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"same_{c}") for c in a.columns]
    return a.alias("a").crossJoin(b.alias("b")).select(*same)


def require_same(before: DataFrame, after: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    changed = [k for k, v in verify_step(before, after, keys, label).first().asDict().items() if not v]
    if changed:
        raise ContractError(f"a step changed {', '.join(c.removeprefix('same_') for c in changed)}")
    return after


def leakage(df: DataFrame, end: str, available: Sequence[str], asof: Sequence[str]) -> DataFrame:
    """Values that were known, or refer to a time, after the origin's end."""
    rules = {f"late_{c}": F.col(c) > F.col(end) for c in available} | {f"ahead_{c}": F.col(c) > F.col(end) for c in asof}
    return counters(df, rules)


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of only one side, with the side's name."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right")))


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each shared column, in how many rows two builds differ; rows of one side are counted apart."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    x, y = a.withColumn("_a", F.lit(1)).alias("x"), b.withColumn("_b", F.lit(1)).alias("y")
    both = x.join(y, list(keys), "full_outer")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
        *[F.count_if(there & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(f"differ_{c}") for c in shared],
    )


def origin_ends(panel: DataFrame) -> DataFrame:
    """Origins whose rows disagree about the end, or whose end is not the quarter's last day."""
    from tidemark.semantics import quarter_end, quarter_of_label

    ends = panel.groupBy("origin").agg(F.min("origin_end").alias("first"), F.max("origin_end").alias("last"))
    return ends.filter((F.col("first") != F.col("last")) | (F.col("last") != quarter_end(quarter_of_label("origin"))))
