"""Joins that never lose or add rows of the left side: as-of, lagged, full, grid, cascade and eligibility joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.contracts import ContractError, require_unique
from tidemark.semantics import quarter_label, quarter_of_label


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "table", check: bool = True) -> DataFrame:
    """Left join to a side with unique keys; columns of both sides must not clash. Missing keys never match."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ContractError(f"{name}: columns of both sides: {sorted(clash)}")
    return left.join(require_unique(right, keys, name) if check else right, list(keys), "left")


def strict_asof(panel: DataFrame, prices: DataFrame, published: DataFrame, key: str, end: str = "origin_end", value: str = "price") -> DataFrame:
    """The value of the latest year published at the origin's end; missing there stays missing, no other year fills it.

    published: (year, available_at), a handful of rows; the year is chosen for each origin, not for each row.
    """
    origins = panel.select(end).distinct()
    chosen = origins.join(F.broadcast(published), F.col("available_at") <= F.col(end))
    chosen = chosen.groupBy(end).agg(F.max_by("year", F.struct("available_at", "year")).alias("year"), F.max("available_at").alias("available_at"))
    dated = panel.join(F.broadcast(chosen), end, "left")
    return dated.join(prices.select(key, "year", value), [key, "year"], "left")


def lagged(panel: DataFrame, table: DataFrame, keys: Sequence[str], lag: int = 1, quarter: str = "quarter") -> DataFrame:
    """The value of an earlier quarter. lag must be one at least: a quarter's own value isn't known at its end."""
    if lag < 1:
        raise ContractError("a lag of one quarter or more is needed")
    dated = panel.withColumn("quarter_used", quarter_label(quarter_of_label("origin") - lag))
    return dated.join(table.withColumnRenamed(quarter, "quarter_used"), [*keys, "quarter_used"], "left")


def full_series(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of series with unique keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), tables)


def complete_grid(domains: Sequence[DataFrame], facts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every combination of small key domains, with what is observed of it and a mark for each fact table."""
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), domains)
    for i, fact in enumerate(facts):
        grid = grid.join(fact.withColumn(f"has_{i}", F.lit(True)), list(keys), "left").withColumn(f"has_{i}", F.coalesce(f"has_{i}", F.lit(False)))
    return grid


def _counted(known: DataFrame, key: Sequence[str], entity: str, first: int = 5) -> DataFrame:
    """For each key of different (key, entity) how many entities it has (n), and the smallest ones in order (found)."""
    of = known.withColumns({f"_{i}": F.col(k) for i, k in enumerate(key)}).select(*[f"_{i}" for i in range(len(key))], F.col(entity).alias("_e"))
    of = of.withColumn("_r", F.row_number().over(W.partitionBy(*of.columns[:-1]).orderBy("_e"))).filter(F.col("_r") <= first)
    of = of.groupBy(*of.columns[:-2]).agg(F.array_sort(F.collect_list("_e")).alias("found"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)])
    return known.groupBy(*key).agg(F.count("*").cast("int").alias("n")).join(of, same).select(*key, "n", "found")


def tiers(left: DataFrame, right: DataFrame, variants: Sequence[tuple[int, str, str]], block: str, id: str, entity: str) -> DataFrame:
    """Exact joins in the order of variants (tier, left key, right key), each inside a block.

    A row's first variant with one entity decides; if no variant has one, it is ambiguous by the last variant that found any. Rows
    that no variant finds are absent. One job for all variants. Entities are counted for each key before the join, so that a key
    costs its rows of both sides, not their product; only ids that stand with several keys meet the entities themselves.
    """
    found = []
    for order, (tier, a, b) in enumerate(variants):
        key = [block, "_k"]
        own = left.filter(F.col(a).isNotNull() & F.col(block).isNotNull()).select(id, block, F.col(a).alias("_k")).distinct()
        own = own.withColumn("_n", F.count("*").over(W.partitionBy(id)))
        known = right.filter(F.col(b).isNotNull() & F.col(entity).isNotNull()).select(block, F.col(b).alias("_k"), entity).distinct()
        one = own.filter("_n = 1").join(_counted(known, key, entity), key)
        several = _counted(own.filter("_n > 1").join(known, key).select(id, entity).distinct(), [id], entity)
        each = one.select(id, "n", "found").unionByName(several.select(id, "n", "found"))
        found.append(each.select(id, F.lit(tier).alias("tier"), F.lit(order).alias("variant"), "n", "found"))
    every = reduce(DataFrame.unionByName, found)
    only = F.col("n") == 1
    rank = F.row_number().over(W.partitionBy(id).orderBy(F.when(only, 0).otherwise(1), F.when(only, F.col("variant")).otherwise(-F.col("variant"))))
    first = every.withColumn("_r", rank).filter("_r = 1")
    return first.select(
        id, "tier", "variant", only.alias("matched"), (~only).alias("ambiguous"), F.col("n").alias("n_candidates"), F.when(only, F.element_at("found", 1)).alias(entity),
        F.when(~only, F.concat_ws("|", "found")).alias("candidates"),
    )


def best_with_margin(scored: DataFrame, id: str, entity: str, score: str, threshold: float, margin: float, crowded: int = 20, crowded_least: float | None = None) -> DataFrame:
    """The best entity of each row, if its score passes the threshold and the runner-up's by the margin."""
    per = scored.groupBy(id, entity).agg(F.max(score).alias("score"))
    n = per.groupBy(F.col(id).alias("_id")).agg(F.count("*").alias("n_candidates"))
    return _judged(per, n, id, entity, threshold, margin, crowded, crowded_least)


def _judged(per: DataFrame, n: DataFrame, id: str, entity: str, threshold: float, margin: float, crowded: int, crowded_least: float | None) -> DataFrame:
    """per: (id, entity, score), the two best entities of each id at least; n: (_id, n_candidates)."""
    w = W.partitionBy(id).orderBy(F.desc("score"), entity)
    ranked = per.withColumn("_r", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(-1.0)))
    ranked = ranked.filter("_r = 1").join(n, F.col(id).eqNullSafe(F.col("_id")))
    passed, clear = F.col("score") >= threshold, F.col("score") - F.col("second") >= margin
    busy = F.col("n_candidates") > crowded
    weak = busy & (F.col("score") < crowded_least) if crowded_least is not None else F.lit(False)
    matched = passed & clear & ~weak
    reason = F.when(matched, F.lit(None).cast("string")).when(~passed, "below_threshold").when(~clear, "ambiguous").otherwise("crowded_low_score")
    return ranked.select(id, F.col("score"), "n_candidates", busy.alias("crowded"), matched.alias("matched"), (passed & ~matched).alias("ambiguous"), F.when(matched, F.col(entity)).alias(entity), reason.alias("reason"))


def best_of_texts(left: DataFrame, right: DataFrame, block: str, id: str, entity: str, text: str, score: Callable[[DataFrame, str, str, str], DataFrame], threshold: float, margin: float, crowded: int = 20, crowded_least: float | None = None) -> DataFrame:
    """best_with_margin() of all pairs inside a block, scored by score(pairs, a, b, out) of their texts, without making the pairs.

    Each different pair of texts of a block is scored once. Of the entities that share a text only the two smallest can be among
    a row's two best, so that only these are ranked; candidates are counted apart.
    """
    mine = left.filter(F.col(block).isNotNull()).select(id, block, F.col(text).alias("_a")).distinct()
    theirs = right.filter(F.col(block).isNotNull()).select(block, F.col(text).alias("_b"), entity).distinct()
    few = theirs.withColumn("_r", F.row_number().over(W.partitionBy(block, "_b").orderBy(entity))).filter("_r <= 2").select(F.col(block).alias("_block"), F.col("_b").alias("_c"), entity)
    scored = score(mine.select(block, "_a").distinct().join(theirs.select(block, "_b").distinct(), block), "_a", "_b", "score")
    top = scored.join(few, (F.col(block) == F.col("_block")) & F.col("_b").eqNullSafe(F.col("_c"))).groupBy("_block", "_a", entity).agg(F.max("score").alias("score"))
    top = top.withColumn("_r", F.row_number().over(W.partitionBy("_block", "_a").orderBy(F.desc("score"), entity))).filter("_r <= 2").withColumnRenamed("_a", "_t")
    per = mine.join(top, (F.col(block) == F.col("_block")) & F.col("_a").eqNullSafe(F.col("_t"))).groupBy(id, entity).agg(F.max("score").alias("score"))
    held, blocks = theirs.select(block, entity).distinct(), mine.select(id, block).distinct().withColumn("_n", F.count("*").over(W.partitionBy(id)))
    one = blocks.filter("_n = 1").join(held.groupBy(block).agg(F.count("*").alias("n_candidates")), block).select(F.col(id).alias("_id"), "n_candidates")
    several = blocks.filter("_n > 1").join(held, block).select(F.col(id).alias("_id"), entity).distinct().groupBy("_id").agg(F.count("*").alias("n_candidates"))
    return _judged(per, one.unionByName(several), id, entity, threshold, margin, crowded, crowded_least)


def remaining(left: DataFrame, attempted: DataFrame, id: str) -> DataFrame:
    """Rows that an earlier tier hasn't tried."""
    return left.join(attempted.select(id), id, "left_anti")


def new_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Judgements of both rounds; where both have one, the new one counts."""
    a, b = old.select(*keys, F.col(value).alias("_old")), new.select(*keys, F.col(value).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_new", "_old").alias(value), F.when(F.col("_new").isNull(), "carried").otherwise("new").alias("origin_of_value"))


def changed_rows(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two runs, missing counting as a value."""
    a, b = base.select(key, F.col(value).alias("before")), new.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


def eligible(stores: DataFrame, policies: DataFrame, wildcard: dict[str, str], tenure: str = "tenure_months", small: int = 10_000) -> DataFrame:
    """Stores and policies whose conditions they meet.

    wildcard: store column -> policy column with a list of allowed values, missing for any. Unknown tenure where a policy
    bounds it means check_required. Lists are exploded into an equi-join on the first condition, with a key for `any`; the
    catalogue is broadcast if it has `small` rows at most.
    """
    first = next(iter(wildcard.items()))
    p = policies.withColumn("_k", F.explode(F.coalesce(F.col(first[1]).cast("array<string>"), F.array(F.lit("\0any")))))
    s = stores.withColumn("_k", F.explode(F.array(F.coalesce(F.col(first[0]).cast("string"), F.lit("\0none")), F.lit("\0any"))))
    sent = F.broadcast(p) if policies.count() <= small else p
    rest = [F.col(c).isNull() | F.coalesce(F.array_contains(F.col(c), F.col(v)), F.lit(False)) for v, c in list(wildcard.items())[1:]]
    bounded = F.col("tenure_min").isNotNull() | F.col("tenure_max").isNotNull()
    t = F.col(tenure)
    within = (F.col("tenure_min").isNull() | (t >= F.col("tenure_min"))) & (F.col("tenure_max").isNull() | (t <= F.col("tenure_max")))
    pairs = s.join(sent, "_k").drop("_k")
    for r in rest:
        pairs = pairs.filter(r)
    pairs = pairs.filter(~bounded | t.isNull() | within)
    check = (bounded & t.isNull()) | (F.size(F.coalesce("unverifiable", F.array().cast("array<string>"))) > 0)
    return pairs.withColumn("eligibility", F.when(check, "check_required").otherwise("matched"))


def first_reason(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(default)


def candidate_keys(variants: DataFrame, entities: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Every different key of an entity's name variants, with what is known of the entity."""
    return variants.select(*keys).distinct().join(entities, entity, "left")


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables row by row on unique keys; a key that only one of them has stops the run."""
    require_unique(a, keys, "first")
    require_unique(b, keys, "second")
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), list(keys), "full_outer")
    if not both.filter("_a IS NULL OR _b IS NULL").isEmpty():
        raise ContractError("keys of only one side")
    return both.drop("_a", "_b")


def flagged(df: DataFrame, lookup: DataFrame, column: str, choices: Sequence[Sequence[str]]) -> DataFrame:
    """df with a flag from a look-up, by the first choice of keys that the look-up has; a row without a partner stops the run."""
    keys = next((list(k) for k in choices if all(c in lookup.columns for c in k)), None)
    if keys is None:
        raise ContractError(f"none of {list(choices)} is in the look-up")
    out = attach(df, lookup.select(*keys, column), keys)
    if not out.filter(F.col(column).isNull()).isEmpty():
        raise ContractError(f"rows without {column}")
    return out


def membership_rate(rows: DataFrame, reference: DataFrame, key: str, by: str) -> DataFrame:
    """Share of each group's keys that a reference has."""
    known = reference.select(key).distinct().withColumn("_known", F.lit(1))
    return rows.join(known, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.avg(F.coalesce("_known", F.lit(0))).alias("rate"))


def best_two(scored: DataFrame, id: str, entity: str, score: str, margin: float) -> DataFrame:
    """For each id its best entity and the score of the next one; ambiguous if that is nearer than the margin."""
    per = scored.groupBy(id, entity).agg(F.max(score).alias(score))
    top = per.groupBy(id).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(entity).alias("e")))), 1, 2).alias("_t"))
    best, following = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    return top.select(id, best["e"].alias("best"), F.bround(-best["o"], 4).alias("score"), F.bround(-following["o"], 4).alias("runner_up"), F.coalesce(F.bround(following["o"] - best["o"], 4) < margin, F.lit(False)).alias("ambiguous"))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order that leaves no ties; an aggregation, so that rows are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def ends_by_order(df: DataFrame, key: str, id: str, order: Sequence[str]) -> DataFrame:
    """For each key its first and its last id in an order, and how many rows it has."""
    by = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(id, by).alias("first"), F.max_by(id, by).alias("last"), F.count("*").alias("n"))


def unambiguous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that stand for one value only, with it."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), (F.min(value) == F.max(value)).alias("_one")).filter("_one").drop("_one")
