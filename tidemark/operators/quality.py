"""Quality tables: missing shares, coverage, match rates, crosstabs, and the contracts of steps, reports and releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import contracts as C


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, name and value (as text) of each cell of some columns; an explode in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*by, cells.alias("_c")).select(*by, "_c.name", "_c.value")


def missing_rates(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """How much of each column is missing, of all rows (group "all") and by the values of one column."""
    group = F.array(F.lit("all"), F.col(by).cast("string")) if by else F.array(F.lit("all"))
    counts = df.select(F.explode(group).alias("grp"), *columns).groupBy("grp").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_missing")) for c in columns]))
    return counts.select("grp", "n", cells.alias("_c")).select("grp", "n", "_c.name", "_c.n_missing", (F.col("_c.n_missing") / F.col("n")).alias("share"))


def coverage(df: DataFrame, by: str, columns: Sequence[str], first: str) -> DataFrame:
    """For each origin: rows, what the first column says (it must say one thing), and how many values each column has."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(first).alias(first), (F.min(first) != F.max(first)).alias("differs"), *[F.count(c).alias(f"n_{c}") for c in columns])


def match_rates(df: DataFrame, by: Sequence[str], matched: str, ambiguous: str) -> DataFrame:
    """Rows, matches and their share by the values of each column, a missing value being one of them."""
    groups = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("grp")) for c in by]))
    return df.select(groups.alias("_g"), matched, ambiguous).groupBy("_g.dim", "_g.grp").agg(F.count("*").alias("n"), F.count_if(S.flag(F.col(matched))).alias("n_matched"), F.avg(S.flag(F.col(matched)).cast("int")).alias("rate"), F.count_if(S.flag(F.col(ambiguous))).alias("n_ambiguous"))


def maturity_table(monthly: DataFrame, last_day: Column, share: float, recent: int = 6, window: int = 6) -> DataFrame:
    """The last months' counts beside the median of the months before: months_ago 0 is a month that isn't over.

    monthly: month_no, n. A month is flagged below `share` of its baseline.
    """
    w = W.orderBy("month_no").rowsBetween(-window, -1)
    last = F.year(last_day) * 12 + F.month(last_day) - 1
    before = F.array_sort(F.collect_list("n").over(w))
    size = F.size(before)
    median = F.when(size > 0, (F.get(before, F.floor((size - 1) / 2).cast("int")) + F.get(before, F.floor(size / 2).cast("int"))) / 2)
    t = monthly.withColumn("baseline", median).withColumn("months_ago", last - F.col("month_no")).filter(F.col("months_ago").between(0, recent - 1))
    return t.select("month_no", "months_ago", "n", F.bround("baseline", 1).alias("baseline"), F.when(F.col("baseline") > 0, F.bround(F.col("n") / F.col("baseline"), 2)).alias("share"), S.flag(F.col("n") < share * F.col("baseline")).alias("flagged"), (F.col("months_ago") == 0).alias("partial"))


def precision(df: DataFrame, keep: Column, label: str, stratum: str, sizes: DataFrame) -> DataFrame:
    """A rule on a labelled sample: how many it keeps, their precision if unclear ones are wrong or right, what it loses and removes, and
    the precision weighted by the strata's sizes in the population (stratum, size)."""
    k, good, bad, unclear = S.flag(keep), F.col(label) == "same", F.col(label) == "other", F.col(label) == "unclear"
    s = df.withColumn("_k", k).groupBy(stratum).agg(F.count_if("_k").alias("kept"), F.count_if(F.col("_k") & good).alias("good"), F.count_if(F.col("_k") & unclear).alias("unclear"), F.count_if(~F.col("_k") & good).alias("lost"), F.count_if(~F.col("_k") & bad).alias("removed"))
    s = s.join(F.broadcast(sizes), stratum, "left").withColumn("_w", F.when(F.col("kept") > F.col("unclear"), F.col("size")))
    clear = F.col("kept") - F.col("unclear")
    return s.agg(*[F.sum(c).alias(c) for c in ("kept", "good", "unclear", "lost", "removed")], (F.sum("good") / F.sum("kept")).alias("low"), ((F.sum("good") + F.sum("unclear")) / F.sum("kept")).alias("high"), (F.sum(F.col("_w") * F.col("good") / clear) / F.sum("_w")).alias("weighted"))


def overlap_table(df: DataFrame, starts: tuple[str, str], ends: tuple[str, str], as_of: Column, least: int = 90) -> DataFrame:
    """Days that two periods share (an open end is the as-of day), and how many pairs share at least so many, by who is open."""
    end = [F.least(F.coalesce(F.col(e), as_of), as_of) for e in ends]
    days = F.datediff(F.least(*end), F.greatest(*[F.col(s) for s in starts]))
    return df.select(F.col(ends[0]).isNull().alias("open_a"), F.col(ends[1]).isNull().alias("open_b"), (days >= least).alias("long_overlap")).groupBy("open_a", "open_b", "long_overlap").agg(F.count("*").alias("n"))


def reissue_counts(links: DataFrame, old: str, new: str, ambiguous: str) -> DataFrame:
    """Links in all, ambiguous ones, and ids that stand in several of the plain ones on either side."""
    plain = links.filter(~S.flag(F.col(ambiguous)))
    many = lambda c: plain.groupBy(c).count().filter("count > 1").agg(F.count("*").alias(f"many_{c}"))
    return links.agg(F.count("*").alias("n_links"), F.count_if(S.flag(F.col(ambiguous))).alias("n_ambiguous")).crossJoin(F.broadcast(many(old))).crossJoin(F.broadcast(many(new)))


def na_composition(df: DataFrame, value: str, causes: dict[str, Column]) -> DataFrame:
    """Missing values by the first cause that holds, and those without one; shares of all rows."""
    cause = F.lit("other")
    for name, rule in reversed(causes.items()):
        cause = F.when(S.flag(rule), name).otherwise(cause)
    total = df.agg(F.count("*").alias("_n"))
    return df.filter(F.col(value).isNull()).groupBy(cause.alias("cause")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("cause", "n", (F.col("n") / F.col("_n")).alias("share"))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median, 99th percentile (approximate to a millionth of the rows), and how many values are zero, negative or missing."""
    v = F.col(value)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(v, [0.5, 0.99], 1_000_000).alias("_q"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.count_if(v.isNull()).alias("n_missing")).select(by, "n", F.get("_q", F.lit(0)).alias("p50"), F.get("_q", F.lit(1)).alias("p99"), "n_zero", "n_negative", "n_missing")


def seeds_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, least and largest of a figure over the seeds of each candidate."""
    return df.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("largest"))


def snapshot_quality(df: DataFrame, snapshot: str, district: str, key: str, length: int, missing: str, suspect: str, alert: float = 0.5) -> DataFrame:
    """For each snapshot and district: rows, share of keys of the right length, missing and suspect coordinates, and whether more than `alert`
    of the snapshot's are suspect."""
    per = df.groupBy(snapshot, district).agg(F.count("*").alias("n"), F.avg((F.length(key) == length).cast("int")).alias("valid_share"), F.count_if(missing).alias("n_missing"), F.count_if(suspect).alias("n_suspect"))
    w = W.partitionBy(snapshot)
    return per.withColumn("alert", F.sum("n_suspect").over(w) > alert * F.sum("n").over(w))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of pairs of values with their share of the row, in long form."""
    return df.groupBy(row, column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(row)))


def share_of_group(df: DataFrame, group: str, kind: str) -> DataFrame:
    return crosstab(df, group, kind)


def integrity(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The counters of C.counters() in long form: a row for each rule."""
    wide = C.counters(df, rules)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_broken")) for k in rules])).alias("r")).select("r.rule", "r.n_broken")


def structural(labels: DataFrame, stores: DataFrame, key: Sequence[str] = ("store_id", "origin")) -> DataFrame:
    """Structure of a label table against its stores: a row for each check."""
    own = integrity(labels, {"label_domain": ~F.col("event_12m").isin(0, 1) | F.col("event_12m").isNull(), "opened_after_end": F.col("license_date") > F.col("origin_end"), "closed_before_end": F.col("close_date") <= F.col("origin_end"), "negative_age": F.col("age_months") < 0})
    parts = [C.duplicate_keys(labels, key).agg(F.lit("duplicate_keys").alias("rule"), F.count("*").alias("n_broken")),
             labels.join(stores.select("store_id").distinct(), "store_id", "left_anti").agg(F.lit("unknown_store").alias("rule"), F.count("*").alias("n_broken"))]
    return own.unionByName(parts[0]).unionByName(parts[1])


def competition_checks(panel: DataFrame, table: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Checks of a competition table: keys that only one side has, doubled keys, negative counts."""
    differ = C.set_difference(panel, table, keys).agg(F.lit("keys_differ").alias("rule"), F.count("*").alias("n_broken"))
    doubled = C.duplicate_keys(table, keys).agg(F.lit("duplicate_keys").alias("rule"), F.count("*").alias("n_broken"))
    return integrity(table, {f"negative_{c}": F.col(c) < 0 for c in counts}).unionByName(differ).unionByName(doubled)


def broken_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Each row's broken rules, sorted; rows that break none don't appear. An unknown condition doesn't break."""
    found = F.filter(F.array(*[F.when(S.flag(rule), F.lit(name)) for name, rule in sorted(rules.items())]), lambda x: x.isNotNull())
    return df.select(key, found.alias("broken")).filter(F.size("broken") > 0)


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: whether a release may go out, and by which rules it may not."""
    wide = C.counters(df, rules)
    blockers = F.filter(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in sorted(rules)]), lambda x: x.isNotNull())
    return wide.select((F.size(blockers) == 0).alias("released"), F.array_join(blockers, ",").alias("blockers"))


def once_each(mapping: DataFrame, predictors: DataFrame, column: str = "predictor") -> DataFrame:
    """Predictors that a mapping of factors doesn't have once: how often it has them."""
    found = mapping.groupBy(column).agg(F.count("*").alias("n"))
    return predictors.select(column).distinct().join(found, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n")).join(predictors.select(column, F.lit(True).alias("_p")).distinct(), column, "left").filter((F.col("n") != 1) | F.col("_p").isNull()).drop("_p")


def same_run(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names of two runs' records (name, value) whose values differ, or that only one has."""
    x, y = a.select("name", F.col("value").alias("a")), b.select("name", F.col("value").alias("b"))
    return x.join(y, "name", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def undocumented(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Columns of df without a written definition (name, definition), and definitions of no column."""
    spark = df.sparkSession
    own = spark.createDataFrame([(c,) for c in df.columns], "name string").withColumn("_c", F.lit(True))
    both = own.join(definitions.filter(S.blank_to_null("definition").isNotNull()), "name", "full_outer")
    return both.filter(F.col("_c").isNull() | F.col("definition").isNull()).select("name", F.when(F.col("_c").isNull(), "no_column").otherwise("no_definition").alias("fault"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys only one of two tables has; both must be none."""
    return C.set_difference(a, b, [key]).groupBy().agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))


def set_contract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the keys of two tables are the same set, and whether one is a part of the other."""
    return C.set_difference(a, b, keys).agg(F.count_if(F.col("side") == "left").alias("_l"), F.count_if(F.col("side") == "right").alias("_r")).select(((F.col("_l") == 0) & (F.col("_r") == 0)).alias("equal"), (F.col("_l") == 0).alias("left_in_right"), (F.col("_r") == 0).alias("right_in_left"))


def disagreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """How many rows two rules for the same thing judge differently; an unknown condition counts as false."""
    return df.agg(F.count("*").alias("n"), F.count_if(S.flag(a) != S.flag(b)).alias("n_differ"))
