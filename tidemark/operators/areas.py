"""Area tables: observed-partial sums, last changes, competition counts, mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.semantics import ratio


def last_change(df: DataFrame, value: str, by: Sequence[str], time: str) -> Column:
    """The time at which the value last changed. Missing after missing counts as a change: nothing says that it is the same."""
    w = W.partitionBy(*by).orderBy(time)
    changed = F.col(value).isNull() | F.lag(value).over(w).isNull() | (F.col(value) != F.lag(value).over(w))
    return F.last(F.when(changed, F.col(time)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def observed_partial(grid: DataFrame, keys: Sequence[str], expected: Column) -> DataFrame:
    """Sums over the codes that were observed, how many of those expected these are, and rates made anew from the sums.

    grid: code rows with has_0 (a store row), has_1 (a sales row), total, opened, closed, sales. A sum without any observed row is missing.
    """
    g = grid.withColumn("_sales_total", F.when(F.col("has_1"), F.col("total")))
    out = g.groupBy(*keys).agg(
        F.count_if("has_0").alias("n_store"), F.count_if("has_1").alias("n_sales"), F.sum("total").alias("store_total"), F.sum("opened").alias("opened"), F.sum("closed").alias("closed"),
        F.sum("sales").alias("sales_amt"), F.sum("_sales_total").alias("sales_total"), F.count_if(F.col("has_1") & ~F.col("has_0")).alias("n_unpaired"), F.max(expected).alias("n_expected"),
    )
    whole = F.col("n_unpaired") == 0
    covered = F.when(whole, ratio(F.coalesce("sales_total", F.lit(0)).cast("double"), F.col("store_total")))
    per_store = F.when(whole, ratio(F.col("sales_amt").cast("double"), F.col("sales_total")))
    return out.select(
        *keys, "n_store", "n_sales", "n_expected", (F.col("n_store") / F.col("n_expected")).alias("store_coverage"), (F.col("n_store") < F.col("n_expected")).alias("is_partial"), "store_total",
        (ratio(F.col("opened").cast("double"), F.col("store_total")) * 100).alias("open_rate"), (ratio(F.col("closed").cast("double"), F.col("store_total")) * 100).alias("close_rate"),
        "sales_amt", covered.alias("sales_store_coverage"), per_store.alias("sales_per_store"), "n_unpaired",
    )


def absence_evidence(grid: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """How cells pass between stores, an explicit zero and no row at all: one row of counts."""
    before = F.lag("total").over(W.partitionBy(*by).orderBy(time))
    g = grid.withColumn("_before", before)
    none, zero = ~F.col("has_0"), F.col("total") == 0
    c = F.count_if
    return g.agg(
        F.count("*").alias("n_cells"), c(none).alias("n_no_row"), c(zero).alias("n_zero"), c((F.col("_before") > 0) & none).alias("stores_to_no_row"), c((F.col("_before") > 0) & zero).alias("stores_to_zero"),
        c((F.col("_before") == 0) & none).alias("zero_to_no_row"), c(none & F.col("has_1")).alias("sales_without_row"), c(~F.col("has_1") & (F.col("total") > 0)).alias("stores_without_sales"), c(F.col("sales") == 0).alias("n_zero_sales"),
    )


def suppression_by_size(grid: DataFrame) -> DataFrame:
    t = F.col("total")
    bucket = F.when(t <= 0, "0").when(t <= 1, "1").when(t <= 2, "2").when(t <= 3, "3").when(t <= 5, "4-5").when(t <= 10, "6-10").when(t.isNotNull(), "11+")
    return grid.withColumn("size_bucket", bucket).filter("size_bucket IS NOT NULL").groupBy("size_bucket").agg(F.count("*").alias("n_cells"), F.avg((~F.col("has_1")).cast("double")).alias("sales_missing_rate"))


def competition(panel: DataFrame, stores: DataFrame, origins: DataFrame) -> DataFrame:
    """Open stores of a place and type at an origin's end and a year before, openings and closings between, all without the store itself.

    Counts come from events, not from stores times origins: a store adds one on the day it opens and takes one away on the day it closes. Events
    are summed by place, type and the first mark (an origin's end, or a year before one) on or after their day, and cumulated; each place then has one row
    with its few steps, in which a panel row finds both its dates. A store without a place, or with a place outside its district, has missing
    counts and isn't counted for others.
    """
    ends = origins.select("origin", "origin_end").distinct()
    marks = ends.select(F.col("origin_end").alias("at")).unionByName(ends.select(F.add_months("origin_end", -12).alias("at"))).distinct()
    edges = F.broadcast(marks.agg(F.array_sort(F.collect_set("at")).alias("edges")))

    def steps(keys: Sequence[str], name: str) -> DataFrame:
        s = stores.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        days = F.explode(F.array(F.struct(F.col("license_date").alias("day"), F.lit(1).alias("o"), F.lit(0).alias("c")), F.struct(F.col("close_date").alias("day"), F.lit(0).alias("o"), F.lit(1).alias("c"))))
        events = s.select(*keys, days.alias("_e")).select(*keys, "_e.*").filter("day IS NOT NULL").crossJoin(edges)
        events = events.withColumn("at", F.get(F.col("edges"), F.size(F.filter("edges", lambda e: e < F.col("day"))))).filter("at IS NOT NULL")
        w = W.partitionBy(*keys).orderBy("at")
        summed = events.groupBy(*keys, "at").agg(F.sum("o").alias("o"), F.sum("c").alias("c")).select(*keys, "at", F.sum("o").over(w).alias("opened"), F.sum("c").over(w).alias("closed"))
        return summed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("at", "opened", "closed"))).alias(name))

    def looked_up(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        return rows.join(steps(keys, name), [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys])

    def at_mark(name: str, at: Column) -> Column:
        return F.try_element_at(F.filter(name, lambda x: x["at"] <= at), F.lit(-1))

    rows = panel.select("store_id", "origin", "origin_end", "license_date", "biz_type", "pnu", "dong")
    now, before = F.col("origin_end"), F.add_months("origin_end", -12)
    rows = looked_up(looked_up(looked_up(rows, ["pnu"], "p"), ["pnu", "biz_type"], "pt"), ["dong", "biz_type"], "dt")
    found = {"p": at_mark("p", now), "pt": at_mark("pt", now), "db": at_mark("dt", before), "dt": at_mark("dt", now)}
    rows = rows.withColumns({f"{k}_at": v for k, v in found.items()})
    rows = rows.withColumns({f"{k}_{n}": F.col(f"{k}_at")[n] for k in found for n in ("opened", "closed")})
    n_now = F.col("dt_opened") - F.col("dt_closed")
    n_before = F.coalesce("db_opened", F.lit(0)) - F.coalesce("db_closed", F.lit(0))
    opened_self = ((F.col("license_date") > before) & (F.col("license_date") <= now)).cast("int")
    has_dong = F.col("dong").isNotNull()
    return rows.select(
        "store_id", "origin", (F.col("p_opened") - F.col("p_closed") - 1).alias("pnu_cnt"), (F.col("pt_opened") - F.col("pt_closed") - 1).alias("pnu_same_type_cnt"), (n_now - 1).alias("dong_same_type_cnt"),
        F.when(has_dong, F.col("dt_opened") - F.coalesce("db_opened", F.lit(0)) - opened_self).alias("dong_open_4q"), F.when(has_dong, F.col("dt_closed") - F.coalesce("db_closed", F.lit(0))).alias("dong_close_4q"),
        F.when(has_dong, ratio((n_now - n_before).cast("double"), n_before)).alias("dong_density_yoy"),
    )


def mentions(panel: DataFrame, monthly: DataFrame, qa: DataFrame) -> DataFrame:
    """Sums of 3, 6 and 12 months up to each origin, a trend, whether and when there last was a mention.

    Months without a row are zero for observed stores. Without a good collection everything is missing; where a collection is cut off at a
    month, windows that begin before it are missing, and ever / last are known only if a mention was found after it.
    """
    end = F.year("origin_end") * 12 + F.month("origin_end") - 1
    rows = panel.select("store_id", "origin", end.alias("e"))
    m = monthly.select(F.col("store_id").alias("_s"), "month_no", F.col("mention_count").alias("n"))
    # One row for each panel row: the join is by store, months are few for each store.
    joined = rows.join(m, (F.col("store_id") == F.col("_s")) & (F.col("month_no") <= F.col("e")), "left")
    back = F.col("e") - F.col("month_no")
    total = lambda k: F.coalesce(F.sum(F.when(back < k, F.col("n"))), F.lit(0))
    out = joined.groupBy("store_id", "origin", "e").agg(total(3).alias("c3"), total(6).alias("c6"), total(12).alias("c12"), F.max(F.when(F.col("n") > 0, F.col("month_no"))).alias("last"))
    out = out.join(qa.select("store_id", "ok", "truncated", "trunc_month_no"), "store_id", "left")
    seen, cut = F.coalesce(F.col("ok"), F.lit(False)), F.coalesce(F.col("truncated"), F.lit(False)) & F.col("trunc_month_no").isNotNull()
    known = lambda k: seen & ~(cut & (F.col("e") - (k - 1) < F.col("trunc_month_no")))
    blind = F.coalesce(F.col("truncated"), F.lit(False)) & ~F.coalesce(F.col("last") >= F.coalesce("trunc_month_no", F.lit(0)), F.lit(False))
    ever = seen & ~blind
    return out.select(
        "store_id", "origin", F.when(known(3), F.col("c3")).alias("cnt_3m"), F.when(known(12), F.col("c12")).alias("cnt_12m"), F.when(known(12), (F.col("c12") > 0).cast("int")).alias("has_12m"),
        F.when(known(12), 2 * F.col("c6") - F.col("c12")).alias("trend_6m"), F.when(ever, F.col("last").isNotNull().cast("int")).alias("has_ever"), F.when(ever, F.col("e") - F.col("last")).alias("months_since_last"),
    )


def price_year(raw: DataFrame, key: str, year: str, value: str, digits: int = 19) -> DataFrame:
    """One value for each valid key and year: equal repeats are one, differing ones drop the key."""
    ok = raw.filter(F.col(key).rlike(f"^[0-9]{{{digits}}}$"))
    per = ok.groupBy(key, year).agg(F.count_distinct(value).alias("_n"), F.max(value).alias(value), F.count("*").alias("n_rows"))
    return per.filter("_n <= 1").drop("_n")


def provenance(table: DataFrame, snapshot: str, end: str = "origin_end") -> DataFrame:
    """A table with what it was made from and as of when."""
    return table.withColumn("source_snapshot", F.lit(snapshot)).withColumn("feature_asof", F.col(end))


def mention_spans(mentions: DataFrame, key: str, day: str, months: int) -> DataFrame:
    """For each key how many mentions there are and from when to when; from_day lies `months` before the first of all."""
    first = mentions.agg(F.add_months(F.min(day), -months).alias("from_day"))
    return mentions.groupBy(key).agg(F.count("*").alias("total"), F.min(day).alias("first"), F.max(day).alias("last")).crossJoin(F.broadcast(first))


def recomputed(monthly: DataFrame, key: str, month: str, value: str, window: int) -> DataFrame:
    """Trailing sums in two ways, by a window over months and by a join with each of the months: how many cells there are and differ."""
    w = W.partitionBy(key).orderBy(month).rangeBetween(-(window - 1), 0)
    first = monthly.withColumn("_a", F.sum(value).over(w))
    spread = monthly.withColumn("_to", F.explode(F.sequence(F.col(month), F.col(month) + window - 1))).groupBy(key, F.col("_to").alias(month)).agg(F.sum(value).alias("_b"))
    return first.join(spread, [key, month], "left").agg(F.count("*").alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_differ"))
