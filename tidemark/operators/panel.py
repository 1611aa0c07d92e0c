"""The (store, origin) panel: range join, label, age, maturity, survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.semantics import col, quarter_end, quarter_label, quarter_number, quarter_start, whole_months

HORIZON = 12


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(origin, origin_no, origin_start, origin_end) of the quarters first..last."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("origin_no"))
    return rows.select(quarter_label("origin_no").alias("origin"), "origin_no", quarter_start("origin_no").alias("origin_start"), quarter_end("origin_no").alias("origin_end"))


def mature_calendar(spark: SparkSession, first: int, last_date: Column, lag_months: int, horizon: int = HORIZON) -> DataFrame:
    """Quarters whose label window has ended `lag_months` before the last observed date."""
    limit = F.add_months(last_date, -lag_months)
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(first), quarter_number(limit))).alias("origin_no"))
    rows = rows.filter(F.add_months(quarter_end("origin_no"), horizon) <= limit)
    return rows.select(quarter_label("origin_no").alias("origin"), "origin_no", quarter_end("origin_no").alias("origin_end"))


def open_at(start: str | Column, end: str | Column, at: Column) -> Column:
    """Open on the day it starts, no longer open on the day it ends."""
    return (col(start) <= at) & (col(end).isNull() | (col(end) > at))


def within_year(date: str | Column, at: Column, months: int = HORIZON) -> Column:
    """In the half-open window that ends at `at`."""
    return (col(date) > F.add_months(at, -months)) & (col(date) <= at)


def known_at(stores: DataFrame, at: Column) -> DataFrame:
    """Stores as they were known at a date: later ones are gone, later closures undone."""
    return stores.filter(F.col("license_date") <= at).withColumn("close_date", F.when(F.col("close_date") <= at, F.col("close_date")))


def long_panel(stores: DataFrame, first: int, last: int, horizon: int = HORIZON) -> DataFrame:
    """A row for each store and each origin at whose end it is open, with the event of closing in the months after.

    Each store yields the quarters of its own life, so that rows made are rows kept: there is no join of all stores with all
    quarters. The last quarter is the one before the closing date's own unless that date is after its quarter's end.
    """
    begin = F.greatest(quarter_number("license_date"), F.lit(first))
    until = F.when(F.col("close_date").isNull(), F.lit(last)).otherwise(F.least(quarter_number("close_date"), F.lit(last)))
    rows = stores.filter(begin <= until).withColumn("origin_no", F.explode(F.sequence(begin, until)))
    rows = rows.withColumn("origin", quarter_label("origin_no")).withColumn("origin_end", quarter_end("origin_no"))
    rows = rows.filter(open_at("license_date", "close_date", F.col("origin_end")))
    event = F.coalesce((F.col("close_date") <= F.add_months("origin_end", horizon)).cast("int"), F.lit(0))
    return rows.withColumn("event_12m", event).withColumn("age_months", whole_months("license_date", "origin_end"))


def monthly_closures(stores: DataFrame, window: int = 6) -> DataFrame:
    """Closures by month, with the median of the months before (at least one, `window` at most)."""
    months = stores.filter("close_date IS NOT NULL").groupBy(F.trunc("close_date", "month").alias("month")).agg(F.count("*").alias("n_closed"))
    before = W.orderBy("month").rowsBetween(-window, -1)
    return months.withColumn("baseline", F.percentile("n_closed", F.lit(0.5)).over(before))


def unripe_tail(months: DataFrame, share: float = 0.75) -> DataFrame:
    """How many of the last months are below `share` of their baseline, without a break."""
    low = F.coalesce(F.col("n_closed") < share * F.col("baseline"), F.lit(False))
    marked = months.withColumn("low", low)
    last_good = marked.agg(F.max(F.when(~F.col("low"), F.col("month"))).alias("last_good"))
    return marked.crossJoin(last_good).agg(F.count_if((F.col("month") > F.col("last_good")) | F.col("last_good").isNull()).alias("lag_months"))


def survival(stores: DataFrame, as_of: Column, by: tuple[str, ...] = (), days: float = 30.44) -> DataFrame:
    """Product-limit curve of each group, durations in whole months: at risk, events, share that survives."""
    end = F.least(F.coalesce("close_date", as_of), as_of)
    lived = F.datediff(end, "license_date") / days
    rows = stores.withColumn("duration", F.floor(lived).cast("int")).withColumn("ended", (F.col("close_date") <= as_of).cast("int")).filter("duration >= 0")
    table = rows.groupBy(*by, "duration").agg(F.sum(F.coalesce("ended", F.lit(0))).alias("events"), F.count("*").alias("leaving"))
    later = W.partitionBy(*by).orderBy(F.desc("duration"))
    upto = W.partitionBy(*by).orderBy("duration")
    table = table.withColumn("at_risk", F.sum("leaving").over(later))
    factor = F.when(F.col("events") == F.col("at_risk"), F.lit(None)).otherwise(F.ln(1 - F.col("events") / F.col("at_risk")))
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(upto)
    return table.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.coalesce(factor, F.lit(0.0))).over(upto))))


def store_status(close: str, status: str, closed_codes: tuple[str, ...]) -> Column:
    """closed by a date, unknown if only the status says so, else open."""
    return F.when(F.col(close).isNotNull(), "closed").when(F.col(status).isin(*closed_codes), "unknown").otherwise("open")


def masked_origins(df: DataFrame, origins: tuple[str, ...], columns: tuple[str, ...], origin: str = "origin") -> DataFrame:
    """Features of some origins removed; their rows stay."""
    return df.withColumns({c: F.when(~F.col(origin).isin(*origins), F.col(c)) for c in columns})


def coarsened(df: DataFrame, area: str, months: str) -> DataFrame:
    """Area to ten square metres and age to whole years, as they may be released."""
    return df.withColumn("area_10", F.bround(F.col(area) / 10, 0) * 10).withColumn("age_years_in_months", (F.floor(F.col(months) / 12) * 12).cast("double"))


def population(stores: DataFrame, district: str, kind: str, kinds: tuple[str, ...], close: str) -> DataFrame:
    """Stores by district and kind, other kinds together, and how many are still open: one row for each district."""
    k = F.col(kind)
    return stores.groupBy(district).agg(*[F.count_if(k == v).alias(f"n{i}") for i, v in enumerate(kinds)], F.count_if(~k.isin(*kinds)).alias("other"), F.count_if(F.col(close).isNull()).alias("still_open"))
