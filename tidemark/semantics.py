"""Null-safe expressions that every operator shares. A missing value stays missing; a sum of nothing is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(c: Column) -> Column:
    """False where a condition is unknown."""
    return F.coalesce(c, F.lit(False))


def blank_to_null(c: str | Column) -> Column:
    trimmed = F.trim(col(c))
    return F.nullif(trimmed, F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above zero, else missing; never infinite."""
    return F.when(b > 0, a / b)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Half to even, as the published rules round; negative zero becomes zero."""
    return F.bround(col(c).cast("double"), digits) + F.lit(0.0)


def rounded_share(c: Column, digits: int = 6) -> Column:
    """rounded() of a ratio of two small counts, whose distance from a tie is far beyond a double's error; without decimals, for very many rows."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def quarter_number(date: str | Column) -> Column:
    d = col(date)
    return F.year(d) * 4 + F.quarter(d) - 1


def quarter_label(number: str | Column) -> Column:
    n = col(number)
    return F.concat(F.floor(n / 4).cast("string"), F.lit("Q"), (F.pmod(n, F.lit(4)) + 1).cast("string"))


def quarter_of_label(label: str | Column) -> Column:
    c = col(label)
    return F.substring(c, 1, 4).cast("int") * 4 + F.substring(c, 6, 1).cast("int") - 1


def quarter_end(number: str | Column) -> Column:
    n = col(number)
    return F.last_day(F.make_date(F.floor(n / 4).cast("int"), (F.pmod(n, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def quarter_start(number: str | Column) -> Column:
    n = col(number)
    return F.make_date(F.floor(n / 4).cast("int"), (F.pmod(n, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_code_label(code: str | Column) -> Column:
    """20211 -> 2021Q1"""
    c = col(code).cast("string")
    return F.concat(F.substring(c, 1, 4), F.lit("Q"), F.substring(c, 5, 1))


def month_number(date: str | Column) -> Column:
    d = col(date)
    return F.year(d) * 12 + F.month(d) - 1


def whole_months(start: str | Column, end: str | Column) -> Column:
    """Difference of calendar months, days not regarded."""
    return month_number(end) - month_number(start)


def average_rank_share(value: str, by: Sequence[str]) -> Column:
    """Rank of a value in its group, ties at their mean rank, divided by how many values there are."""
    ties = F.count(value).over(W.partitionBy(*by, value))
    rank = F.rank().over(W.partitionBy(*by).orderBy(F.asc_nulls_last(value)))
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(W.partitionBy(*by)))


def parsed_date(c: str | Column, form: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(blank_to_null(c), form) if hasattr(F, "try_to_date") else F.try_to_timestamp(blank_to_null(c), F.lit(form)).cast("date")


def parsed_number(c: str | Column) -> Column:
    """A number with thousands separators; missing if it can't be read."""
    return F.replace(blank_to_null(c), F.lit(","), F.lit("")).try_cast("double")


def age_band(months: str | Column, edges: Sequence[int] = (12, 36, 60, 120), closed: str = "left") -> Column:
    """Number of the band: closed on the left [lo, hi) or on the right (lo, hi]."""
    m = col(months)
    passed = [(m >= e if closed == "left" else m > e).cast("int") for e in edges]
    total = passed[0]
    for p in passed[1:]:
        total = total + p
    return F.when(m.isNotNull(), total)


def share_cut(c: str | Column, low: Column, high: Column) -> Column:
    """Winsorised: values beyond the limits become the limits."""
    return F.greatest(F.least(col(c), high), low)
