"""Preparing columns for panels, surveys and models: recodes, durations, categories, design matrices, bounds, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import contracts as C
from tidemark.operators.order import quantiles


def panel_features(df: DataFrame, license_date: str, end: str, area: str, x: str, y: str, snapshot: str) -> DataFrame:
    """Age in months at the origin's end, area with thousands separators as a number, whether there is a coordinate, what it is known from."""
    return df.withColumns({"age_months": S.whole_months(license_date, end), "area_m2": S.parsed_number(area), "has_coord": F.col(x).isNotNull() & F.col(y).isNotNull(), "feature_asof": F.col(end), "source_snapshot": F.lit(snapshot)})


def output_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in the published order; one that is missing stops the run."""
    if missing := [c for c in columns if c not in df.columns]:
        raise C.ContractError(f"no {missing}")
    return df.select(*columns)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as numbers. A text that is neither blank nor a number stops the run, all of them counted at once."""
    lost = {c: S.blank_to_null(c).isNotNull() & S.parsed_number(c).isNull() for c in columns}
    C.require(df, lost, "numbers")
    return df.withColumns({c: S.parsed_number(c) for c in columns})


def yes_no(df: DataFrame, columns: Sequence[str], yes: str = "1", no: str = "2") -> DataFrame:
    """Two codes as 1 and 0; a code of another kind stops the run."""
    C.require(df, {c: S.blank_to_null(c).isNotNull() & ~S.blank_to_null(c).isin(yes, no) for c in columns}, "yes and no")
    return df.withColumns({c: F.when(S.blank_to_null(c) == yes, 1).when(S.blank_to_null(c) == no, 0) for c in columns})


def tenure(df: DataFrame, year: str, month: str, base: tuple[int, int], sentinel: int, least: int, most: int) -> DataFrame:
    """Months from a start to the base month; the sentinel year has none and a flag. Implausible years or months stop the run."""
    y, m = F.col(year).cast("double"), F.col(month).cast("double")
    C.require(df, {"month": ~m.between(1, 12), "year": ~((y == sentinel) | y.between(least, most))}, "tenure")
    return df.withColumn("tenure_invalid", (y == sentinel).cast("int")).withColumn("tenure_months", F.when(y != sentinel, base[0] * 12 + base[1] - (y * 12 + m)))


def margin(df: DataFrame, revenue: str, profit: str) -> DataFrame:
    """Profit by revenue, missing where there was none, which has a flag."""
    zero = F.col(revenue) == 0
    return df.withColumn("profit_margin", F.when(~zero, F.try_divide(profit, revenue))).withColumn("zero_revenue", zero.cast("int"))


def treatment(df: DataFrame, channels: Sequence[str], total: str) -> DataFrame:
    """Whether any channel is used, how many, and by what rule a row contradicts itself: counted in `contradiction`."""
    used = F.lit(0)
    for c in channels:
        used = used + F.coalesce(F.col(c), F.lit(0))
    known = F.col(channels[0]).isNotNull()
    for c in channels[1:]:
        known = known | F.col(c).isNotNull()
    wrong = F.when((used > 0) & (F.col(total) == 0), "used_without_sales").when((used == 0) & (F.col(total) > 0), "sales_without_use")
    return df.withColumns({"n_channels": F.when(known, used), "treated": F.when(known, (used > 0).cast("int")), "contradiction": wrong})


def design(df: DataFrame, categories: Sequence[str], number: str, flag: str, key: str) -> DataFrame:
    """key, a column of 0 and 1 for each level of each category, the number with 0 for missing, the flag; columns of one value go.

    Levels are read first: one row for each, which must stay few.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories]))
    levels = sorted(tuple(r) for r in df.select(pairs.alias("p")).select("p.c", F.coalesce("p.v", F.lit("None")).alias("v")).distinct().collect())
    if len(levels) > 1000:
        raise C.ContractError(f"{len(levels)} levels are too many for a column each")
    columns = {f"{c}_{v}": (F.coalesce(F.col(c).cast("string"), F.lit("None")) == v).cast("double") for c, v in levels}
    columns |= {number: F.coalesce(F.col(number).cast("double"), F.lit(0.0)), flag: F.col(flag).cast("double")}
    wide = df.select(key, *[v.alias(k) for k, v in columns.items()])
    ends = wide.agg(*[(F.min(f"`{c}`") != F.max(f"`{c}`")).alias(c) for c in columns]).first().asDict()
    return wide.select(key, *[f"`{c}`" for c in columns if ends[c]])


def model_columns(df: DataFrame, columns: Sequence[str], categories: dict[str, Sequence[str]]) -> DataFrame:
    """What a model reads: categories by their number in a given list (missing or unknown: -1), booleans and numbers as doubles."""
    kinds = dict(df.dtypes)
    out = {}
    for c in columns:
        if c in categories:
            place = F.array_position(F.array(*[F.lit(v) for v in categories[c]]), F.col(c).cast("string"))
            out[c] = F.coalesce(F.when(place > 0, place - 1), F.lit(-1)).cast("double")
        else:
            out[c] = F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).cast("double")
    return df.withColumns(out)


def feature_set(columns: Sequence[str], roles: dict[str, str], groups: dict[str, str], wanted: Sequence[str]) -> list[str]:
    """Predictors of the wanted groups, in the order of the columns; a column without a role stops the run."""
    if unknown := [c for c in columns if c not in roles]:
        raise C.ContractError(f"no role: {unknown}")
    return [c for c in columns if roles[c] == "predictor" and groups.get(c) in wanted]


#: Where the categories of tenure (months) and of size (persons) begin.
TENURE_FROM, SIZE_FROM = (0, 12, 36, 60, 120), (1, 2, 3, 5)


def category(c: str, begins: Sequence[int]) -> Column:
    """The category of a whole number, named by its first and last value; "missing", or "invalid" where it is no whole number from the first on."""
    v = F.col(c).cast("double")
    out = F.when(v.isNull(), "missing").when(F.isnan(v) | (v < begins[0]) | (v % 1 != 0), "invalid")
    for a, b in zip(begins, begins[1:], strict=False):
        out = out.when(v < b, str(a) if b == a + 1 else f"{a}-{b - 1}")
    return out.otherwise(f"{begins[-1]}+")


def tenure_category(c: str, invalid: Column | None = None) -> Column:
    """category() of a tenure; a row marked invalid is that, one whose mark is missing is missing."""
    out = category(c, TENURE_FROM)
    return out if invalid is None else F.when(invalid.isNull(), "missing").when(invalid == 1, "invalid").otherwise(out)


def size_category(c: str) -> Column:
    return category(c, SIZE_FROM)


def priority(close: str, since: Column) -> Column:
    """Open, or closed on or after a day."""
    return F.col(close).isNull() | (F.col(close) >= since)


def spline_knots(df: DataFrame, c: str, shares: Sequence[float] = (0.05, 0.35, 0.65, 0.95)) -> list[float]:
    """Quantiles of a column."""
    return [float(v) for v in quantiles(df, c, shares).first()["q"]]


def spline_basis(c: str | Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline: the value and len(knots) - 2 columns that are linear beyond the outer knots."""
    x, t = S.col(c).cast("double"), list(knots)
    norm, span = (t[-1] - t[0]) ** 2, t[-1] - t[-2]
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    return [x, *[(cube(t[j]) - cube(t[-2]) * ((t[-1] - t[j]) / span) + cube(t[-1]) * ((t[-2] - t[j]) / span)) / norm for j in range(len(t) - 2)]]


def missing_reason(factor: str, place: str, online: str, inside: dict[str, str]) -> Column:
    """Why a factor has no value: collected online, outside every area, or inside one but not published; else unknown."""
    table = F.create_map(*[F.lit(x) for pair in inside.items() for x in pair])
    of_area = F.try_element_at(table, F.col(factor))
    return F.when(F.col(factor) == online, "not_collected").when(of_area.isNull(), "unknown").when(F.col(place).isNull(), "outside_area").otherwise(of_area)


def stages(df: DataFrame, treated: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with unique keys, the treated ones, which are a part of them)"""
    whole = C.require_unique(df, [key], "first stage")
    return whole, whole.filter(F.col(treated) == 1)


def expected(df: DataFrame, rows: int, name: str = "table") -> DataFrame:
    """df, if it has so many rows."""
    found = df.count()
    if found != rows:
        raise C.ContractError(f"{name}: {found} rows instead of {rows}")
    return df


def coded(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows whose trimmed code is one of some."""
    return df.filter(F.trim(F.col(column).cast("string")).isin([str(c) for c in codes]))


def without_short_names(df: DataFrame, name: str, columns: Sequence[str], most: int = 2) -> DataFrame:
    """Features of names too short to be searched for, removed; the row stays."""
    short = S.flag(F.length(name) <= most)
    return df.withColumns({c: F.when(~short, F.col(c)) for c in columns}).withColumn("short_name", short)


def date_bounds(df: DataFrame, key: str, group: str, lower: str, upper: str) -> DataFrame:
    """For each key and group its own bounds, either of which may be open, and those of all groups of the key."""
    own = df.groupBy(key, group).agg(F.when(F.bool_and(F.col(lower).isNotNull()), F.min(lower)).alias("lower"), F.when(F.bool_and(F.col(upper).isNotNull()), F.max(upper)).alias("upper"))
    union = own.groupBy(F.col(key).alias("_k")).agg(F.when(F.bool_and(F.col("lower").isNotNull()), F.min("lower")).alias("any_lower"), F.when(F.bool_and(F.col("upper").isNotNull()), F.max("upper")).alias("any_upper"))
    return own.join(union, F.col(key) == F.col("_k")).drop("_k")


def within_bounds(day: str | Column, lower: str = "lower", upper: str = "upper") -> Column:
    d = S.col(day)
    return S.flag(F.coalesce(d >= F.col(lower), F.lit(True)) & F.coalesce(d <= F.col(upper), F.lit(True)) & d.isNotNull())


def final_origins(origins: Sequence[int], test: int, calibrate: int, embargo: int) -> dict[str, list[int]]:
    """The last origins to test on, those before to calibrate on, and those to train on, which end more than the embargo before."""
    o = sorted(origins)
    tested, calibrated = o[-test:], o[-test - calibrate : -test]
    return {"train": [x for x in o if x < calibrated[0] - embargo], "calibrate": calibrated, "test": tested}
