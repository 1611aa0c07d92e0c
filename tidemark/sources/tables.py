"""Scans of the domain's files, built on readers: each says what it expects and stops, or counts, where a file breaks that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import contracts as C
from tidemark.operators import geo as G
from tidemark.sources import readers as R


def common_columns(df: DataFrame, core: Sequence[str], source_type: str) -> DataFrame:
    """The columns that all sources share, with the source's type."""
    return df.select(*core, F.lit(source_type).alias("source_type"))


def shared_header(frames: Sequence[DataFrame]) -> list[str]:
    """Columns that all frames have, in the order of the first."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def directory_scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], names: dict[str, Sequence[str]], key: str, districts: Sequence[str]) -> DataFrame:
    """Rows of a directory's snapshots in some districts, with compared names, projected coordinates and what is wrong with these.

    names must give key, district, name, branch, lon and lat. `suspect` is a coordinate outside 124 to 132 E, 33 to 43 N.
    """
    raw = R.snapshots(spark, paths, columns, names[key][0])
    rows = R.renamed(raw.withColumnRenamed("snapshot", "_s"), {**names, "snapshot": ["_s"]})
    rows = rows.filter(F.col("district").isin(list(districts)))
    lon, lat = F.col("lon").try_cast("double"), F.col("lat").try_cast("double")
    x, y = G.transverse_mercator(lon, lat)
    missing = lon.isNull() | lat.isNull()
    known = rows.withColumns({"name_key": X.match_key(F.col("name")), "coord_missing": missing, "coord_suspect": S.flag(~missing & ~(lon.between(124, 132) & lat.between(33, 43)))})
    fine = ~F.col("coord_missing") & ~F.col("coord_suspect")
    return known.withColumns({"x": F.when(fine, x), "y": F.when(fine, y)})


def strict(c: str, kind: str) -> Column:
    """A cast that stops the run at a text that can't be read; blank is missing."""
    found = S.blank_to_null(c)
    return F.when(found.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(found.try_cast(kind), F.raise_error(F.concat(F.lit(f"{c}: "), found)).cast(kind)))


def area_series(df: DataFrame, area: str, quarter: str, numbers: Sequence[str], categories: Sequence[str] = (), watched: str | None = None) -> DataFrame:
    """A series by area and quarter: strict numbers, categories as they are, one row for each key; with `watched`, the quarter it last changed in."""
    from pyspark.sql import Window as W

    rows = df.select(S.blank_to_null(area).alias(area), S.quarter_code_label(quarter).alias("quarter"), *[strict(c, "double").alias(c) for c in numbers], *categories)
    C.require_unique(rows, [area, "quarter"], "series")
    if watched is None:
        return rows
    w = W.partitionBy(area).orderBy("quarter")
    before = F.lag(watched).over(w)
    changed = F.when((F.row_number().over(w) == 1) | ~F.col(watched).eqNullSafe(before), F.col("quarter"))
    return rows.withColumn("_c", changed).withColumn("value_asof", F.last("_c", True).over(w)).drop("_c")


def yearly_files(frames: Sequence[DataFrame], names: dict[str, Sequence[str]], keys: Sequence[str], codes: dict[str, str], code: str = "code") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows of all years whose code is mapped, with its kind; for each key, all of its values, mapped or not)."""
    rows = [R.renamed(f, names) for f in frames]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    kind = F.try_element_at(table, F.col(code))
    return every.withColumn("kind", kind).filter("kind IS NOT NULL"), {k: every.select(k).distinct() for k in keys}


def store_counts(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Counts by kind of store, and whether the parts add up to the total."""
    found = strict(total, "long")
    summed = strict(parts[0], "long")
    for p in parts[1:]:
        summed = summed + strict(p, "long")
    kept = [c for c in df.columns if c != total and c not in parts]
    return df.select(*kept, found.alias(total), *[strict(p, "long").alias(p) for p in parts], S.flag(found != summed).alias("broken"))


def monthly_mentions(df: DataFrame, platform: str, keys: Sequence[str] = ("store_id", "month")) -> DataFrame:
    """Mentions of one platform by store and month number; a store has one row for a month."""
    rows = df.filter(F.col("platform") == platform).select("store_id", F.substring("month", 1, 7).alias("month"), F.col("mention_count").cast("long").alias("mention_count"))
    return C.require_unique(rows, keys, "mentions")


def collection_qa(df: DataFrame) -> DataFrame:
    """What became of each store's collection: ok without an error, cut off or not and since when, its time as local time."""
    cut = S.flag(F.lower("truncated") == "true")
    return df.select("store_id", (F.coalesce(F.trim("error"), F.lit("")) == "").alias("ok"), cut.alias("truncated"), F.when(cut, F.date_format(F.try_to_timestamp("oldest", F.lit("yyyyMMdd")), "yyyy-MM")).alias("cut_month"),
                     F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), F.to_timestamp_ntz(F.substring("collected", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("collected_at"))


def selected(spark: SparkSession, path: str, columns: Sequence[str], form: str = "parquet", **options) -> DataFrame:
    """Only named columns of a file; one that isn't there stops the run."""
    df = spark.read.options(**options).format(form).load(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise C.ContractError(f"{path}: no {missing}")
    return df.select(*columns)


def score_panel(df: DataFrame, label: str, origin: str = "origin", store: str = "store_id") -> DataFrame:
    """A panel to be scored: without the label, of one origin, a row for each store."""
    if df.select(origin).distinct().limit(2).count() != 1:
        raise C.ContractError("a panel to be scored has one origin")
    return C.require_unique(df.drop(label), [store], "score panel")


def collected_items(df: DataFrame, stores: DataFrame, store: str = "store_id", link: str = "link") -> DataFrame:
    """Matched items of known stores, one for each store and link: the first by title."""
    rows = df.filter(S.flag(F.col("matched"))).join(stores.select(store).distinct(), store, "left_semi")
    fields = [c for c in rows.columns if c not in (store, link)]
    first = rows.groupBy(store, link).agg(F.min(F.struct(F.col("title"), *[c for c in fields if c != "title"])).alias("_f"))
    return first.select(store, link, *[F.col(f"_f.{c}").alias(c) for c in fields])


def policies(df: DataFrame) -> DataFrame:
    """Policies whose ids differ and whose least age isn't above the largest; anything else stops the run."""
    C.require(df, {"no_id": S.blank_to_null("policy_id").isNull(), "limits": F.col("min_age") > F.col("max_age")}, "policies")
    return C.require_unique(df, ["policy_id"], "policies")


def application_faults(df: DataFrame, policies: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """How many rows of an application list break each rule: unknown policy, status, date; more than one date of confirmation."""
    known = policies.select(F.col("policy_id").alias("_p")).distinct()
    rows = df.join(known, F.col("policy_id") == F.col("_p"), "left")
    checked = F.try_to_timestamp("checked_at", F.lit("yyyy-MM-dd"))
    found = C.counters(rows, {"unknown_policy": F.col("_p").isNull(), "bad_status": ~F.col("status").isin(list(statuses)), "bad_date": checked.isNull()})
    dates = df.agg((F.count_distinct("checked_at") > 1).alias("several_dates"))
    return found.crossJoin(F.broadcast(dates))


def known_presence(df: DataFrame, stores: DataFrame, key: str = "store_id") -> tuple[DataFrame, DataFrame]:
    """(rows of known stores, one row with how many were ignored)"""
    ids = stores.select(key).distinct()
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti").agg(F.count("*").alias("ignored"))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of points with x and y, by the shoelace rule."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    return F.when(n >= 2, F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2)


def polygons(df: DataFrame, code: str, ring: str = "ring") -> DataFrame:
    """Rings, closed where they weren't, with what is wrong: empty, of too few points or flat; codes that occur twice stop the run."""
    C.require_unique(df, [code], "polygons")
    r = F.col(ring)
    first, last = F.get(r, 0), F.get(r, F.size(r) - 1)
    opened = S.flag((first["x"] != last["x"]) | (first["y"] != last["y"]))
    closed = F.when(opened, F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    out = df.withColumn("closed_here", opened).withColumn(ring, closed)
    flat = F.abs(ring_area(F.col(ring))) < 1e-9
    reason = F.when(F.col(ring).isNull() | (F.size(ring) == 0), "empty").when(F.size(ring) < 4, "few_points").when(flat, "flat")
    return out.withColumn("fault", reason).withColumn("area", F.when(reason.isNull(), F.abs(ring_area(F.col(ring)))))


def run_versions(df: DataFrame, run: str = "run_id", version: str = "git_sha") -> DataFrame:
    """The version of the code of each run, and whether its lines disagree."""
    return df.filter(F.col(version).isNotNull()).groupBy(run).agg(F.min(version).alias(version), (F.count_distinct(version) > 1).alias("conflict"))


def presence_union(first: DataFrame, second: DataFrame, collected: str) -> DataFrame:
    """Presence of both collections, a row for each store; what is known is as of the collection's time."""
    rows = first.unionByName(second, allowMissingColumns=True)
    return C.require_unique(rows, ["store_id"], "presence").withColumn("asof", F.to_date(collected)).withColumn("available", F.date_add(F.to_date(collected), 1))


def search_candidates(found: DataFrame, store: str = "store_id") -> DataFrame:
    """For each store its first candidate by rank that agrees by name, area and district; ambiguous if more do."""
    name = X.match_key(F.col("candidate_name")) == X.match_key(F.col("name"))
    agrees = S.flag(name) & S.flag(F.contains("candidate_address", F.col("dong"))) & (F.col("gu").isNull() | S.flag(F.contains("candidate_address", F.col("gu"))))
    hits = found.filter(agrees)
    return hits.groupBy(store).agg(F.min_by("candidate_id", F.struct("rank", "candidate_id")).alias("candidate_id"), (F.count("*") > 1).alias("ambiguous"))


def in_address(df: DataFrame, address: str, part: str) -> DataFrame:
    return df.filter(S.flag(F.contains(F.col(address), F.lit(part))))


def synthetic_stores(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n made stores; every value follows from the seed and the row's number, so that they are the same everywhere."""
    part = lambda k, size: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), F.col("id"))), 1, 8), 16, 10).cast("long"), F.lit(size))
    return spark.range(n).select(
        F.concat(F.lit("syn_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("store_id"), F.element_at(F.array(*[F.lit(k) for k in ("cafe", "bar", "shop")]), (part("kind", 3) + 1).cast("int")).alias("biz_type"),
        F.date_add(F.lit("2010-01-01").cast("date"), part("day", 4000).cast("int")).alias("license_date"), (part("area", 20000) / 100).alias("area"), (part("closed", 4) == 0).alias("closed"),
    )


def labelled_sample(sample: DataFrame, labels: DataFrame, row: str = "row_id", key: str = "store_id") -> DataFrame:
    """A sample with its labels by row; rows whose keys disagree, or that have no partner, stop the run."""
    both = sample.alias("s").join(labels.alias("l"), row, "full_outer")
    C.require(both, {"misaligned": ~F.col(f"s.{key}").eqNullSafe(F.col(f"l.{key}"))}, "labelled sample")
    return both.select(row, F.col(f"s.{key}").alias(key), *[F.col(f"s.{c}") for c in sample.columns if c not in (row, key)], *[F.col(f"l.{c}") for c in labels.columns if c not in (row, key)])
