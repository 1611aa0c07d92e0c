"""What is published: cells and their suppression, nested reports, projections, search order, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cells(rows: DataFrame, area: Sequence[str], kind: str, band: str, bands: Sequence[str]) -> DataFrame:
    counted = rows.filter(F.col(area[-1]).isNotNull()).groupBy(*area, kind).agg(*[F.count_if(F.col(band) == b).alias(b) for b in bands])
    total = counted[bands[0]]
    for b in bands[1:]:
        total = total + counted[b]
    return counted.withColumn("n", total)


def suppressed(table: DataFrame, area: Sequence[str], kind: str, least: int) -> DataFrame:
    """Cells below `least` are hidden; a hidden total hides all; a single hidden cell hides the smallest shown one with it."""
    w = W.partitionBy(*area)
    small = F.col("n") < least
    t = table.withColumn("_total", F.sum("n").over(w)).withColumn("_hidden", F.sum(small.cast("int")).over(w))
    t = t.withColumn("_rank", F.row_number().over(w.orderBy(small.cast("int"), "n", kind)))
    reason = F.when(small, "small_cell").when(F.col("_total") < least, "complementary").when((F.col("_hidden") == 1) & (F.col("_rank") == 1), "complementary")
    return t.withColumn("reason", reason).withColumn("suppressed", F.col("reason").isNotNull()).drop("_total", "_hidden", "_rank")


def area_totals(table: DataFrame, area: Sequence[str], least: int, bands: Sequence[str]) -> DataFrame:
    out = table.groupBy(*area).agg(F.sum("n").alias("n"), *[F.sum(b).alias(b) for b in bands])
    return out.withColumn("suppressed", F.col("n") < least)


def recoverable(table: DataFrame, totals: DataFrame, area: Sequence[str]) -> DataFrame:
    """Hidden cells that follow from a shown total and all other cells; there must be none."""
    hidden = table.filter("suppressed").withColumn("_n", F.count("*").over(W.partitionBy(*area))).filter("_n = 1").drop("_n")
    return hidden.join(totals.filter("NOT suppressed").select(*area), list(area), "left_semi")


def ranked_kinds(shown: DataFrame, area: Sequence[str], kind: str) -> DataFrame:
    """For each area the kinds with a high share, riskiest first."""
    r = shown.filter(F.col("high") > 0).withColumn("_k", F.struct((-F.col("high") / F.col("n")).alias("a"), (-(F.col("mid") + F.col("high")) / F.col("n")).alias("b"), (-F.col("n")).alias("c"), F.col(kind).alias("kind")))
    return r.groupBy(*area).agg(F.transform(F.array_sort(F.collect_list("_k")), lambda s: s["kind"]).alias("kinds"))


def threshold_impact(table: DataFrame, area: Sequence[str], kind: str, candidates: Sequence[int]) -> DataFrame:
    """How much each candidate for the least cell size would hide."""
    each = table.withColumn("least", F.explode(F.array(*[F.lit(c) for c in candidates])))
    w = W.partitionBy("least", *area)
    small = F.col("n") < F.col("least")
    each = each.withColumn("_total", F.sum("n").over(w)).withColumn("_hidden", F.sum(small.cast("int")).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(small.cast("int"), "n", kind)))
    gone = small | (F.col("_total") < F.col("least")) | ((F.col("_hidden") == 1) & (F.col("_rank") == 1))
    return each.groupBy("least").agg(F.count("*").alias("n_cells"), F.count_if(gone).alias("n_hidden"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("stores_hidden"))


def masked_counts(rows: DataFrame, dimensions: Sequence[str], least: int = 5) -> DataFrame:
    """Composition of several dimensions in one pass; counts of one to least - 1 are masked, shares are of valid rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("category")) for d in dimensions])
    per = rows.select(F.explode(pairs).alias("v")).groupBy("v.dimension", "v.category").agg(F.count("*").alias("n"))
    valid = F.sum(F.when(F.col("category") != "missing", F.col("n")).otherwise(0)).over(W.partitionBy("dimension"))
    few = F.col("n").between(1, least - 1)
    return per.select("dimension", "category", F.when(few, f"<{least}").otherwise(F.col("n").cast("string")).alias("n_shown"), F.when(~few & (F.col("category") != "missing"), F.col("n") / valid).alias("share"))


def factor_documents(long: DataFrame, keys: Sequence[str], name: str, contribution: str, extra: Sequence[str] = ()) -> DataFrame:
    """JSON array of a row's factors, largest contribution first."""
    item = F.struct((-F.col(contribution)).alias("o"), F.col(name).alias("factor_id"), F.col(contribution).alias("contribution"), *extra)
    sorted_items = F.array_sort(F.collect_list(item))
    return long.groupBy(*keys).agg(F.to_json(F.transform(sorted_items, lambda s: F.struct(s["factor_id"].alias("factor_id"), s["contribution"].alias("contribution"), *[s[c].alias(c) for c in extra]))).alias("factors_json"), F.count("*").alias("n_factors"))


def reports(head: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Nested documents: each part's rows of a key as an array of structs, sorted; an empty array if there are none."""
    out = head
    for name, part in parts.items():
        fields = [c for c in part.columns if c != key]
        out = out.join(part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast(out.sparkSession.createDataFrame([], part.select(F.array(F.struct(*fields)).alias("x")).schema).schema["x"].dataType)))
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns])).alias("document"))


def projected(documents: DataFrame, drop: Sequence[str], text: str = "document") -> DataFrame:
    """Documents without the keys that must not be published, and whether one of them still occurs at any depth."""
    out = F.col(text)
    for name in drop:
        out = F.regexp_replace(out, rf'"{name}":(?:"(?:[^"\\]|\\.)*"|[^,}}\]]*)(?:,|(?=[}}\]]))', "")
    out = F.regexp_replace(out, r",(?=[}\]])", "")
    return documents.withColumn("public", out).withColumn("leaks", F.col("public").rlike("|".join(f'"{n}"' for n in drop)))


def case_flags(factors: Column, contribution: str = "contribution") -> dict[str, Column]:
    """Flags over an array of factor structs."""
    return {
        "any_positive": F.exists(factors, lambda f: f[contribution] > 0), "all_displayed": F.forall(factors, lambda f: f["display"]),
        "max_contribution": F.array_max(F.transform(factors, lambda f: f[contribution])), "n_displayed": F.size(F.filter(factors, lambda f: f["display"])),
    }


def quota_sample(rows: DataFrame, strata: str, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows with strata in proportion, one at least of each; too many go from, too few come to, the largest strata."""
    sizes = rows.groupBy(strata).agg(F.count("*").alias("_size"))
    w = W.partitionBy()
    quota = F.least(F.greatest(F.bround(F.col("_size") / F.sum("_size").over(w) * n), F.lit(1)).cast("long"), F.col("_size"))
    sizes = sizes.withColumn("_quota", quota).withColumn("_short", F.lit(n) - F.sum("_quota").over(w))
    order = F.row_number().over(W.orderBy(F.desc("_size"), strata))
    sizes = sizes.withColumn("_o", order)
    sizes = sizes.withColumn("_quota", F.least(F.greatest(F.col("_quota") + F.when(F.col("_o") == 1, F.col("_short")).otherwise(0), F.lit(1)), F.col("_size")))
    ranked = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy(strata).orderBy("_h", key)))
    return ranked.join(F.broadcast(sizes.select(strata, "_quota")), strata).filter("_r <= _quota").drop("_r", "_h", "_quota")


def seeded_first(rows: DataFrame, order: Sequence[Column], key: str, n: int, seed: int = 1) -> DataFrame:
    """The first n rows by keys, ties by a hash of the seed and the id."""
    return rows.orderBy(*order, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).limit(n)


def masked_ids(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Sequence ids by kind in place of identifying ones: A-001 and so on, in the order of a hash."""
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.dense_rank().over(W.orderBy(kind)), F.lit(1))
    no = F.row_number().over(W.partitionBy(kind).orderBy(F.sha2(F.col(key).cast("string"), 256)))
    return rows.withColumn("_no", no).withColumn("masked_id", F.concat(letter, F.lit("-"), F.lpad(F.col("_no").cast("string"), 3, "0"))).drop("_no")


def row_key(*columns: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 32)


def direction(c: str, dead: float = 0.001) -> Column:
    return F.when(F.abs(c) < dead, "neutral").when(F.col(c) > 0, "up").otherwise("down")


def manifest(documents: DataFrame, key: str, text: str = "document") -> DataFrame:
    return documents.select(key, F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("bytes"))
