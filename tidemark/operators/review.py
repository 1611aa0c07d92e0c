"""Samples for review and what reviewers said: strata, bands, pilots, blind sheets, verdicts, second rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(seed: int, *columns: str) -> Column:
    """A drawn order that is the same everywhere."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def short_name_shares(stores: DataFrame, mentions: DataFrame, key: str, name: str, kind: str, most: int = 2) -> DataFrame:
    """Stores with a short name and a mention at least, by kind, with their share."""
    pool = stores.filter(F.length(name) <= most).join(mentions.filter(F.col("total") >= 1).select(key), key, "left_semi")
    return pool.groupBy(kind).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def per_stratum(rows: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """n drawn rows of each stratum (all, if it has fewer), with their place."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(order(seed, key), key))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def banded_quota(rows: DataFrame, band: str, quotas: dict[str, int], key: str, seed: int = 1) -> DataFrame:
    """So many drawn rows of each band in order; what a band lacks goes to the next one's quota."""
    sizes = {r[0]: r[1] for r in rows.groupBy(band).count().collect() if r[0] in quotas}  # a row for each band
    take, carry = {}, 0
    for b, quota in quotas.items():
        wanted = quota + carry
        take[b] = min(wanted, sizes.get(b, 0))
        carry = wanted - take[b]
    table = F.create_map(*[F.lit(x) for pair in take.items() for x in pair])
    place = F.row_number().over(W.partitionBy(band).orderBy(order(seed, key), key))
    return rows.filter(F.col(band).isin(list(quotas))).withColumn("_place", place).filter(F.col("_place") <= F.try_element_at(table, F.col(band))).drop("_place")


def pilot(rows: DataFrame, group: str, key: str, share: float, least: int, seed: int = 1) -> DataFrame:
    """A fixed share of each group, rounded up, `least` at least."""
    w = W.partitionBy(group)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_place", F.row_number().over(w.orderBy(order(seed, key), key)))
    return ranked.filter(F.col("_place") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(least))).drop("_n", "_place")


def validation(rows: DataFrame, score: str, edges: Sequence[float], matched: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each band of a score (band k lies from edge k up to the next), matched ones first, then drawn."""
    number = F.lit(-1)
    for e in edges:
        number = number + (F.col(score) >= e).cast("int")
    banded = rows.withColumn("band", number).filter("band >= 0")
    place = F.row_number().over(W.partitionBy("band").orderBy(F.desc(matched), order(seed, key), key))
    return banded.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def blind_ids(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Rows with an id that tells nothing: the first 12 digits of a seeded hash."""
    return rows.withColumn("blind_id", F.substring(order(seed, key), 1, 12))


def sheet(targets: DataFrame, items: DataFrame, key: str, item: str, per: int, seed: int = 1) -> DataFrame:
    """Targets with their first drawn items, and one row without an item for those that have none."""
    return targets.join(per_stratum(items, [key], item, per, seed), key, "left").withColumn("item_no", F.coalesce("place", F.lit(0))).drop("place")


def verdicts(items: DataFrame, key: str, verdict: str, yes: str = "same", no: str = "other") -> DataFrame:
    """Each store's verdict by the majority of its clear items; a tie, and a store without a clear one, is unclear."""
    counts = items.groupBy(key).agg(F.count_if(F.col(verdict) == yes).alias("n_yes"), F.count_if(F.col(verdict) == no).alias("n_no"), F.count("*").alias("n_items"))
    return counts.withColumn("verdict", F.when(F.col("n_yes") > F.col("n_no"), yes).when(F.col("n_yes") < F.col("n_no"), no).otherwise("unclear"))


def verdict_rates(stores: DataFrame, by: str, yes: str = "same") -> DataFrame:
    clear = F.col("verdict") != "unclear"
    return stores.groupBy(by).agg(F.count("*").alias("n"), F.count_if(clear).alias("n_clear"), (F.count_if(F.col("verdict") == yes) / F.nullif(F.count_if(clear), F.lit(0))).alias("rate"))


def refill(valid: DataFrame, raw: DataFrame, keys: Sequence[str], item: str, needed: int = 3, seed: int = 1) -> DataFrame:
    """Items to be reviewed next: for each key that has fewer valid ones than needed, drawn others, as many as it lacks."""
    have = valid.groupBy(*keys).agg(F.count("*").alias("_have"))
    fresh = raw.join(valid.select(*keys, item), [*keys, item], "left_anti").join(have, list(keys), "left")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order(seed, item), item))
    return fresh.withColumn("_place", place).filter(F.col("_place") <= needed - F.coalesce("_have", F.lit(0))).drop("_place", "_have")


def nearest_to_centres(rows: DataFrame, columns: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """n representative rows: the row nearest to each centre of k-means on standardised columns; its cluster's size as weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=list(columns), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(k=n, seed=seed, featuresCol="_s", predictionCol="cluster")]
    model = Pipeline(stages=stages).fit(rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]))
    centres = model.stages[-1].clusterCenters()
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    placed = model.transform(rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]))
    gap = F.aggregate(F.zip_with(vector_to_array("_s"), F.element_at(table, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return placed.withColumn("_d", gap).groupBy("cluster").agg(F.min(F.struct("_d", key)).alias("_m"), F.count("*").alias("weight")).select("cluster", F.col(f"_m.{key}").alias(key), "weight")
