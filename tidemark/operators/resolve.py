"""Directory snapshots to entities: presence, transitions, reissue links, components, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def presence(panel: DataFrame, id: str, snapshot: str) -> DataFrame:
    """(id, seen): the sorted snapshots in which an id occurs."""
    return panel.groupBy(id).agg(F.array_sort(F.collect_set(snapshot)).alias("seen"))


def presence_matrix(panel: DataFrame, id: str, snapshot: str, values: Sequence) -> DataFrame:
    """One column of 0 and 1 for each of the snapshots named."""
    return panel.groupBy(id).agg(*[F.max((F.col(snapshot) == v).cast("int")).alias(f"s_{v}") for v in values])


def transitions(panel: DataFrame, id: str, snapshot: str) -> DataFrame:
    """For each pair of adjacent snapshots: ids kept, lost, lost for good, new, brand new and back again."""
    times = panel.select(F.col(snapshot).alias("s")).distinct()
    order = times.select("s", F.row_number().over(W.orderBy("s")).alias("no"))
    rows = panel.select(F.col(id).alias("id"), F.col(snapshot).alias("s")).distinct().join(F.broadcast(order), "s")
    w = W.partitionBy("id").orderBy("no")
    rows = rows.withColumn("before", F.lag("no").over(w)).withColumn("after", F.lead("no").over(w)).withColumn("top", F.lit(None).cast("int"))
    kept, back, fresh = F.col("before") == F.col("no") - 1, F.col("before") < F.col("no") - 1, F.col("before").isNull()
    into = rows.groupBy("no").agg(F.count_if(kept).alias("retained"), F.count_if(back).alias("reappeared"), F.count_if(fresh).alias("brand_new"))
    gone = F.col("after").isNull() | (F.col("after") > F.col("no") + 1)
    out = rows.groupBy((F.col("no") + 1).alias("no")).agg(F.count_if(gone).alias("lost"), F.count_if(F.col("after").isNull()).alias("lost_forever"))
    pairs = order.select("no", F.col("s").alias("to_snapshot"), F.lag("s").over(W.orderBy("no")).alias("from_snapshot")).filter("from_snapshot IS NOT NULL")
    both = pairs.join(into, "no", "left").join(out, "no", "left")
    return both.select("from_snapshot", "to_snapshot", "retained", "lost", "lost_forever", (F.col("reappeared") + F.col("brand_new")).alias("new"), "brand_new", "reappeared")


def reissue_links(panel: DataFrame, id: str, snapshot: str, keys: Sequence[str]) -> DataFrame:
    """Ids that vanish after a snapshot, joined to ids first seen in the next one with the same keys; one to one is clear, else ambiguous.

    All pairs of snapshots are one join, by the number of the snapshot in which the old id is missed.
    """
    order = panel.select(F.col(snapshot).alias("s")).distinct().select("s", F.row_number().over(W.orderBy("s")).alias("no"))
    rows = panel.join(F.broadcast(order), F.col(snapshot) == F.col("s")).select(F.col(id).alias("id"), "no", *keys)
    rows = rows.withColumn("first", F.min("no").over(W.partitionBy("id"))).withColumn("last", F.max("no").over(W.partitionBy("id")))
    known = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    old = known.filter("no = last").select(F.col("id").alias("old_id"), (F.col("no") + 1).alias("at"), *keys).distinct()
    new = known.filter("no = first AND no > 1").select(F.col("id").alias("new_id"), F.col("no").alias("at"), *keys).distinct()
    pairs = old.join(new, ["at", *keys])
    n_new, n_old = F.count("*").over(W.partitionBy("at", *keys, "old_id")), F.count("*").over(W.partitionBy("at", *keys, "new_id"))
    marked = pairs.withColumn("ambiguous", (n_new > 1) | (n_old > 1))
    return marked.groupBy("at", "old_id", "new_id").agg(F.max("ambiguous").alias("ambiguous"))


def chain_roots(links: DataFrame, old: str, new: str, longest: int) -> DataFrame:
    """(id, root): the earliest id of each chain of clear links, which are one to one, by doubling the distance looked back.

    A chain has one link for each pair of snapshots at most, so the rounds are the logarithm of their number.
    """
    hop = links.select(F.col(new).alias("id"), F.col(old).alias("root"))
    steps = 1
    while steps < longest:
        further = hop.select(F.col("id").alias("root"), F.col("root").alias("_far"))
        hop = hop.join(further, "root", "left").select("id", F.coalesce("_far", "root").alias("root"))
        steps *= 2
    return hop


def entities(panel: DataFrame, roots: DataFrame, id: str, snapshot: str, attributes: Sequence[str]) -> DataFrame:
    """Last row's attributes, first and last snapshot, how many, whether there is a gap, and the id's root."""
    order = panel.select(F.col(snapshot).alias("s")).distinct().select("s", F.row_number().over(W.orderBy("s")).alias("no"))
    rows = panel.join(F.broadcast(order), F.col(snapshot) == F.col("s"))
    per = rows.groupBy(F.col(id).alias("id")).agg(
        *[F.max_by(c, F.struct("no", c)).alias(f"{c}_last") for c in attributes], F.min(snapshot).alias("first_seen"), F.max(snapshot).alias("last_seen"),
        F.count_distinct("no").alias("n_snapshots"), (F.max("no") - F.min("no") + 1 > F.count_distinct("no")).alias("has_gap"), *[F.count_distinct(c).alias(f"n_{c}") for c in attributes],
    )
    per = per.join(roots, "id", "left").withColumn("entity_id", F.coalesce("root", "id")).drop("root")
    w = W.partitionBy("entity_id")
    return per.withColumn("entity_size", F.count("*").over(w)).withColumn("entity_first", F.min("first_seen").over(w)).withColumn("entity_last", F.max("last_seen").over(w))


def seen_before(panel: DataFrame, id: str, snapshot: str) -> DataFrame:
    """Rows with whether the id stood in any earlier snapshot, and in which it did last."""
    w = W.partitionBy(id).orderBy(snapshot)
    return panel.dropDuplicates([id, snapshot]).withColumn("last_seen", F.lag(snapshot).over(w)).withColumn("seen_before", F.col("last_seen").isNotNull())


def provenance(panel: DataFrame, entity: str, id: str, snapshot: str) -> DataFrame:
    """For each entity how many ids it has, its first and last snapshot, and its latest id (of equal snapshots the largest)."""
    return panel.groupBy(entity).agg(F.count_distinct(id).alias("n_ids"), F.min(snapshot).alias("first"), F.max(snapshot).alias("last"), F.max_by(id, F.struct(snapshot, id)).alias("latest"))
