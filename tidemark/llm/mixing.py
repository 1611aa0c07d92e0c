"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every row gets the exponential key -ln(u) / w, with u a hash of its seed, id and text and w its quality weight. A source
whose target is e whole epochs and a rest takes every row e times, then the rows of smallest keys whose sizes sum to
the rest. The row at which the sum passes the rest is taken if that brings the sum nearer to the target.

No source is ever sorted as a whole. Sizes are summed into ranges of keys for each source before any shuffle, `buckets` of
them to each doubling of the key, so that a weight only shifts its rows by some ranges and none holds more than a small share of
a source. The prefix sums over these rows tell in which range a source's rest ends, and only that range's rows are sorted, equal rows
as one with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
OUT = ["size", "source_size", "target", "taken"]


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """docs with what mixing needs to know of a text: __size, __hash and __weight.

    The weight is 1 for a text whose words have 3 to 12 characters on average, else 0.5.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    measured = docs.withColumn("__size", size).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id), F.col(text)))
    mean = F.length(text) / F.greatest("__size", F.lit(1))
    return measured.withColumn("__weight", F.when(mean.between(3, 13), 1.0).otherwise(0.5))


def label_weight(measured: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """measured with its __weight times 2 for labelled quality 1, 0.5 for 0, between them for differing labels."""
    rated = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("__rated"))
    rated = rated.agg((0.5 + 1.5 * F.avg(F.col("quality").cast("double"))).alias("__quality"))
    joined = measured.filter(F.col(id).isNotNull()).join(rated, measured[id] == F.col("__rated"), "left")
    bare = measured.filter(F.col(id).isNull())  # rows without an id have no label, and would all meet in one task
    joined = joined.unionByName(bare.withColumns({"__rated": F.lit(None).cast(rated.schema["__rated"].dataType), "__quality": F.lit(None).cast("double")}))
    return joined.withColumn("__weight", F.col("__weight") * F.coalesce("__quality", F.lit(1.0))).drop("__rated", "__quality")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with each source's target, in words.

    In order of most * size / weight, the sources that stop at their limit come first; all others have one ratio of
    target to weight. The windows have one row for each source.
    """
    w = sizes.select("source", "source_size", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))).alias("__n"))
    w = w.withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__n") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("__limit", most * F.col("source_size")).withColumn("__all", share * F.sum("source_size").over(W.partitionBy()))
    before = W.orderBy(F.col("__limit") / F.col("__w"), "__n").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("__all") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / (F.sum("__w").over(W.partitionBy()) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    w = w.withColumn("__full", F.col("__limit") <= F.col("__w") * level)
    kept = lambda c: F.sum(F.when(F.col("__full"), F.col(c)).otherwise(0.0)).over(W.partitionBy())
    level = (F.col("__all") - kept("__limit")) / F.nullif(F.sum("__w").over(W.partitionBy()) - kept("__w"), F.lit(0.0))
    return w.select("source", "source_size", F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__w") * level).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    buckets: int = 256,
    small: int = 100_000,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """docs with size, source_size, target and taken (words taken from the row: size times its copies).

    Sources by code point, null last, have the weights in turn and share `share` times all words; none gets more than
    `most` times its own, the excess goes to the others by weight. docs may come from measure(), without their text
    and with any positive __weight. Null or empty texts have size 0 and nothing is taken of them; a null source is a
    source of its own; a null id is like any other; of equal rows at the edge as many are taken as come nearest to the target; no
    rows give no rows. Columns of docs named like a result column are replaced. The table of targets has a row for each source; it
    is broadcast if these are `small` at most, else it is joined by a shuffle.
    """
    base = docs if "__size" in docs.columns else measure(docs, id, text, seed)
    u = (F.pmod("__hash", F.lit(1 << 53)) + 0.5) / float(1 << 53)
    base = base.withColumn("__key", F.greatest(-F.log(u), F.lit(2.0**-54)) / F.greatest(F.coalesce("__weight", F.lit(1.0)), F.lit(1e-6)))
    base = base.withColumn("__bucket", F.floor(buckets * F.log2("__key")).cast("int"))
    rank = F.struct(F.col("__key").alias("k"), F.col("__hash").alias("h"), F.col("__size").alias("s"))
    of_source = F.col(source).eqNullSafe(F.col("__source"))

    spread = scratch.table(base.groupBy(F.col(source).alias("__source"), "__bucket").agg(F.sum("__size").alias("__sum")), "spread")
    sizes = spread.groupBy(F.col("__source").alias("source")).agg(F.sum("__sum").alias("source_size"))
    goal = targets(sizes, weights, share, most).withColumnsRenamed({"source": "__source", "source_size": "__source_size", "target": "__target"})
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    goal = goal.withColumn("__epochs", epochs.cast("long")).withColumn("__rest", F.col("__target") - F.col("__epochs") * F.col("__source_size"))
    upto = spread.withColumn("__upto", F.sum("__sum").over(W.partitionBy("__source").orderBy("__bucket"))).withColumnRenamed("__source", "__s")
    ends = upto.join(goal.select("__source", "__rest"), F.col("__s").eqNullSafe(F.col("__source")))
    ends = ends.filter((F.col("__upto") > F.col("__rest")) & (F.col("__rest") > 0)).groupBy("__s")
    ends = ends.agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__sum")).alias("__before"))).alias("__e"))
    goal = goal.join(ends, F.col("__source").eqNullSafe(F.col("__s")), "left").select(*goal.columns, F.col("__e.__bucket").alias("__edge"), F.col("__e.__before").alias("__before"))
    goal = scratch.table(goal, "goal")
    sent = F.broadcast if goal.count() <= small else lambda x: x

    edge = sent(goal.select("__source", "__edge", "__before", "__rest"))
    last = base.select(source, "__bucket", "__size", rank.alias("__rank")).join(edge, of_source & (F.col("__bucket") == F.col("__edge")))
    last = last.groupBy("__source", "__before", "__rest", "__rank").agg(F.count("*").alias("__n"))
    own = F.col("__rank.s") * F.col("__n")
    last = last.withColumn("__upto", F.col("__before") + F.sum(own).over(W.partitionBy("__source").orderBy("__rank")))
    # the last rank of which anything is taken: so many of its equal rows as come nearest to what is left for them
    fits = F.least(F.col("__n"), F.round((F.col("__rest") - F.col("__upto") + own) / F.nullif(F.col("__rank.s"), F.lit(0))).cast("long"))
    last = last.withColumn("__fits", F.coalesce(fits, F.col("__n"))).filter("__fits > 0")
    last = last.groupBy("__source").agg(F.max(F.struct("__rank", "__fits", "__n")).alias("__l")).withColumnRenamed("__source", "__s")
    goal = goal.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumns({"__last": F.col("__l.__rank"), "__fits": F.col("__l.__fits"), "__n": F.col("__l.__n")})
    goal = scratch.table(goal.drop("__s", "__rest", "__before", "__l"), "goal")
    out = base.join(sent(goal), of_source, "left")
    in_edge = F.col("__bucket") == F.col("__edge")
    at_end = F.coalesce(in_edge & (rank == F.col("__last")) & (F.col("__fits") < F.col("__n")), F.lit(False))
    extra = (F.col("__bucket") < F.col("__edge")) | (in_edge & F.coalesce(rank <= F.col("__last"), F.lit(False)))
    if goal.filter("__fits < __n").isEmpty():
        out = out.withColumn("__copies", F.col("__epochs") + F.coalesce(extra, F.lit(False)).cast("long"))
    else:  # equal rows are told apart by their place
        place = F.row_number().over(W.partitionBy("__source").orderBy("__hash"))
        some = out.filter(at_end).withColumn("__copies", F.col("__epochs") + (place <= F.col("__fits")).cast("long"))
        out = out.filter(~at_end).withColumn("__copies", F.col("__epochs") + F.coalesce(extra, F.lit(False)).cast("long")).unionByName(some)
    out = out.withColumn("__taken", F.col("__size") * F.col("__copies"))
    kept = [c for c in docs.columns if c not in OUT and c not in ("__size", "__hash", "__weight")]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__{c}").alias(c) for c in OUT], "__copies")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: each as often as it is taken, rows of no words not at all."""
    mixed = mix(docs.select("*", *[F.col(f"`{c}`").alias(f"__in_{c}") for c in docs.columns if c in OUT]), **options)
    rows = mixed.filter(F.col("taken") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return rows.select(*[(F.col(f"__in_{c}") if c in OUT else F.col(f"`{c}`")).alias(c) for c in docs.columns])
