"""Sharding by a permutation-filled lookup table. DataFrame functions only.

Each shard has its own order of the slots of a table of prime size: an offset and a step, both from a hash of its name.
Shards take turns; each claims the next slot in its order that is still free, until none is. All shards then own as
many slots as any other, give or take one, and few slots change owner when a shard is added or leaves. A row's slot is
a hash of its key; the table has a fixed number of rows, so a broadcast join finds the shard in constant time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
OUT = ["slot", "shard", "shard_name"]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup(names: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the number of the shard in names that owns it."""
    if not is_prime(slots):
        raise ValueError(f"the table's size must be prime: {slots}")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("one to `slots` shards with different names are needed")
    at, step = [], []
    for name in names:
        h = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        step.append(int.from_bytes(h[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1)
    owner, free = [-1] * slots, slots
    while free:
        for s in range(len(names)):
            if not free:
                break
            while owner[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            owner[at[s]] = s
            free -= 1
    return owner


def lookup_table(spark: SparkSession, names: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard, shard_name): one row for each slot, as many as `slots` whatever the input is."""
    owners = F.from_json(F.lit(json.dumps(lookup(names, slots), separators=(",", ":"))), "array<int>")
    called = F.from_json(F.lit(json.dumps(list(names))), "array<string>")
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))
    return rows.select("slot", "shard", F.element_at(called, F.col("shard") + 1).alias("shard_name"))


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def shard(docs: DataFrame, names: Sequence[str], slots: int = SLOTS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with slot, shard and shard_name. The key is the id, or the text where the id is null.

    Rows of one key meet in one shard; a null id with a null text has a slot as well; no rows give no rows. Columns of
    docs named like a result column are replaced.
    """
    spread = F.when(F.col(id).isNull(), F.col(text).cast("string")) if text in docs.columns else F.lit(None).cast("string")
    table = lookup_table(docs.sparkSession, names, slots).withColumnsRenamed({c: f"__{c}" for c in OUT})
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in OUT]
    placed = docs.withColumn("__at", slot_of([F.col(id), spread], slots))
    placed = placed.join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    return placed.select(*kept, *[F.col(f"__{c}").alias(c) for c in OUT])


def write_shards(placed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each shard; a shard's rows are written by many tasks, so that none has a whole shard."""
    placed.write.mode(mode).partitionBy("shard").parquet(path)
