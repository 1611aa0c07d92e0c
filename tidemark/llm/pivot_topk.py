"""Exact top-k search by inner product with pivot-table elimination.

Components become the integers floor(1024 * x), so that scores are exact. One more coordinate, sqrt(M - |x|^2) with M the
largest squared norm, gives all rows one length; a query gets 0 there. Then d(q, x)^2 = |q|^2 + M - 2 q.x, and nearest is
best. A table holds each row's distances to many pivots. By the triangle inequality |d(q, p) - d(x, p)| bounds d(q, x)
from below for each pivot p, the largest bound counts, and it turns into an upper bound of the score. Candidates of a
block are evaluated in the order of these bounds until the next bound is below the k-th best score known: from there on
no row can enter. Pivots are rows themselves, so their exact scores give every query a first k-th best score.

Rows are dealt to their nearest pivot. From the least and largest distance of such a cluster's rows to every pivot follows a bound for all
of them at once, so that a query is sent only to clusters that may hold one of its k best. Rows of a cluster and the queries sent to it meet
in blocks, one task for each pair of blocks: no task holds many more than `row_block` rows and `query_block` queries, and each pair of rows
is met once at most. Rows with a component beyond LIMIT meet the queries in such blocks without bounds, in integers of any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import components, scratch

SCALE = 1024
#: Scaled components below this are handled in 64 bits, larger ones as integers of any size.
LIMIT = 1 << 20
#: Integers of any size are ordered as arrays of limbs of 62 bits; 40 hold the product of any two doubles, scaled and summed.
LIMBS, LIMB = 40, (1 << 62) - 1


def finite_rows(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, e, wide): the rows that take part, wide where a scaled component reaches LIMIT.

    Rows whose id or vector is null, or whose vector holds a component that is null, NaN or infinite, or is so once scaled, don't.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf"))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("e").isNotNull()).filter(F.coalesce(F.forall("e", finite), F.lit(False)))
    return rows.withColumn("wide", F.exists("e", lambda x: F.abs(x) >= LIMIT / SCALE))


def prepared(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): integer vectors of the rows that take part and aren't wide."""
    rows = finite_rows(vectors, id, embedding).filter(~F.col("wide"))
    return rows.select("id", F.transform("e", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as rows of float64; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max([*sizes.tolist(), 1]) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


@dataclass
class Pivots:
    ids: np.ndarray
    rows: np.ndarray
    norm: float  # M

    def lifted(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm - (self.rows**2).sum(1), 0))

    def fit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and the pivots at one width."""
        width = max(x.shape[1], self.rows.shape[1])
        pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
        return pad(x), pad(self.rows)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        x, p = self.fit(x)
        own = (x**2).sum(1)
        up = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm - own, 0))
        square = (own + up**2)[:, None] + self.norm - 2 * (x @ p.T + up[:, None] * self.lifted())
        return np.sqrt(np.maximum(square, 0))


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> Pivots:
    """Farthest-first choice of pivots among the `sample` rows of smallest hash."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    norm = rows.agg(F.max(square)).first()[0] or 0.0
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).collect()
    unique = {r["id"]: r["v"] for r in some}
    width = max([len(v) for v in unique.values()] + [1])
    x = np.zeros((len(unique), width))
    for i, v in enumerate(unique.values()):
        x[i, : len(v)] = v
    ids, chosen = np.array(list(unique), np.int64), []
    lifted = np.concatenate([x, np.sqrt(np.maximum(norm - (x**2).sum(1), 0))[:, None]], 1)
    apart = np.full(len(ids), np.inf)
    while len(chosen) < min(pivots, len(ids)):
        chosen.append(int(np.argmax(apart)))
        apart = np.minimum(apart, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        apart[chosen] = -1
    return Pivots(ids[chosen], x[chosen], norm)


def best_of_block(ids: np.ndarray, x: np.ndarray, table: np.ndarray, q: np.ndarray, q_ids: np.ndarray, pivots: Pivots, k: int, chunk: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of the rows of a block that may be among a query's k best; evaluated counts in .n"""
    x, p = pivots.fit(x)
    q = np.pad(q, ((0, 0), (0, max(0, x.shape[1] - q.shape[1]))))
    x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
    p = np.pad(p, ((0, 0), (0, q.shape[1] - p.shape[1])))
    own = (q**2).sum(1)
    exact = x.astype(np.int64)
    whole = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] >= 2**53
    to_pivots = pivots.distances(q, True)
    known = np.where(pivots.ids[None, :] == q_ids[:, None], -np.inf, q @ p.T) if not whole else np.full((len(q), len(p)), -np.inf)
    floor = np.sort(known, 1)[:, -k] if len(p) >= k else np.full(len(q), -np.inf)
    for first in range(0, len(q), chunk):
        part = slice(first, min(first + chunk, len(q)))
        low = np.zeros((part.stop - part.start, len(x)))
        for j in range(len(p)):
            np.maximum(low, np.abs(to_pivots[part, j][:, None] - table[:, j]), out=low)
        scale = own[part][:, None] + pivots.norm
        most = (scale - np.maximum(low - 1e-6 * np.sqrt(scale + 1), 0) ** 2) / 2 + 1e-6 * scale + 1
        for i in range(first, part.stop):
            order = np.argsort(-most[i - first], kind="stable")
            bound = most[i - first][order]
            got_ids, got, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 128
            least = floor[i]
            while at < len(order) and bound[at] >= least:
                take = order[at : at + step]
                take = take[bound[at : at + step] >= least]
                at, step = at + step, step * 2
                take = take[ids[take] != q_ids[i]]
                score = exact[take] @ q[i].astype(np.int64) if whole else np.rint(x[take] @ q[i]).astype(np.int64)
                got_ids, got = np.concatenate([got_ids, ids[take]]), np.concatenate([got, score])
                if len(got) > k:
                    keep = np.lexsort((got_ids, -got))[:k]
                    got_ids, got = got_ids[keep], got[keep]
                if len(got) == k:
                    least = max(least, got.min())
            yield i, got_ids, got


@dataclass
class Cluster:
    """The rows nearest to one pivot: how many they are, and their least and largest distance to every pivot."""

    number: int
    rows: int
    least: np.ndarray
    most: np.ndarray
    first: int = 0  # its blocks are first..first+blocks-1
    blocks: int = 1


def clusters_of(table: DataFrame, pivots: int, row_block: int, cores: int) -> list[Cluster]:
    """One for each pivot at most, with blocks of about row_block rows; small tables still get a block for each core."""
    sides = [f(F.col("far")[j]).alias(f"{n}{j}") for j in range(pivots) for n, f in (("l", F.min), ("m", F.max))]
    found = table.groupBy("near").agg(F.count("*").alias("n"), *sides).orderBy("near").collect()  # a row for each pivot at most
    out, first, all_rows = [], 0, sum(r["n"] for r in found)
    size = min(row_block, max(1024, math.ceil(all_rows / cores)))
    for r in found:
        c = Cluster(r["near"], r["n"], np.array([r[f"l{j}"] for j in range(pivots)]), np.array([r[f"m{j}"] for j in range(pivots)]), first, math.ceil(r["n"] / size))
        out.append(c)
        first += c.blocks
    return out


def routed(q: np.ndarray, q_ids: np.ndarray, pivots: Pivots, clusters: list[Cluster], k: int) -> np.ndarray:
    """Whether each cluster (column) may hold one of the k best of each query (row)."""
    q, p = pivots.fit(q)
    far, scale = pivots.distances(q, True), (q**2).sum(1) + pivots.norm
    known = np.where(pivots.ids[None, :] == q_ids[:, None], -np.inf, q @ p.T)
    floor = np.sort(known, 1)[:, -k] if len(p) >= k else np.full(len(q), -np.inf)
    out = np.ones((len(q), len(clusters)), bool)
    for i, c in enumerate(clusters):
        low = np.maximum(np.maximum(far - c.most, c.least - far).max(1, initial=0), 0)
        most = (scale - np.maximum(low - 1e-6 * np.sqrt(scale + 1), 0) ** 2) / 2 + 1e-6 * scale + 1
        out[:, i] = most >= floor - 1e-6 * scale
    return out


def limbs(score: int) -> list[int]:
    """An integer as an array that orders as it does."""
    return [score >> 62 * (LIMBS - 1), *[(score >> 62 * i) & LIMB for i in range(LIMBS - 2, -1, -1)]]


def _limbs(score: Column) -> Column:
    """limbs() of a 64-bit score whose absolute value is below 2^62."""
    fill = lambda top, rest: F.array(F.lit(top).cast("long"), *[F.lit(rest).cast("long")] * (LIMBS - 2), score.bitwiseAND(F.lit(LIMB)))
    return F.when(score < 0, fill(-1, LIMB)).otherwise(fill(0, 0))


def wide_pairs(rows: DataFrame, is_query: Column, k: int, row_block: int, query_block: int, wide: int, count: int, queries: int) -> DataFrame:
    """(number, query_id, vec_id, score, key) of pairs of which a row is wide, each query's k best of every block. rows: finite_rows()"""
    whole = lambda x: F.when(F.abs(x) * SCALE < float(1 << 53), F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    rows = rows.select("id", "wide", F.transform("e", whole).alias("v")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = scratch.table(rows, "wide-vectors")
    asked = rows.filter(is_query).select("id", "v", "wide").dropDuplicates(["id", "v"]).withColumn("number", F.xxhash64("id", "v"))
    parts = []
    for right, left, n, m in ((asked.filter("wide"), rows, count, min(wide, queries)), (asked.filter("not wide"), rows.filter("wide"), wide, queries)):
        row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(m / query_block))
        left = left.withColumn("block", F.pmod("spread", F.lit(row_blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        right = right.withColumn("query_block", F.pmod("number", F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
        left, right = left.select("block", "query_block", "id", "v"), right.select("block", "query_block", F.col("id").alias("q_id"), F.col("v").alias("q"), "number")

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            both = a.num_rows and b.num_rows  # a side without rows has no columns
            ids, vectors = (a["id"].to_pylist(), [[int(x) for x in v] for v in a["v"].to_pylist()]) if both else ([], [])
            for q_id, v, number in zip(b["q_id"].to_pylist(), b["q"].to_pylist(), b["number"].to_pylist(), strict=True) if both else ():
                q = [int(x) for x in v]
                best = heapq.nsmallest(k, ((-sum(x * y for x, y in zip(q, w, strict=False)), i) for i, w in zip(ids, vectors, strict=True) if i != q_id))
                out += [(number, q_id, i, max(min(-s, 2**63 - 1), -(2**63)), limbs(-s)) for s, i in best]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["number", "query_id", "vec_id", "score", "key"])

        keys = ["block", "query_block"]
        parts.append(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "number long, query_id long, vec_id long, score long, key array<long>"))
    return parts[0].unionByName(parts[1])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, sample: int = 1024, row_block: int = 65536, query_block: int = 16384, id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by inner product, ties to smaller ids.

    is_query is a condition on the column `id` of the prepared rows. Rows that take no part: see finite_rows(). A query's own id
    is no candidate for it; a repeated id is a candidate once for each of its rows, and equal query rows are one query.
    A shorter vector counts as padded with zeros. A score beyond 64 bits is ranked as it is and shown as the nearest long. Queries of
    fewer than k candidates get all of them; no rows, none.
    """
    spark = vectors.sparkSession
    shipping.ensure(spark)
    every = finite_rows(vectors, id, embedding)
    count, wide, queries = every.agg(F.count("*"), F.count_if("wide"), F.count_if(is_query)).first()
    rows = prepared(vectors, id, embedding)
    chosen = choose_pivots(rows, pivots, sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = chosen.distances(matrix(b.column(1)), False) if b.num_rows else np.zeros((0, len(chosen.ids)))
            table = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            near = far.argmin(1) if far.size else np.zeros(len(far), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), table, pa.array(near, pa.int32())], ["id", "v", "far", "near"])

    table = rows.mapInArrow(measure, "id long, v array<int>, far array<double>, near int")
    table = scratch.table(table.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "pivot-table")
    clusters = clusters_of(table, len(chosen.ids), row_block, spark.sparkContext.defaultParallelism)
    query_blocks = max(1, math.ceil(queries / query_block))
    first, blocks = (F.create_map(*[F.lit(x) for c in clusters for x in (c.number, v(c))], F.lit(-1), F.lit(1)) for v in (lambda c: c.first, lambda c: c.blocks))
    table = table.withColumn("block", (first[F.col("near")] + F.pmod("spread", blocks[F.col("near")])).cast("int")).select("block", "id", "v", "far")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                may = routed(matrix(part.column(1)), part.column(0).to_numpy(), chosen, clusters, k)
                to = [[x for c, yes in zip(clusters, m, strict=True) if yes for x in range(c.first, c.first + c.blocks)] for m in may]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to, pa.list_(pa.int32()))], ["q_id", "q", "number", "blocks"])

    asked = table.filter(is_query).select("id", "v").dropDuplicates(["id", "v"]).withColumn("number", F.xxhash64("id", F.col("v").cast("array<double>")))
    asked = scratch.table(asked.mapInArrow(route, "q_id long, q array<int>, number long, blocks array<int>"), "asked")
    right = asked.withColumn("query_block", F.pmod("number", F.lit(query_blocks)).cast("int")).withColumn("block", F.explode("blocks")).drop("blocks")
    met = scratch.table(right.select("block", "query_block").dropDuplicates(), "met")  # no more than pairs of blocks
    left = table.join(components.sent(met), "block")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, q_ids = a["id"].to_numpy(), b["q_id"].to_numpy()
            x, far = matrix(a["v"]), matrix(a["far"], len(chosen.ids))
            for i, got, score in best_of_block(ids, x, far, matrix(b["q"]), q_ids, chosen, k):
                out.append((np.full(len(got), b["number"][i].as_py()), np.full(len(got), q_ids[i]), got, score))
        parts = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4)]
        return pa.table([pa.array(p, pa.int64()) for p in parts], ["number", "query_id", "vec_id", "score"])

    keys = ["block", "query_block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "number long, query_id long, vec_id long, score long")
    order = [F.desc("score"), "vec_id"]
    if wide:
        near = near.withColumn("key", _limbs(F.col("score"))).unionByName(wide_pairs(every, is_query, k, row_block, query_block, wide, count, queries))
        order = [F.desc("key"), "vec_id"]
    rank = F.row_number().over(W.partitionBy("number").orderBy(*order))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
