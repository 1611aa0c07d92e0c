"""Benchmark decontamination: a prefix-filtered join of document shingles with windows of benchmark items.

A window is `window` consecutive words of an item; an item of fewer words is one window. It occurs in a document where
its words stand consecutively: its containment is 1, so that every shingle of it must be there, and a prefix of one
shingle is enough to find it. Shingles (of five words, or the whole of a shorter window) are ordered by how often they
stand in all documents; each window is looked up by its rarest. A match at word p of a document, with the shingle at
word k of the window, can only be an occurrence that starts at p - k: that start and its end must lie in the document
(positional and length bounds), the hashes of all words must agree, and last the words themselves.

Documents are read twice, once to count the shingles, once to look them up, and never shuffled. Windows go to the
tasks in blocks of about `block` windows, a bound that does not depend on the data; more windows mean more blocks, each
a further map over the documents. All blocks are on the driver in the end: it holds the benchmark, not what it occurs in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import words

SHINGLE = 5


@dataclass
class Windows:
    """One block of the benchmark's different windows."""

    texts: list[tuple[bytes, ...]]
    items: list[list[str]]  # ids of the items that have each window
    prefix: np.ndarray = field(default=None)  # of each window, in the order of `tokens`
    offset: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.hashes = [words.hash_words(list(t)) for t in self.texts]
        self.shingle = np.minimum(self.lengths, SHINGLE)
        self.own = [words.shingle_hashes(h, int(n)) for h, n in zip(self.hashes, self.shingle, strict=True)]
        flat = np.concatenate(self.own) if self.own else np.zeros(0, np.uint64)
        sizes = np.repeat(self.shingle, [len(x) for x in self.own])
        self.by_size = {int(n): np.unique(flat[sizes == n]) for n in np.unique(sizes)}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Take each window's rarest shingle; of equally rare ones, the one of smallest hash."""
        self.offset = np.zeros(len(self.texts), np.int64)
        for i, (own, n) in enumerate(zip(self.own, self.shingle, strict=True)):
            often = counts[int(n)][np.searchsorted(self.by_size[int(n)], own)]
            self.offset[i] = np.lexsort((own, often))[0]
        chosen = np.array([own[k] for own, k in zip(self.own, self.offset, strict=True)], np.uint64)
        order = np.lexsort((chosen, self.shingle))
        self.order, self.prefix = order, chosen[order]
        self.span = {int(n): (int(np.searchsorted(self.shingle[order], n)), int(np.searchsorted(self.shingle[order], n, "right"))) for n in self.by_size}


class Lookup:
    """Positions of hashes in a sorted array; a table of the top bits rules out most at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(12, min(24, int(np.log2(len(keys) + 1)) + 6)))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[(keys >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, first position in keys) of those that are among the keys."""
        may = np.flatnonzero(self.there[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[may])
        is_in = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == hashes[may])
        return may[is_in], at[is_in]


def windows_of(benchmark: DataFrame, window: int, block: int, id: str, text: str) -> Iterator[Windows]:
    """Blocks of the benchmark's windows."""
    seen: dict[tuple[bytes, ...], list[str]] = {}
    for row in benchmark.select(F.col(id).cast("string"), F.col(text).cast("string")).orderBy(id, text).toLocalIterator():
        found = words.split_words(row[1])
        for i in range(max(1, len(found) - window + 1) if found else 0):
            ids = seen.setdefault(tuple(found[i : i + window]), [])
            if row[0] is not None and (not ids or ids[-1] != row[0]):
                ids.append(row[0])
        if len(seen) >= block:
            yield Windows(list(seen), list(seen.values()))
            seen = {}
    yield Windows(list(seen), list(seen.values()))


def _shingle_counts(block: Windows):
    lookups = {n: Lookup(keys) for n, keys in block.by_size.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(keys), np.int64) for n, keys in block.by_size.items()}
        for batch in batches:
            for g in words.word_groups(batch.column(0)):
                left = g.at[1:][g.row_of_words()] - np.arange(len(g.starts))  # words from here to the row's end
                for n, look in lookups.items():
                    shingles = words.shingle_hashes(g.hashes, n)
                    here, at = look.hits(shingles)
                    ok = left[here] >= n
                    totals[n] += np.bincount(at[ok], minlength=len(totals[n]))
        for n, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(t[at])], ["n", "at", "c"])

    return count


def _occurrences(block: Windows):
    lookups = {n: (Lookup(np.unique(block.prefix[a:b])), a, b) for n, (a, b) in block.span.items()}

    def find(g: words.Group, row: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, first word, window) of every occurrence in a group of rows."""
        out = []
        for n, (look, a, b) in lookups.items():
            shingles = words.shingle_hashes(g.hashes, n)
            here, at = look.hits(shingles)
            prefix = block.prefix[a:b]
            lo, hi = np.searchsorted(prefix, look.keys[at]), np.searchsorted(prefix, look.keys[at], "right")
            each = np.repeat(np.arange(len(here)), hi - lo)
            w = block.order[a + np.repeat(lo, hi - lo) + (np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))]
            r = row[here[each]]
            start = here[each] - block.offset[w]
            ok = (start >= g.at[r]) & (start + block.lengths[w] <= g.at[r + 1])
            for r, s, k in zip(r[ok], start[ok], w[ok], strict=True):
                m = block.lengths[k]
                if np.array_equal(g.hashes[s : s + m], block.hashes[k]) and g.phrase(s, m) == b" ".join(block.texts[k]):
                    out.append((int(r), int(s), int(k)))
        return out

    return find


def scan(rows: DataFrame, block: Windows, last: bool) -> DataFrame:
    """rows (doc_id, text, n_words, spans, items) after one more block of windows, whose prefixes are chosen; the last one leaves the text behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _occurrences(block)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            counts: list[np.ndarray] = []
            spans = [[(x["start"], x["end"]) for x in found] for found in batch.column(3).to_pylist()]
            items = [set(found) for found in batch.column(4).to_pylist()]
            for g in words.word_groups(batch.column(1)):
                for r, s, k in find(g, g.row_of_words()):
                    s -= int(g.at[r])
                    spans[g.first + r].append((s, s + int(block.lengths[k])))
                    items[g.first + r].update(block.items[k])
                counts.append(np.diff(g.at))
            made = [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in merge(x)] for x in spans], kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            own = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*own, *made], names)

    names = ["doc_id", *["text"] * (not last), "n_words", "spans", "items"]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def prepared(docs: DataFrame, benchmark: DataFrame, window: int, block: int, item_id: str, item_text: str, text: str) -> Iterator[Windows]:
    for b in windows_of(benchmark, window, block, item_id, item_text):
        counts = {n: np.zeros(len(keys), np.int64) for n, keys in b.by_size.items()}
        if b.texts:
            # one row for each different shingle of the block at most
            for n, at, c in docs.select(F.col(text).alias("text")).mapInArrow(_shingle_counts(b), "n int, at long, c long").groupBy("n", "at").agg(F.sum("c")).toLocalIterator():
                counts[n][at] = c
        b.choose(counts)
        yield b


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 1_000_000, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """For each row of docs: doc_id, n_words, spans (the hit words, as spans of words) and items (sorted ids).

    A null or empty text has no words and no hits; an item without words has no windows; an item with a null id is
    looked for and leaves spans, but no id; repeated rows each get their own result; an empty benchmark hits nothing;
    no rows give no rows. Other columns of either table are not looked at. More than `block` windows are looked up in
    several scans, one after the other on the same rows, so that the result does not depend on `block`.
    """
    shipping.ensure(docs.sparkSession)
    blank = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), *blank)
    blocks = prepared(docs, benchmark, window, block, item_id, item_text, text)
    now = next(blocks)
    for following in blocks:
        rows, now = scan(rows, now, False), following
    return scan(rows, now, True)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = 1_000_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no window occurs, one map for each block of windows and no shuffle."""
    shipping.ensure(docs.sparkSession)
    place = docs.columns.index(text)
    clean = docs
    for b in prepared(docs, benchmark, window, block, item_id, item_text, text):

        def run(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            find = _occurrences(b)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for g in words.word_groups(batch.column(place)):
                    keep[[g.first + r for r, _, _ in find(g, g.row_of_words())]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
