"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its runs of two words, its first word after the start and its last before the end, each labelled
with which occurrence it is, so that repeats count. Each of
`sketches` hash functions picks the `picked` labelled k-mers of smallest hash and lists them in the order of the text: one
sketch. Two documents have equal sketches only if they share these k-mers in the same order, which depends on their edit
distance. Documents that share a sketch are candidates; a banded bit-parallel alignment of their words decides: similar
means that at most (1 - threshold) times the longer one's words must be changed, put in or left out.

Copies that are equal word for word are one node from the start. In each bucket of equal sketches all nodes are compared
with one of them (components.linked). Buckets whose nodes are then in several components are completed as groups (joining):
runs of two words in common are counted for all pairs of a group at once, and pairs that have as many as similar texts must
have are aligned until no more components can be joined. No link of a bucket is lost, and no row is made for a pair.

Runs of two words outlive scattered edits: with every fifth word changed, three of five are left, and none of five words.
Of texts of check_l with words changed or left out at random places, 48 sketches of three k-mers found all with 10 % or 15 %
of the words edited, and with 20 % 0.999 (2000 texts of 80 to 400 words) and 0.998 (1548 texts of 20 to 60 words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import components, scratch, words

K, SKETCHES, PICKED, THRESHOLD = 2, 48, 3, 0.8
#: Pairs aligned at once, if their longest text times their number isn't more than MOST_CELLS.
BATCH, MOST_CELLS = 1024, 8_000_000
_MAX = np.uint64(2**64 - 1)
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def kmers(g: words.Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words, in order; a row of fewer words is one run."""
    n = np.diff(g.at)
    row = g.row_of_words()
    whole = words.shingle_hashes(g.hashes, k)
    starts = np.flatnonzero(g.at[1:][row[: len(whole)]] - np.arange(len(whole)) >= k)
    rows, hashes = [row[starts]], [whole[starts]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            rows.append(short)
            hashes.append(words.shingle_hashes(g.hashes, size)[g.at[short]])
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def with_ends(g: words.Group, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers between each row's first word after the start and its last before the end."""
    some = np.flatnonzero(np.diff(g.at))
    first, last = words.mix(g.hashes[g.at[some]] ^ _START), words.mix(g.hashes[g.at[some + 1] - 1] ^ _END)
    rows = np.concatenate([some, rows, some])
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate([first, hashes, last])[order]


def labelled(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that tell occurrences of one k-mer in one row apart."""
    key = words.mix(hashes ^ words.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return words.mix(hashes + occurrence * np.uint64(0xA0761D6478BD642F))


def sketch_rows(rows: np.ndarray, hashes: np.ndarray, sketches: int, picked: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have k-mers, their sketches: one column for each)"""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, sketches), np.uint64)
    label = labelled(rows, hashes)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    size = np.diff(np.append(first, len(rows)))
    of = np.repeat(np.arange(len(first)), size)
    out = np.empty((len(first), sketches), np.uint64)
    rng = np.random.default_rng(seed)
    for i in range(sketches):
        xor, factor = rng.integers(0, 2**64, 2, np.uint64)
        v = (label ^ xor) * (factor | np.uint64(1))
        at = np.full((len(first), picked), len(rows), np.int64)  # a place past the end sorts last
        for j in range(picked):
            least = np.minimum.reduceat(v, first)
            hit = np.flatnonzero(v == least[of])
            hit = hit[np.searchsorted(of[hit], np.arange(len(first)))]
            at[:, j] = np.where(size > j, hit, len(rows))
            v[hit] = _MAX
        at.sort(1)
        total = np.full(len(first), np.uint64(i + 1))
        for j in range(picked):
            there = at[:, j] < len(rows)
            total = words.mix(total ^ np.where(there, hashes[np.minimum(at[:, j], len(rows) - 1)], np.uint64(0)))
        out[:, i] = total
    return rows[first], out


def distance(a: np.ndarray, b: np.ndarray, k: int) -> int | None:
    """The edit distance of a and b, None if it is more than k. Bit-parallel columns over a band of 2k + 1 diagonals."""
    shared = min(len(a), len(b))
    differ = np.flatnonzero(a[:shared] != b[:shared])
    head = int(differ[0]) if len(differ) else shared
    a, b = a[head:], b[head:]
    shared = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:shared] != b[::-1][:shared])
    tail = int(differ[0]) if len(differ) else shared
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > k:
        return None
    if n == 0:
        return m
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    if m <= 2 * k + 1:
        found = _whole(places, m, b.tolist())
        return found if found <= k else None
    width = 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    up, down = mask >> k << k, 0
    found, most = k, k + n - (m - k)
    bit = 1 << (width - 2) if width > 1 else 0
    for j, w in enumerate(b.tolist(), 1):
        seen = places.get(w, 0)
        shift = j - k - 1
        seen = (seen >> shift if shift >= 0 else seen << -shift) & mask
        zero = (((seen & up) + up) ^ up | seen | down) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        if j <= m - k:
            found += not zero & top
            if found > most:
                return None
        else:
            found += bool(plus & bit) - bool(minus & bit)
            bit >>= 1
        up, down = (minus | ~(zero >> 1 | plus)) & mask, (zero >> 1) & plus
    return found if found <= k else None


def _whole(places: dict[int, int], m: int, b: list[int]) -> int:
    mask, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = mask, 0, m
    for w in b:
        seen = places.get(w, 0)
        zero = (((seen & up) + up) ^ up | seen | down) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(zero | plus)) & mask, zero & plus & mask
    return distance


def allowed(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    return int((1 - threshold) * max(len(a), len(b)) + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    return distance(a, b, allowed(a, b, threshold)) is not None


def _node(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def described(docs: DataFrame, text: str, keys: list[str], k: int, sketches: int, picked: int) -> DataFrame:
    """keys of each row with node (a hash of its words, null if it has none), n_words and sketches."""
    from pyspark.sql import types as T

    shipping.ensure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in words.word_groups(batch.column(len(keys))):
                rows, found = sketch_rows(*with_ends(g, *kmers(g, k)), sketches, picked)
                size = np.diff(g.at)
                node = [_node(g.hashes[a:b]) for a, b in zip(g.at[:-1], g.at[1:], strict=True)]
                ends = np.zeros(len(size) + 1, np.int64)
                np.cumsum(np.isin(np.arange(len(size)), rows) * sketches, out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel().view(np.int64)))
                kept = [batch.column(i).slice(g.first, len(size)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(node, pa.binary()), pa.array(size, pa.int64()), lists], [*keys, "node", "n_words", "sketches"])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keys]
    schema = T.StructType([*fields, T.StructField("node", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("sketches", T.ArrayType(T.LongType()))])
    return docs.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def word_lists(docs: DataFrame, text: str) -> DataFrame:
    """(node, words): for each row with words the 32-bit hashes of these."""
    shipping.ensure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in words.word_groups(batch.column(0)):
                short = (g.hashes >> np.uint64(32)).astype(np.uint32)
                spans = [(a, b) for a, b in zip(g.at[:-1], g.at[1:], strict=True) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([_node(g.hashes[a:b]) for a, b in spans], pa.binary()), pa.array([short[a:b].tobytes() for a, b in spans], pa.binary())], ["node", "words"])

    return docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "node binary, words binary")


def aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose words are similar."""
    one = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    two = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda s: np.frombuffer(s.as_buffer(), np.uint32)
        for batch in batches:
            near = [similar(read(x), read(y), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def common_runs(lists: list[np.ndarray], one: np.ndarray, two: np.ndarray | None) -> np.ndarray:
    """How many occurrence-labelled runs of two words (with the ends) texts have in common: rows `one`, columns `two` or again `one`.

    Runs that many texts have are counted by a product of matrices, others by the pairs of texts that have them.
    """
    n = np.array([len(w) for w in lists])
    padded = np.concatenate([x for w in lists for x in ([_START], w.astype(np.uint64), [_END])])
    row = np.repeat(np.arange(len(lists)), n + 1)
    at = np.arange(len(row)) + row  # in padded, a row has one word more than runs
    token = labelled(row, words.mix(padded[at] * np.uint64(0x9E3779B97F4A7C15) ^ words.mix(padded[at + 1])))
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    held = np.diff(np.append(first, len(token)))
    often = held > max(8, len(lists) // 32)
    place = np.empty((2, len(lists)), np.int64)
    for side, who in enumerate((one, one if two is None else two)):
        place[side] = -1
        place[side][who] = np.arange(len(who))
    width = len(one if two is None else two)
    out = np.zeros((len(one), width), np.float32)
    dense = np.flatnonzero(often)
    for lo in range(0, len(dense), 1024):
        some = dense[lo : lo + 1024]
        column = np.repeat(np.arange(len(some)), held[some])
        entry = np.repeat(first[some] - np.concatenate([[0], np.cumsum(held[some])[:-1]]), held[some]) + np.arange(len(column))
        there = np.zeros((len(lists), len(some)), np.float32)
        there[row[entry], column] = 1
        out += there[one] @ there[one if two is None else two].T
    few = np.repeat(~often & (held > 1), held)
    token, row = token[few], row[few]
    for step in range(1, int(held[~often].max(initial=1))):  # texts that stand `step` places apart among those of a run
        apart = np.flatnonzero(token[step:] == token[:-step])
        if not len(apart):
            break
        x, y = row[apart], row[apart + step]
        for x, y in ((x, y), (y, x)):
            a, b = place[0][x], place[1][y]
            ok = (a >= 0) & (b >= 0)
            np.add.at(out.reshape(-1), a[ok] * width + b[ok], np.float32(1))
    return out


def found_within(lists: list[np.ndarray], root: list, side: np.ndarray | None, threshold: float, sketches: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Similar pairs that join all components that similar pairs join; side: whether a text is of the second of two parts, None for one part.

    Of texts that share a sketch those pairs are left out that share an earlier one too, as they meet in its group.

    An edit changes two runs of two words at most, so texts that differ by d edits have at least (runs of the longer one) - 2d in common.
    Pairs that have so many are aligned, texts with most such pairs first, unless pairs found before join them already.
    """
    one, two = (np.arange(len(lists)), None) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    other = one if two is None else two
    if not len(one) or not len(other):
        return []
    n = np.array([len(w) for w in lists])
    name = {}
    of = np.array([name.setdefault(r, len(name)) for r in root])
    longer = np.maximum(n[one][:, None], n[other][None, :])
    edits = np.floor((1 - threshold) * longer + 1e-9).astype(np.int64)
    ok = (of[one][:, None] != of[other][None, :]) & (np.abs(n[one][:, None] - n[other][None, :]) <= edits)
    if sketches is not None:
        shared = (sketches == sketches[0]).all(0)
        for before in sketches.T[: shared.argmax()]:
            ok &= before[one][:, None] != before[other][None, :]
    if ok.sum() > 4:
        ok &= common_runs(lists, one, two) >= longer + 1 - 2 * edits
    if two is None:
        may = ok
    else:
        may = np.zeros((len(lists), len(lists)), bool)
        may[np.ix_(one, two)], may[np.ix_(two, one)] = ok, ok.T
    degree, out, waiting = may.sum(1), [], []
    ids = np.unique(np.concatenate(lists), return_inverse=True)[1]
    ids = np.split(ids, np.cumsum(n)[:-1])
    order = np.argsort(-degree, kind="stable")[: np.count_nonzero(degree)].tolist()
    for turn, x in enumerate(order):
        left = np.flatnonzero(may[x] & (of != of[x]))
        may[:, x] = False  # all pairs of x are decided now
        waiting += [(x, y) for y in left.tolist()]
        if len(waiting) < BATCH and turn < len(order) - 1:
            continue
        for at in range(0, len(waiting), BATCH):
            some = [(x, y) for x, y in waiting[at : at + BATCH] if of[x] != of[y]]
            longest = max((max(n[x], n[y]) for x, y in some), default=0)
            if len(some) >= 256 and longest * len(some) <= MOST_CELLS:
                found = [pair for pair, near in zip(some, all_similar(ids, some, threshold).tolist(), strict=True) if near]
            else:
                found = (pair for pair in some if of[pair[0]] != of[pair[1]] and similar(lists[pair[0]], lists[pair[1]], threshold))
            for x, y in found:
                if of[x] != of[y]:
                    of[of == of[y]] = of[x]
                    out.append((x, y))
        waiting = []
    return out


def all_similar(ids: list[np.ndarray], pairs: list[tuple[int, int]], threshold: float) -> np.ndarray:
    """Whether the texts of each pair are similar, as similar() has it, for all pairs at once. ids: texts, their words numbered from 0.

    These are the bit-parallel columns in blocks of 64 bits, those of the band. What lies outside the band counts as growing by
    one at each step, which is never less than it is.
    """
    one, other = np.array(pairs).T
    m, size = np.array([len(w) for w in ids])[np.array([one, other])]
    blocks = -(-int(m.max()) // 64)
    local = np.zeros(1 + max(int(w.max()) for w in ids), np.int32)
    tables, column, base = [np.zeros((1, blocks), np.uint64)], np.zeros((int(size.max()), len(pairs)), np.int32), 1
    by = np.argsort(one, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(one[by])) + 1):
        words_, of = np.unique(ids[one[group[0]]], return_inverse=True)
        at = np.arange(len(of))
        table = np.zeros((len(words_), blocks), np.uint64)
        np.bitwise_or.at(table, (of, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        local[words_] = base + np.arange(len(words_), dtype=np.int32)
        for p in group.tolist():
            column[: size[p], p] = local[ids[other[p]]]
        local[words_] = 0
        tables.append(table)
        base += len(words_)
    places = np.ascontiguousarray(np.concatenate(tables).T)
    longer = np.maximum(m, size)
    limit = np.floor((1 - threshold) * longer + 1e-9).astype(np.int64)
    band = int(limit.max())
    bottom = min(blocks - 1, band // 64)
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    found = np.minimum(64 * (bottom + 1), m)  # distances at the last row of block `bottom`, or of the text
    one, top = np.uint64(1), np.uint64(63)
    up = np.full((blocks, len(pairs)), _MAX)
    down = np.zeros_like(up)
    for j in range(len(column)):
        more, less = np.ones(len(pairs), np.uint64), np.zeros(len(pairs), np.uint64)
        if bottom < min(blocks - 1, (j + band) // 64):
            bottom += 1
            found += np.clip(m - 64 * bottom, 0, 64)
        grown = None
        for i in range(max(0, j - band) // 64, bottom + 1):
            seen, u, d = places[i][column[j]], up[i], down[i]
            vertical = seen | d
            seen = seen | less
            zero = (((seen & u) + u) ^ u) | seen
            plus, minus = d | ~(zero | u), u & zero
            if (ends := last == np.int64(i)).any() or i == bottom:
                place = np.where(ends, bit, top)
                step = ((plus >> place) & one).astype(np.int64) - ((minus >> place) & one).astype(np.int64)
                here = ends | ((last > i) & (i == bottom))
                grown = np.where(here, step, 0 if grown is None else grown)
            above, below = plus >> top, minus >> top
            plus, minus = (plus << one) | more, (minus << one) | less
            up[i], down[i] = minus | ~(vertical | plus), plus & vertical
            more, less = above, below
        found += np.where(j < size, grown, 0)
    return (found <= limit) & (np.abs(m - size) <= limit)


def joining(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that join the components of each group of components.dealt() as all its similar pairs would."""
    held = members.join(texts, "node").select("group", "i", "j", "k", "node", "root", "words", "sketches")

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        node = rows["node"].to_pylist()
        lists = [np.frombuffer(w, np.uint32) for w in rows["words"].to_pylist()]
        side = None if i == j else rows["k"].to_numpy() == j
        sketches = pc.list_flatten(rows["sketches"]).to_numpy().reshape(len(lists), -1)
        pairs = found_within(lists, rows["root"].to_pylist(), side, threshold, sketches)
        return pa.table({"a": pa.array([node[x] for x, _ in pairs], pa.binary()), "b": pa.array([node[y] for _, y in pairs], pa.binary())})

    return held.groupBy("group", "i", "j").applyInArrow(run, "a binary, b binary")


def links(rows: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """(node, root) of the nodes that are similar to another one. rows: described() docs."""
    nodes = rows.filter("node IS NOT NULL").select("node", F.col("n_words").alias("size"), "sketches").dropDuplicates(["node"])
    may = lambda a, b: F.abs(a - b) <= F.floor((1 - threshold) * F.greatest(a, b) + 1e-9)

    def contents(ids: DataFrame) -> DataFrame:
        texts = word_lists(docs, text).join(ids, F.col("node") == F.col("x"), "left_semi").dropDuplicates(["node"])
        return scratch.table(texts, "words")

    return components.linked(nodes, contents, lambda pairs, texts: aligned(pairs, texts, threshold), may, within=lambda members, texts: joining(members, texts, threshold))


def classes(rows: DataFrame, roots: DataFrame, rank: str) -> DataFrame:
    """(node, root, first, size): for each node its class, the smallest `rank` of the class's rows, and how many they are."""
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    nodes = scratch.table(nodes.join(roots, "node", "left"), "classes")
    whole = nodes.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("__first"), F.sum("n").alias("__size"))
    whole = components.sent(scratch.table(whole, "whole"))
    return nodes.join(whole, "root", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("__first", "first").alias("first"), F.coalesce("__size", "n").alias("size"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, sketches: int = SKETCHES, picked: int = PICKED, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: doc_id, n_words, class_id (the smallest id of its class), class_size, is_representative.

    A row whose text is null or has no word is a class of its own, with its own id. Ids that are null count as smaller
    than others; repeated rows are members of one class, each with its own row; no rows give no rows. Other columns are
    not looked at.
    """
    keyed = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("__text"))
    rows = scratch.table(described(keyed, "__text", ["doc_id"], k, sketches, picked), "described")
    found = classes(rows, links(rows, keyed, "__text", threshold), "doc_id")
    out = rows.select("doc_id", "n_words", "node").join(found, "node", "left")
    lone = F.col("root").isNull()
    class_id = F.when(lone, F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", "n_words", class_id.alias("class_id"), F.coalesce("size", F.lit(1).cast("long")).alias("class_size"), class_id.eqNullSafe(F.col("doc_id")).alias("is_representative"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, sketches: int = SKETCHES, picked: int = PICKED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one of each class: that of the smallest id, of equal ids the one of smallest hash.

    Equal rows are one. Rows without a word all stay, equal ones once.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    hashed = [F.xxhash64(F.lit(i), *[F.col(f"`{c}`") for c in plain]).alias(f"__row{i}") for i in (1, 2)]
    keyed = docs.select("*", *hashed)
    rows = keyed.select(F.col(id).alias("doc_id"), "__row1", "__row2", F.col(text).alias("__text"))
    rows = scratch.table(described(rows, "__text", ["doc_id", "__row1", "__row2"], k, sketches, picked), "described")
    rank = rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row1", "__row2"))
    stay = classes(rank, links(rows, docs, text, threshold), "rank").select("first.__row1", "first.__row2")
    stay = stay.unionByName(rows.filter("node IS NULL").select("__row1", "__row2")).dropDuplicates()
    return keyed.join(stay, ["__row1", "__row2"]).dropDuplicates(["__row1", "__row2"]).select(*[F.col(f"`{c}`") for c in docs.columns])
