"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 code points, words padded by one space),
counted over training rows. A text gets its own list; the distance to a profile sums, over the text's n-grams, how far
each is from its place in the profile, or the profile's length if it isn't there. The nearest profile names the language.

Profiles are fitted on at most about `per_lang` rows of each language, chosen by a hash of the text; that bound is
the only one. Texts are counted whole; predictions are one map over the rows and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import words

TOP, PER_LANG = 400, 2000
_BITS = 21
_PIECE = 1 << 22


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@dataclass
class Stream:
    """Letters of rows; 0 stands before, after and between words, once each. row: of each letter.

    The first and the last place only show what stands beside the others: n-grams are counted where they are centred between them,
    pairs where they begin there or, in a stream that begins its row, at the first place.
    """

    letters: np.ndarray
    row: np.ndarray
    begins: bool = True

    def inner(self) -> np.ndarray:
        """The letters that are counted."""
        is_letter = self.letters != 0
        is_letter[:1] = is_letter[-1:] = False
        return is_letter


def stream(data: np.ndarray, bounds: np.ndarray) -> Stream:
    """bounds: where each row begins in data (UTF-8), and the end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(heads[bounds]))
    out = np.zeros(len(points) + rows + 1, np.int32)
    of = np.zeros(len(out), np.int32)
    at = np.arange(len(points)) + row + 1
    out[at], of[at] = _letters()[points], row
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return Stream(out[keep], of[keep])


def streams(column: pa.Array) -> Iterator[tuple[int, int, Iterator[Stream]]]:
    """(first row, last row, streams) of groups of rows. A very long row comes in pieces, each of which begins with the last two places
    of the one before, so that every n-gram is counted once, wherever the cuts are."""
    offsets, data = words.strings(column)
    for first, last in words.row_groups(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi - lo <= _PIECE:
            yield first, last, iter([stream(data[lo:hi], offsets[first : last + 1] - lo)])
        else:
            yield first, last, _pieces(data[lo:hi])


def _pieces(data: np.ndarray) -> Iterator[Stream]:
    held, begins, at = np.zeros(1, np.int32), True, 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # inside a character
            end += 1
        points = np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = end
        letters = np.concatenate([held, _letters()[points], np.zeros(int(at == len(data)), np.int32)])
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
        held = letters[keep]
        if len(held) > 2 or at == len(data):
            yield Stream(held, np.zeros(len(held), np.int32), begins)
            held, begins = held[-2:], False


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, n-gram as 21 bits for each code point + 1 or the space, count)"""
    total: dict[str, list] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, _, parts in streams(batch.column(1)):
            for s in parts:
                x = s.letters.astype(np.int64) + 1  # the space is 1, nothing is 0
                y, z = np.append(x[1:], 1), np.append(x[2:], [1, 1])
                of = np.array([langs.index(v) for v in langs])[first + s.row] if len(s.row) else s.row
                letter = s.inner()
                nearest = np.where(s.letters != 0, of, np.append(of[1:], 0))
                own = slice(0 if s.begins else 1, -1)
                grams = [(x[letter], of[letter]), ((x << _BITS | y)[own], nearest[own])]
                inner = np.append(letter[1:], False)
                grams.append(((x << 2 * _BITS | y << _BITS | z)[inner], np.append(of[1:], 0)[inner]))
                for g, o in grams:
                    for k in np.unique(o):
                        total.setdefault(langs[k], []).append(_counted(g[o == k]))
        for lang, found in total.items():
            if len(found) > 1:
                total[lang] = [_summed(found)]
    for lang, found in total.items():
        g, c = _summed(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], ["lang", "gram", "c"])


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)


@dataclass
class Profiles:
    """langs, sorted; grams: (n-gram as in _learn, rank in each language, `top` where it isn't in the profile)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int

    def __post_init__(self) -> None:
        chars = np.unique(np.concatenate([(self.grams >> s) & ((1 << _BITS) - 1) for s in (0, _BITS, 2 * _BITS)])) - 1
        self.alphabet = chars[chars > 0].astype(np.int64)
        self.base = len(self.alphabet) + 2  # 0: space, last: any other letter
        code = np.zeros(len(self.grams), np.int64)
        number = lambda part: np.where(part == 1, 0, np.searchsorted(self.alphabet, part - 1) + 1)
        parts = [(self.grams >> s) & ((1 << _BITS) - 1) for s in (2 * _BITS, _BITS, 0)]
        size = sum((p > 0).astype(int) for p in parts)
        for p in parts:
            code = np.where(p > 0, code * self.base + number(p), code)
        code += np.where(size >= 2, self.base, 0) + np.where(size == 3, self.base**2, 0)
        order = np.argsort(code)
        self.codes, self.ranks = code[order], self.ranks[order]
        self.space = self.base + self.base**2 + self.base**3

    @property
    def numbers(self) -> np.ndarray:
        """For each code point, its number in the alphabet."""
        table = np.full(0x110000, self.base - 1, np.int64)
        table[0] = 0
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table

    def counts(self, s: Stream, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row * space + code, count) of the n-grams of a stream."""
        x = numbers[s.letters]
        letter, row = s.inner(), s.row.astype(np.int64) * self.space
        two = x[:-1] * self.base + x[1:]
        of_two = np.where(s.letters[:-1] != 0, row[:-1], row[1:])
        three, inner, own = two[:-1] * self.base + x[2:], letter[1:-1], slice(0 if s.begins else 1, None)
        return _counted(np.concatenate([(row + x)[letter], (of_two + two + self.base)[own], (row[1:-1] + three + self.base + self.base**2)[inner]]))

    def distances(self, keys: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance of each row to each language, n-grams compared in each row)."""
        row, code = keys // self.space, keys % self.space
        order = np.lexsort((code, -counts, row))
        row, code = row[order], code[order]
        if not len(self.langs) or not len(row):
            return np.zeros((rows, len(self.langs))), np.bincount(row, minlength=rows)
        head = np.searchsorted(row, np.arange(rows))
        rank = np.arange(len(row)) - head[row]
        row, code, rank = row[rank < self.top], code[rank < self.top], rank[rank < self.top]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        there = np.where(known[:, None], self.ranks[at], self.top)
        apart = np.where(there < self.top, np.abs(there - rank[:, None]), self.top)
        out = np.zeros((rows, len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(row, apart[:, k], minlength=rows)
        return out, np.bincount(row, minlength=rows)


def fit(train: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, per_lang: int = PER_LANG, id: str | None = None) -> Profiles:
    """Profiles of every non-null language of train, from about per_lang of its rows (all, if it has fewer).

    Rows are drawn by a hash of text and id, so that copies of a text are drawn one by one; without an id, by the text's alone.
    """
    shipping.ensure(train.sparkSession)
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text, *[id] * bool(id)).alias("draw")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), top)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    chosen = rows.filter(F.pmod("draw", F.lit(1 << 32)) < F.try_element_at(share, F.col("lang")) * float(1 << 32))
    counts = chosen.select("lang", "text").mapInArrow(_learn, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("c"), "gram")) - 1
    best = counts.withColumn("rank", rank).filter(F.col("rank") < top).collect()  # top rows for each language at most
    langs = sorted({r["lang"] for r in best})
    grams = np.array(sorted({r["gram"] for r in best}), np.int64)
    ranks = np.full((len(grams), len(langs)), top, np.int64)
    for r in best:
        ranks[np.searchsorted(grams, r["gram"]), langs.index(r["lang"])] = r["rank"]
    return Profiles(langs, grams, ranks, top)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and margin; columns of docs of these names are replaced.

    score is 1 at no distance and 0 if no n-gram is in the nearest profile; margin is how much farther the second nearest
    is, as a share of its distance. A null text, one without a letter, and any text where there is no profile: und, 0, 0.
    Of equally near languages, the first by name is taken.
    """
    shipping.ensure(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin")]
    fields = [f for f in docs.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = profiles.numbers
        for batch in batches:
            lang, score, margin = [], [], []
            for first, last, parts in streams(batch.column(batch.schema.get_field_index("__text"))):
                counted = [profiles.counts(s, numbers) for s in parts]
                keys, counts = counted[0] if len(counted) == 1 else _summed(counted)
                d, n = profiles.distances(keys, counts, last - first)
                for row, size in zip(d, n.tolist(), strict=True):
                    if not size or not profiles.langs:
                        lang.append("und"), score.append(0.0), margin.append(0.0)
                        continue
                    k = int(np.argmin(row))
                    rest = np.delete(row, k).min() if len(row) > 1 else size * profiles.top
                    lang.append(profiles.langs[k]), score.append(1 - row[k] / (size * profiles.top)), margin.append((rest - row[k]) / rest if rest else 0.0)
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], [*kept, "lang_pred", "score", "margin"])

    from pyspark.sql import types as T

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def held_out(id: str = "doc_id"):
    return F.crc32(F.col(id).cast("string")) % 4 == 2


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """predict() over docs, fitted on those of them that aren't held out. A null id is in neither part's training."""
    profiles = fit(docs.filter(F.coalesce(~held_out(id), F.lit(False))), lang, text, id=id, **options)
    return predict(docs, profiles, text)


def in_known_language(docs: DataFrame, least: float, id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of docs, with all their columns as they are, that are in a language learned from them: not und, score `least` or more."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score", "margin")}
    found = identify(docs.withColumnsRenamed(own), id, text, lang, **options).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
