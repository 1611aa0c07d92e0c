"""License scan: ordered signature rules over words, gated by keywords, with suppression of contained detections.

Rules (license_rules.py) are regexes over a text's words joined by one space, in order of priority: an SPDX tag says more than
the text of a license or a grant, these more than a bare name, a name more than a notice. A rule is tried only on texts that have one of
its keywords, words of which every match has one; texts without any keyword are never joined or matched. A detection whose span of words lies inside that of a rule of higher priority, or of a longer
one of the same priority, is dropped. Base phrases are counted beside the rules and are never dropped.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import license_rules, words

#: Phrase and label of each base detection.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def detect(joined: str, present: frozenset) -> list[tuple[int, int, str, float]]:
    """(first word, end, label, weight) of the detections that are left in words joined by one space."""
    found: dict[int, set[tuple[int, int, str, float]]] = {}
    spaces: list[int] = []
    for rule in license_rules.rules():
        if not rule.gate & present:
            continue
        if not spaces:
            spaces = [m.start() for m in re.finditer(" ", joined)]
        for m in rule.pattern.finditer(joined):
            first = bisect.bisect_left(spaces, m.start())
            found.setdefault(rule.priority, set()).add((first, -bisect.bisect_left(spaces, m.end()) - 1, rule.label, -rule.weight))
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []  # of what higher priorities found, and the largest end of those that start there or before
    reach: list[int] = []
    for priority in sorted(found):
        last, own = 0, sorted(found[priority])
        for a, b, label, weight in own:
            k = bisect.bisect_right(starts, a)
            if -b <= last or k and -b <= reach[k - 1]:  # inside a longer one, or one of higher priority
                continue
            last = -b
            kept.append((a, -b, label, -weight))
        spans = sorted([*zip(starts, reach, strict=True), *((a, -b) for a, b, _, _ in own)])
        starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return sorted(kept)


def _keywords() -> list[str]:
    return sorted({w for r in license_rules.rules() for w in r.gate})


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, base (start, label of every base phrase), found (start, end, label, weight).

    A null or empty text has no words and no detections; repeated rows each get their result; other columns are not
    looked at; no rows give no rows.
    """
    shipping.ensure(docs.sparkSession)
    base = [(words.hash_words([w.encode() for w in p.split()]), p.encode(), label) for p, label in BASE.items()]
    keywords = _keywords()
    key_hashes = words.hash_words([w.encode() for w in keywords])
    order = np.argsort(key_hashes)
    sorted_hashes, name = key_hashes[order], [keywords[i] for i in order]
    top = np.zeros(1 << 16, bool)
    top[(sorted_hashes >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
        for batch in batches:
            counts, hits, found = [], [], []
            for g in words.word_groups(batch.column(1)):
                rows = g.last - g.first
                own: list[list] = [[] for _ in range(rows)]
                for hashes, phrase, label in base:
                    n = len(hashes)
                    at = np.flatnonzero(g.hashes == hashes[0])
                    at = at[at + n <= len(g.hashes)]
                    for k in range(1, n):
                        at = at[g.hashes[at + k] == hashes[k]]
                    row = np.searchsorted(g.at, at, "right") - 1
                    for r, w in zip(row.tolist(), at.tolist(), strict=True):
                        if w + n <= g.at[r + 1] and g.phrase(w, n) == phrase:
                            own[r].append({"start": w - int(g.at[r]), "label": label})
                may = np.flatnonzero(top[(g.hashes >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(sorted_hashes, g.hashes[may]), len(sorted_hashes) - 1)
                is_key = sorted_hashes[at] == g.hashes[may]
                present: list[set] = [set() for _ in range(rows)]
                for r, k in zip((np.searchsorted(g.at, may[is_key], "right") - 1).tolist(), at[is_key].tolist(), strict=True):
                    present[r].add(name[k])
                for r in range(rows):
                    hit = detect(g.text(r).decode("utf-8", "replace"), frozenset(present[r])) if present[r] else []
                    found.append([{"start": a, "end": b, "label": x, "weight": w} for a, b, x, w in hit])
                hits += [sorted(x, key=lambda y: (y["start"], y["label"])) for x in own]
                counts.append(np.diff(g.at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(hits, places), pa.array(found, spans)], ["doc_id", "n_words", "base", "found"]
            )

    schema = f"doc_id {dict(docs.dtypes)[id]}, n_words long, base array<struct<start:long,label:string>>, found array<struct<start:long,end:long,label:string,weight:double>>"
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest weight, 0 to 1) and n_found."""
    base = F.col("base.label")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    score = F.greatest(F.coalesce(F.array_max("found.weight"), F.lit(0.0)), F.when(F.size("base") > 0, 0.7).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("found.label"))).alias("labels"), score.alias("score"), F.size("found").cast("long").alias("n_found"),
    )
