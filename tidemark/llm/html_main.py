"""Main text of HTML pages: gradient-boosted trees over features of DOM nodes, and a decoding that follows the tree.

Two models give each element the odds that it is a part of the main text and that it holds the main text among other
things. Features: the tag, what the tokens of its attributes and of its ancestors' said in training, depth, size and
density of text, tags and links in its subtree, place in the page, and how it stands among its siblings. Decoding
gives each element one of three states: around (above the main text), in, or out. Below `around` all three may follow,
below `in` only in and out, below `out` only out, so that no node contradicts its ancestors. The best states of a
whole page are found bottom-up. The models are fitted here on pages that dom.made_page() makes, a bounded number.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.llm import dom, gbt

PAGES, SEED = 600, 11
TAGS = "article main section div p h1 h2 h3 li ul ol nav header footer aside form a span table td tr blockquote figure pre body button label b".split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
LINK = frozenset({"a", "button"})


def node_sums(page: dom.Page) -> np.ndarray:
    """For each node, of its subtree: characters, words, characters in links, elements, links, blocks of text, marks."""
    n = len(page.nodes)
    own = np.zeros((n, 7))
    in_link = [False] * n
    for i, node in enumerate(page.nodes):
        in_link[i] = node.tag in LINK or i > 0 and in_link[node.parent]
        own[i, 3] = 1
        own[i, 4] = node.tag in LINK
    for i, text in page.texts:
        if not text or text.isspace():
            continue
        t = text.strip()
        own[i, 0] += len(t)
        own[i, 1] += t.count(" ") + 1
        own[i, 2] += len(t) if in_link[i] else 0
        own[i, 5] += 1
        own[i, 6] += t.count(".") + t.count(",") + t.count("!")
    total = np.zeros((n + 1, 7))
    np.cumsum(own, 0, out=total[1:])
    ends = np.array([x.end for x in page.nodes])
    return total[ends] - total[:n]


def features(page: dom.Page, odds: dict[str, float]) -> np.ndarray:
    nodes, n = page.nodes, len(page.nodes)
    sums = node_sums(page)
    parent = np.array([max(x.parent, 0) for x in nodes])
    chars, words, linked, tags, links, texts, marks = sums.T
    low, high, above = np.zeros(n), np.zeros(n), np.zeros(n)
    special = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 4, "article": 5, "main": 6, "p": 7, "li": 8}
    inside = np.zeros((n, len(special)))
    place, count, same, text_before = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        if node.tokens:
            known = [odds.get(t, 0.0) for t in node.tokens]
            low[i], high[i] = min(known), max(known)
        if i:
            above[i] = min(above[node.parent], low[node.parent])
            inside[i] = inside[node.parent]
        if node.tag in special:
            inside[i, special[node.tag]] = 1
        if node.children:
            per: dict[str, int] = defaultdict(int)
            for c in node.children:
                per[nodes[c].tag] += 1
            before = 0.0
            for k, c in enumerate(node.children):
                place[c], count[c], same[c], text_before[c] = k, len(node.children), per[nodes[c].tag], before
                before += chars[c]
    tag = np.zeros((n, len(TAGS)))
    for i, node in enumerate(nodes):
        if (k := TAG_NUMBER.get(node.tag)) is not None:
            tag[i, k] = 1
    all_chars = max(chars[0], 1)
    start = np.zeros(n)
    seen = 0.0
    own = np.zeros(n)
    for i, text in page.texts:
        own[i] += len(text.strip()) if text else 0
    seen = np.cumsum(own) - own  # in the order of nodes, which is that of the page but for text after children
    start = seen / all_chars
    up = np.maximum(chars[parent], 1)
    siblings = np.maximum(count - 1, 1)
    depth = np.array([x.depth for x in nodes], float)
    cols = [low, high, above, depth, np.log1p(chars), np.log1p(words), linked / np.maximum(chars, 1), np.log1p(tags), chars / np.maximum(tags, 1), links / np.maximum(tags, 1), texts / np.maximum(tags, 1),
            marks / np.maximum(words, 1), chars / np.maximum(texts, 1), chars / all_chars, chars / up, start, place, np.log1p(count), same / np.maximum(count, 1), text_before / up,
            (up - chars) / siblings, linked[parent] / up, np.log1p(chars[parent]), own / np.maximum(chars, 1)]
    return np.column_stack([*cols, inside, inside[parent], tag, tag[parent][:, :16]])


def token_odds(pages: list[tuple[dom.Page, np.ndarray]], least: int = 6) -> dict[str, float]:
    """For each attribute token, the log-odds that text below it is main text."""
    yes, no = defaultdict(float), defaultdict(float)
    for page, share in pages:
        for node, s in zip(page.nodes, share, strict=True):
            for t in set(node.tokens):
                yes[t] += s
                no[t] += 1 - s
    return {t: float(np.log((yes[t] + 0.5) / (no[t] + 0.5))) for t in {*yes, *no} if yes[t] + no[t] >= least}


def blocks(page: dom.Page, keep: np.ndarray | None = None) -> list[str]:
    out, now = [], []
    for i, text in page.texts:
        if text is None:
            if joined := " ".join("".join(now).split()):
                out.append(joined)
            now = []
        elif keep is None or keep[i]:
            now.append(text)
    if joined := " ".join("".join(now).split()):
        out.append(joined)
    return out


def labelled(seed: int, pages: int) -> Iterator[tuple[dom.Page, np.ndarray]]:
    """Made pages, with the share of main text of each node; -1 for a node without text."""
    rng = random.Random(seed)
    for _ in range(pages):
        source, main = dom.made_page(rng)
        page = dom.parse(source)
        left: dict[str, int] = defaultdict(int)
        for m in main:
            left[" ".join(m.split())] += 1
        own, good = np.zeros(len(page.nodes)), np.zeros(len(page.nodes))
        run: list[tuple[int, str]] = []
        for i, text in [*page.texts, (0, None)]:
            if text is not None:
                run.append((i, text))
                continue
            joined = " ".join("".join(t for _, t in run).split())
            is_main = left[joined] > 0
            left[joined] -= is_main
            for k, t in run:
                own[k] += len(t.strip())
                good[k] += len(t.strip()) * is_main
            run = []
        ends = np.array([x.end for x in page.nodes])
        cum = lambda v: (lambda c: c[ends] - c[:-1])(np.concatenate([[0], np.cumsum(v)]))
        total = cum(own)
        yield page, np.where(total > 0, cum(good) / np.maximum(total, 1), -1)


@dataclass
class Model:
    odds: dict[str, float]
    inside: gbt.Trees
    around: gbt.Trees


@lru_cache(2)
def fitted(pages: int = PAGES, seed: int = SEED) -> Model:
    """The models, fitted on `pages` made pages; at most a minute's share of the driver, whatever the input is."""
    data = list(labelled(seed, pages))
    odds = token_odds([(p, s) for p, s in data])
    x = np.concatenate([features(p, odds) for p, _ in data])
    share = np.concatenate([s for _, s in data])
    x, share = x[share >= 0], share[share >= 0]
    whole, mixed = share > 0.97, (share > 0.03) & (share <= 0.97)
    return Model(odds, gbt.fit(x[~mixed], whole[~mixed].astype(float)), gbt.fit(x, mixed.astype(float)))


def decode(page: dom.Page, inside: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each node, whether text directly below it is kept. inside, around: logits of every node."""
    n = len(page.nodes)
    soft = lambda z: -np.logaddexp(0, -z)
    chars = np.zeros(n)
    for i, t in page.texts:
        chars[i] += len(t.strip()) if t else 0
    weight = 1 + np.log1p(chars)
    yes, no, amid = weight * soft(inside), weight * soft(-inside), soft(around) - 0.5 * weight * (chars > 0) * np.maximum(inside, 0)
    best = np.zeros((n, 3))  # around, in, out
    below = np.zeros((n, 3))
    for i in range(n - 1, -1, -1):
        best[i] = (amid[i] + below[i, 0], yes[i] + below[i, 1], no[i] + below[i, 2])
        p = page.nodes[i].parent
        if p >= 0:
            below[p] += (best[i].max(), max(best[i, 1], best[i, 2]), best[i, 2])
    state = np.zeros(n, np.int64)
    allowed = {0: (0, 1, 2), 1: (1, 2), 2: (2,)}
    for i, node in enumerate(page.nodes):
        options = allowed[state[node.parent]] if i else (0, 1, 2) if chars[0] else (0,)
        state[i] = max(options, key=lambda s: (best[i, s], s == 1))
    return state == 1


def main_blocks(pages: list[dom.Page], model: Model) -> list[list[str]]:
    if not pages:
        return []
    x = [features(p, model.odds) for p in pages]
    cuts = np.cumsum([len(v) for v in x])[:-1]
    every = np.concatenate(x)
    inside, around = np.split(model.inside.logit(every), cuts), np.split(model.around.logit(every), cuts)
    return [blocks(p, decode(p, a, b)) for p, a, b in zip(pages, inside, around, strict=True)]


def extract(pages: DataFrame, html: str = "html", model: Model | None = None, at_once: int = 64) -> DataFrame:
    """pages without html, with main_text (empty if none) and n_blocks.

    A null or empty html, or one without main text, gives an empty text. Texts are whole; blocks are joined by \\n; white space in
    a block is one space. Repeated rows each get their text; columns named main_text or n_blocks are replaced.
    """
    shipping.ensure(pages.sparkSession)
    model = model or fitted()
    kept = [c for c in pages.columns if c not in (html, "main_text", "n_blocks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index("__html"))
            texts, counts = [], []
            for first in range(0, len(source), at_once):
                parsed = [dom.parse(s or "") for s in source.slice(first, at_once).to_pylist()]
                for b in main_blocks(parsed, model):
                    texts.append("\n".join(b))
                    counts.append(len(b))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(counts, pa.int64())], [*kept, "main_text", "n_blocks"])

    from pyspark.sql import types as T

    fields = [T.StructField(f.name, f.dataType, True) for f in pages.schema if f.name in kept]
    schema = T.StructType([*fields, T.StructField("main_text", T.StringType()), T.StructField("n_blocks", T.LongType())])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).cast("string").alias("__html")).mapInArrow(run, schema)
