"""The master panel: the chain of left joins as one lazy plan, and the serving plan that scores, bands, ranks and documents an origin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import metrics as M
from tidemark.operators import peers as E
from tidemark.operators import publish as P
from tidemark.semantics import average_rank_share

KEYS = ["store_id", "origin"]


def master(panel: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], label: str = "event_12m", verify: bool = False) -> DataFrame:
    """panel with every step's columns.

    Steps are lazy and run as one plan; one fingerprint before and after the whole chain shows whether a row, a key or a label changed. With
    verify, each step has its own, at the price of running the chain again for each.
    """
    now = panel
    for name, step in steps.items():
        new = step(now)
        if verify:
            try:
                C.require_same(now, new, KEYS, label)
            except C.ContractError as e:
                raise C.ContractError(f"{name}: {e}") from e
        now = new
    return now


def serve(scored: DataFrame, factors: DataFrame, cut_mid: Column, cut_high: Column, peer: list[str], show: float = 0.02) -> DataFrame:
    """One row for each store: band, place among peers, and its factors as JSON, largest first."""
    out = scored.withColumn("band", M.band("p", cut_mid, cut_high)).withColumn("peer_pct", average_rank_share("p", peer))
    marked = factors.withColumn("direction", P.direction("contribution")).withColumn("display", F.abs("contribution") >= show)
    documents = P.factor_documents(marked, ["store_id"], "factor", "contribution", ["direction", "display"])
    return out.join(documents, "store_id", "left")


def explained(rows: DataFrame, background: DataFrame, groups: dict[str, list[str]], score: Callable[[dict[str, Column]], Column]) -> DataFrame:
    return E.shapley(rows, background, groups, score, "store_id")
