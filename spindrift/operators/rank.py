"""Iterative rank of pages over their links.

A page's new rank is 0.15 plus 0.85 times the ranks of the pages that link to it, each divided by its number of links.
All links count in that number, also those to unknown pages, but only known pages have a rank. Pages without links keep
receiving rank and pass none on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut

DAMPING = 0.85


def initial(nodes: DataFrame) -> DataFrame:
    """``id, curr, prev``: every known page with rank 1."""
    return nodes.select("id").where("id IS NOT NULL").distinct().select("id", F.lit(1.0).alias("curr"), F.lit(1.0).alias("prev"))


def weighted(edges: DataFrame) -> DataFrame:
    """``src, dst, w``: distinct links, each with its part of what its page passes on."""
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    degree = links.groupBy("src").agg((F.lit(DAMPING) / F.count("*")).alias("w"))
    return links.join(degree, "src")


def step(state: DataFrame, links: DataFrame) -> DataFrame:
    """One round; shares are summed before they are shuffled, so that a page with very many links in is no hot key."""
    given = links.join(state.select(F.col("id").alias("src"), "curr"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("curr") * F.col("w")).alias("__in"))
    merged = state.join(given, "id", "left")
    return merged.select("id", (F.lit(1 - DAMPING) + F.coalesce("__in", F.lit(0.0))).alias("curr"), F.col("curr").alias("prev"))


def diffs(state: DataFrame) -> DataFrame:
    """``id, diff``: how far the last round moved each rank."""
    return state.select("id", F.abs(F.col("curr") - F.col("prev")).alias("diff"))


def converged(state: DataFrame, threshold: float, percent: float | None = None) -> bool:
    """Whether the greatest move is below ``threshold``; with ``percent``, whether so many pages moved at most that far."""
    moved = diffs(state)
    if percent is None:
        most = moved.agg(F.max("diff")).first()[0]
        return most is None or most < threshold
    r = moved.agg(F.count("*").alias("n"), F.count_if(F.col("diff") <= threshold).alias("still")).first()
    return r["still"] >= math.floor(r["n"] * percent / 100 + 0.5)


def page_rank(nodes: DataFrame, edges: DataFrame, threshold: float | None = 0.01, percent: float | None = None, rounds: int = 100) -> DataFrame:
    """``id, curr, prev`` after convergence, or after exactly ``rounds`` if ``threshold`` is None.

    Lineage is cut each round; only the verdict of the test reaches the driver. An empty graph is done at once; ranks that
    still move after ``rounds`` are an error.
    """
    links = cut(weighted(edges))
    state = cut(initial(nodes))
    for _ in range(rounds):
        state = cut(step(state, links))
        if threshold is not None and converged(state, threshold, percent):
            break
    else:
        if threshold is not None:
            raise RuntimeError("ranks still move")
    return state
