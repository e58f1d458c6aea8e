"""Capping what one contributor may add to a set, keeping its best records.

The limit is a water level over the sorted contributor counts: contributors above it are cut down to it, which lowers
the total that shares are taken of, which lowers the level, until the level and the shares agree. At any level only
``1 / share`` contributors can stand above it, so only those counts are looked at on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import running_total
from spindrift.runtime import cut


def water_level(top: list[int], total: int, share: float, of: str = "input", most: int | None = None, contributors: int | None = None) -> int:
    """The greatest level ``L`` with ``L <= ceil(share * T(L))``, and at most ``most``.

    ``top`` holds the greatest counts, at least ``ceil(1 / share) + 1`` of them if there are so many. ``T`` is what shares
    are taken of: ``total`` for ``of="input"``, what is left at that level for ``of="output"``. The level falls from the
    whole total until it agrees with the share of what it leaves. No contributor vanishes. With ``contributors`` given,
    output shares that so few of them can't meet (fewer than ``1 / share``) are an error, since any level would then
    exceed its share again until one record of each is left.
    """
    if of not in ("input", "output") or not 0 < share <= 1:
        raise ValueError("of is input or output, share in (0, 1]")
    if of == "output" and contributors is not None and total and share * contributors < 1:
        raise ValueError(f"{contributors} contributors can't each have at most {share} of what is left")
    top = sorted(top, reverse=True)
    level = total
    while True:
        left = total - sum(c - level for c in top if c > level) if of == "output" else total
        # Rounding first keeps 0.03 * 600 at 18, which floats make 18.000000000000004.
        allowed = max(1, math.ceil(round(share * left, 9)))
        if allowed >= level:
            break
        level = allowed
    return min(level, most) if most else level


def _split(df: DataFrame, contributor: str, order: list[Column], share: float, of: str, most: int | None, strict: bool) -> tuple[DataFrame, DataFrame, int]:
    """Rows of contributors up to the level, rows of those above it with their ``__place``, and the level."""
    df = cut(df)  # counted, then read again
    counts = df.where(F.col(contributor).isNotNull()).groupBy(contributor).agg(F.count("*").alias("__n"))
    bound = math.ceil(1 / share) + 1
    top = counts.orderBy(F.desc("__n"), contributor).limit(bound).collect()
    # Fewer contributors than that are all in ``top``; records of nobody make any share feasible.
    few = len(top) if strict and len(top) < bound and df.where(F.col(contributor).isNull()).isEmpty() else None
    level = water_level([r["__n"] for r in top], df.count(), share, of, most, few)
    if most:  # a maximum count may stop more contributors than a share can
        loud = counts.where(F.col("__n") > level).select(contributor)
    else:
        names = [r[contributor] for r in top if r["__n"] > level]
        loud = df.sparkSession.createDataFrame([(x,) for x in names], f"`{contributor}` {df.schema[contributor].dataType.simpleString()}")
        loud = F.broadcast(loud)  # at most 1 / share rows
    placed = running_total(df.join(loud, contributor, "left_semi"), order, [contributor], name="__place")
    return df.join(loud, contributor, "left_anti"), placed, level


def over_share(df: DataFrame, contributor: str, order: list[Column], share: float, of: str = "input", most: int | None = None, strict: bool = True) -> DataFrame:
    """The rows of ``df`` that a contributor may not keep: all after its first ``L`` in ``order``.

    ``order`` puts the best first; rows that tie in all of it are cut in any order, as many as needed. Rows with a null
    contributor belong to nobody and are never cut; repeated rows count each. Counting is combined before the shuffle;
    only rows of the at most ``1 / share`` contributors above the level move, range-partitioned, so that one contributor
    with a third of all rows spans many tasks. All columns are kept. An empty frame gives an empty frame. Output shares
    that the contributors are too few for are an error, or (not ``strict``) leave one row of each.
    """
    _, placed, level = _split(df, contributor, order, share, of, most, strict)
    return placed.where(F.col("__place") > level).select(*[f"`{c}`" for c in df.columns])


def cap_contributors(df: DataFrame, contributor: str, order: list[Column], share: float, of: str = "input", most: int | None = None, strict: bool = True) -> DataFrame:
    """``df`` without the rows of :func:`over_share`."""
    quiet, placed, level = _split(df, contributor, order, share, of, most, strict)
    kept = placed.where(F.col("__place") <= level)
    return quiet.unionByName(kept.drop("__place")).select(*[f"`{c}`" for c in df.columns])
