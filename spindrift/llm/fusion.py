"""One order from several scores on different scales: reciprocal rank fusion.

Each score ranks the items on its own, ties sharing the best place; an item's total is the sum of ``1 / (k + rank)``.
Ranks come from counts per distinct score value and a distributed running total, never from a window over all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import lookup, running_total
from spindrift.runtime import cut

#: The constant of the original method; it damps the lead of the first places.
K = 60


def score_ranks(df: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """``key, score, rank``: for each score 1 plus the number of rows with a greater value.

    ``score`` is the place of the name in ``scores``. Null scores rank last, NaN as null. All scores are ranked in one
    pass: rows are counted per distinct value first, so that only values are sorted, whatever share of rows ties.
    """
    clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    each = F.array(*[F.coalesce(clean(c), F.lit(float("-inf"))) for c in scores])
    own = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), each.alias("each"))
    narrow = cut(own).select("key", F.posexplode("each").alias("score", "__v"))  # read three times
    sizes = narrow.groupBy("score", "__v").agg(F.count("*").alias("__n"))
    places = running_total(sizes, [F.col("__v").desc()], ["score"], weight=F.col("__n"), name="__upto")
    ranks = places.select("score", "__v", "__n", (F.col("__upto") - F.col("__n") + 1).alias("rank"))
    return lookup(narrow, ranks, ["score", "__v"], "__n").select("key", "score", "rank")


def fuse(df: DataFrame, key: str, scores: list[str], k: int = K) -> DataFrame:
    """``key`` (under its own name), ``rrf`` and ``place`` of every key of ``df``; greater scores are better.

    ``key`` should be unique: the parts of a repeated one add up. Rows with a null key are left out. A null score ranks
    behind all others of its kind, so that an item without it is still ordered by the rest. Equal scores share the best
    rank, equal totals are ordered by ``key``. The parts are added as integers of 1e-12, so that the order of addition
    cannot change a total. Extra columns are left out. An empty frame gives an empty frame.
    """
    part = F.round(F.lit(1e12) / (k + F.col("rank"))).cast("long")
    total = score_ranks(df, key, scores).groupBy("key").agg(F.sum(part).alias("__rrf"))
    placed = running_total(total, [F.col("__rrf").desc(), F.col("key").asc()], name="place")
    return placed.select(F.col("key").alias(key), (F.col("__rrf") / 1e12).alias("rrf"), F.col("place").cast("long"))
