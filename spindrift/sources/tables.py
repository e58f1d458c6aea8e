"""Readers of the engine's tables and the two views of an append log.

A table directory holds one Parquet file or folder per table. Readers take only the columns a plan needs, so that the
scan's ReadSchema stays narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` under ``base``, narrowed to ``columns`` when any are given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def current(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The row of greatest ``seq`` for each ``key``: the latest-wins view of an append log.

    Rows with a null key are no versions of anything and are left out; a null ``seq`` is older than any number. A
    delivery repeated under one ``seq`` counts once; should two different rows share the greatest ``seq``, the choice is
    fixed by the order of their other columns. The rank limit runs before the shuffle as well, so that a key that owns
    much of the log sends one row per task. An empty log gives an empty view.
    """
    rest = [c for c in log.columns if c not in (key, seq)]
    w = Window.partitionBy(key).orderBy(F.col(seq).desc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in rest])
    return log.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def pages(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """Pages: each distinct ``id`` of ``content`` with its current row."""
    wanted = list(dict.fromkeys(["id", "seq", *columns]))
    return current(table(spark, base, "content", *wanted)).drop(*[c for c in ("seq",) if c not in columns])
