"""Ranks and running totals over keys of any size, without one task per key.

A window over a hot key, or over a whole table, runs in a single task. Here rows are range-partitioned by key and order,
so that a hot key spans many tasks; each task numbers its own rows and a small table of partition totals gives the
offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.runtime import cut, shuffle_partitions


def running_total(df: DataFrame, order: list[Column], groups: list[str] = (), weight: Column | None = None, name: str = "total") -> DataFrame:
    """Add ``name``: the sum of ``weight`` (1 by default) over the rows of the same group up to and including this one.

    ``order`` must be total within a group for the result to be the same on each run. A null weight counts 0; null group
    keys are a group of their own. The range-partitioned rows are checkpointed, since another evaluation could draw
    other bounds. Offsets are one row per (partition, group): without groups they are at most the shuffle width and
    are broadcast.
    """
    groups = list(groups)
    n = shuffle_partitions(df.sparkSession)
    ranged = df.withColumn("__w", F.coalesce(weight if weight is not None else F.lit(1), F.lit(0)))
    ranged = cut(ranged.repartitionByRange(n, *groups, *order).withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy("__pid", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("__run", F.sum("__w").over(local))
    before = Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__pid", *groups).agg(F.sum("__w").alias("__sum"))
    offsets = sums.select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    on = F.col("__pid") == F.col("__p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = counted.join(F.broadcast(offsets) if not groups else offsets, on, "left")
    return joined.withColumn(name, F.col("__run") + F.coalesce("__off", F.lit(0))).drop("__w", "__pid", "__run", "__p", "__off", *[f"__g{i}" for i in range(len(groups))])


def previous(df: DataFrame, value: str, order: list[Column], groups: list[str], name: str = "previous") -> DataFrame:
    """Add ``name``: ``value`` of the row before this one in its group, null for a group's first row.

    As :func:`running_total`, for groups of any size: each task looks back among its own rows, and the first row of a
    group in a task takes the last value that an earlier task has of that group, from a table of a row per task and
    group. ``order`` must be total within a group.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *groups, *order).withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy("__pid", *groups).orderBy(*order)
    looked = ranged.withColumn("__at", F.row_number().over(local)).withColumn("__before", F.lag(value).over(local))
    ends = looked.groupBy("__pid", *groups).agg(F.max_by(F.struct(F.col(value).alias("v")), "__at").alias("__end"))
    carried = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy(*groups).orderBy("__pid")))
    right = carried.select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__carry.v").alias("__carry"))
    on = F.col("__pid") == F.col("__p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = looked.join(right, on, "left")
    return joined.withColumn(name, F.when(F.col("__at") == 1, F.col("__carry")).otherwise(F.col("__before"))).drop("__pid", "__at", "__before", "__p", "__carry", *[f"__g{i}" for i in range(len(groups))])


def lookup(df: DataFrame, values: DataFrame, keys: list[str], weight: str, share: float = 0.001) -> DataFrame:
    """Inner join of ``df`` with one row per ``keys`` in ``values``, safe when few keys own most rows.

    ``weight`` counts each key's rows in ``df``. Keys above ``share`` of all rows are at most ``1 / share``, so their
    part is broadcast and their rows stay where they are; all others join by shuffle. Null keys find nothing.
    """
    marked = values.withColumn("__hot", F.col(weight) > values.agg(F.sum(weight)).scalar() * share)
    rest = [c for c in values.columns if c not in keys]
    hot = marked.where("__hot").select(*keys, F.struct(*rest).alias("__found"))
    cold = marked.where("NOT __hot").select(*keys, F.struct(*rest).alias("__found"))
    left = df.join(F.broadcast(hot), keys, "left")
    on_hot, on_cold = left.where(F.col("__found").isNotNull()), left.where(F.col("__found").isNull()).drop("__found").join(cold, keys)
    return on_hot.unionByName(on_cold).select("*", "__found.*").drop("__found")
