"""Session helpers: checkpoint folder, partition counts and lineage cuts.

Every iterative operator cuts its lineage through :func:`cut`, a reliable ``checkpoint()`` in the shared folder that the
cluster names in ``spark.checkpoint.dir``. A folder of our own is set only where that setting is missing, as in tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, set on the context if nothing has set it yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and forget how it came about."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width; explicit repartitions follow it so that it scales with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def once(value: Column) -> Column:
    """``value`` behind a barrier: later filters and projections use the result and don't repeat the expression.

    Predicate pushdown and project collapsing copy deterministic expressions, into lambdas too, where a copy would be
    evaluated per element. The partition number is never negative, so the value is unchanged.
    """
    return F.when(F.spark_partition_id() >= 0, value)
