"""Streams of the append log: keeping the latest version of each key, dropping repeated deliveries, host throttling.

All run on Structured Streaming with their state in the checkpoint of the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_per_delivery(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Rows whose ``keys`` weren't seen within the watermark; a repeated delivery counts once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The row of greatest ``seq`` per key so far, for update or complete mode."""
    rest = [c for c in stream.columns if c not in (key, seq)]
    newest = stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("__m"))
    return newest.select(key, "__m.*")


def fetches_per_host(stream: DataFrame, host: str, at: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``host, start, n``: fetches of each host by tumbling window, final once the watermark has passed."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(host).alias("host")).agg(F.count("*").alias("n"))
    return counts.select("host", F.col("w.start").alias("start"), "n")


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "id", seq: str = "seq"):
    """Keep the folder ``target`` at the latest rows: each batch is folded with the last generation into a new one.

    A generation is a subfolder named after its batch, so that a batch that is run again writes the same place and a
    reader never sees half of one; :func:`read_upserted` reads the newest. Returns the writer's started query.
    """
    from spindrift.sources.tables import current

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _generation(spark, target, below=number)
        whole = batch if before is None else batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        current(whole, key, seq).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generation(spark: SparkSession, target: str, below: int | None = None) -> str | None:
    from spindrift.operators.store import tables

    done = [t for t in tables(spark, target) if t.startswith("batch=") and (below is None or int(t[6:]) < below)]
    complete = [t for t in done if "_SUCCESS" in tables(spark, f"{target}/{t}")]
    return f"{target}/{complete[-1]}" if complete else None


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """The newest complete generation; an error if there is none."""
    newest = _generation(spark, target)
    if newest is None:
        raise FileNotFoundError(target)
    return spark.read.parquet(newest)
