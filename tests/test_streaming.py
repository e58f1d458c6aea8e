import pytest
from pyspark.sql import functions as F

from spindrift.streaming import log

SCHEMA = "id string, page string, seq long, at timestamp"


def put(spark, path, rows):
    spark.createDataFrame(rows, "id string, page string, seq long, s long").select("id", "page", "seq", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(path)


def test_upsert(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    with pytest.raises(FileNotFoundError):
        log.read_upserted(spark, target)
    put(spark, source, [("a", "1", 1, 0), ("b", "1", 2, 0)])
    log.upsert(log.read_log(spark, source, SCHEMA), target, state).awaitTermination()
    put(spark, source, [("a", "2", 5, 10), ("a", "0", 0, 11), (None, "x", 9, 12)])
    log.upsert(log.read_log(spark, source, SCHEMA), target, state).awaitTermination()
    assert {r.id: r.page for r in log.read_upserted(spark, target).collect()} == {"a": "2", "b": "1"}


def test_latest_deliveries_and_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, [("a", "1", 1, 7200), ("a", "1", 1, 7200), ("a", "2", 2, 7205), ("b", "1", 3, 11000)])
    stream = log.read_log(spark, source, SCHEMA)
    for name, df, mode in (("t_latest", log.latest(stream), "complete"), ("t_once", log.once_per_delivery(stream, ["id", "seq"], "at"), "append"), ("t_hosts", log.fetches_per_host(stream, "id", "at"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.id: r.page for r in spark.table("t_latest").collect()} == {"a": "2", "b": "1"}
    assert spark.table("t_once").count() == 3
    assert {(r.host, r.n) for r in spark.table("t_hosts").collect()} == {("a", 3), ("b", 1)}
