"""Queries of the versioned row store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import store
from spindrift.plans.sqltext import SQL_PAGES
from spindrift.runtime import checkpoint_dir, cut, shuffle_partitions
from spindrift.sources import rowlog
from spindrift.sources.tables import current, table


def _place(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _log(spark: SparkSession, base: str) -> DataFrame:
    """Events as a cell log: a user's row, a column per kind of event, the event's number as ``seq``."""
    return table(spark, base, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("col"), F.col("props").alias("value"), F.col("event_id").alias("seq"))


def _customers(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "customer", "c_name", "c_nationkey", "c_mktsegment").withColumnRenamed("c_name", "key")


def log_current_cells(spark, base):
    return store.current_cells(_log(spark, base))


def log_current_rows(spark, base):
    return store.current_rows(_log(spark, base)).select("key", F.size("cells").alias("n"), F.col("cells")["purchase"].alias("purchase"))


def log_raw(spark, base):
    return store.raw(_log(spark, base))


def log_raw_range(spark, base):
    return store.raw(_log(spark, base), "2", "5")


def log_put(spark, base):
    new = table(spark, base, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit("click").alias("col"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"))
    return store.current_cells(store.put(_log(spark, base), new))


def log_counts(spark, base):
    """Versions and live rows of each log table."""
    logs = [table(spark, base, t, "id", "seq").withColumn("t", F.lit(t)) for t in ("content", "crawl", "outdegrees")]
    whole = logs[0].unionByName(logs[1]).unionByName(logs[2])
    return whole.groupBy("t").agg(F.count("*").alias("versions"), F.countDistinct("id").alias("live"))


def current_content(spark, base):
    return current(table(spark, base, "content")).select("id", "url", "wordcount", "seq", F.length("page").alias("n_chars"))


def current_crawl(spark, base):
    return current(table(spark, base, "crawl", "id", "url", "responsecode", "seq"))


def compact_content(spark, base):
    return store.compact(table(spark, base, "content", "id", "url", "seq"), _place(spark, "compact"), "id")


def rename_and_delete(spark, base):
    old, new = _place(spark, "old"), _place(spark, "new")
    table(spark, base, "region").write.parquet(old)
    store.rename(spark, old, new)
    moved = cut(spark.read.parquet(new))
    store.delete(spark, new)
    return moved


def get_row(spark, base):
    return store.get_row(_customers(spark, base), "Customer#000000042")


def get_cell(spark, base):
    return store.get_cell(_customers(spark, base), "Customer#000000042", "c_mktsegment")


def range_scan(spark, base):
    return store.scan(_customers(spark, base), "Customer#000000100", "Customer#000000900")


def table_page(spark, base):
    return store.page(_customers(spark, base), "Customer#000000100")


def key_range_owner(spark, base):
    workers = ["dddd", "kkkk", "pppp", "wwww"]
    return table(spark, base, "crawl", "id").where("id IS NOT NULL").distinct().select(store.owner(F.col("id"), workers).alias("owner")).groupBy("owner").agg(F.count("*").alias("n"))


def table_names(spark, base):
    names = [n.removesuffix(".parquet") for n in store.tables(spark, base) if n.endswith(".parquet")]
    return spark.createDataFrame([(n,) for n in names], "name string")


def row_log_events(spark, base):
    """All events as a row log, a row for each event, a file for each task; versions of a key stay in their order."""
    at = _place(spark, "events")
    rows = _log(spark, base).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("seq")
    rowlog.write(rows.select("key", F.create_map("col", "value").alias("cells")), at)
    read = rowlog.read(spark, f"{at}/part-*")
    placed = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return read.select("key", "col", F.col("value").cast("string").alias("value"), placed.alias("n"))


def row_log_round_trip(spark, base):
    at = _place(spark, "log")
    rows = table(spark, base, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("cells"))
    rowlog.write(rows, at)
    return rowlog.read(spark, f"{at}/part-*").select("key", "col", F.col("value").cast("string").alias("value"))


QUERIES = {f.__name__: f for f in (
    log_current_cells, log_current_rows, log_raw, log_raw_range, table_names, row_log_events, log_put, log_counts, current_content, current_crawl, compact_content,
    rename_and_delete, get_row, get_cell, range_scan, table_page, key_range_owner, row_log_round_trip,
)}

_LOG = "(SELECT CAST(user_id AS VARCHAR) AS key, event_type AS col, props AS value, event_id AS seq FROM events)"
_CUSTOMERS = "SELECT c_name AS key, c_nationkey, c_mktsegment FROM customer"
_CURRENT = "FROM {0} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1"
SQL = {
    "log_current_cells": f"SELECT key, col, arg_max(value, seq) AS value FROM {_LOG} GROUP BY key, col",
    "log_current_rows": f"SELECT key, CAST(count(*) AS INTEGER) AS n, max(v) FILTER (col = 'purchase') AS purchase FROM (SELECT key, col, arg_max(value, seq) AS v FROM {_LOG} GROUP BY key, col) GROUP BY key",
    "log_raw": f"SELECT * FROM {_LOG}",
    "log_raw_range": f"SELECT * FROM {_LOG} WHERE key >= '2' AND key < '5'",
    "table_names": "SELECT unnest(['content', 'crawl', 'customer', 'documents', 'embeddings', 'events', 'hosts', 'index_final', 'lineitem', 'nation', 'orders', 'outdegrees', 'pageranks', 'part', 'reading_labels', 'region', 'supplier']) AS name",
    "row_log_events": f"SELECT key, col, value, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {_LOG}",
    "log_put": f"SELECT key, col, arg_max(value, seq) AS value FROM (SELECT * FROM {_LOG} UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'click', c_name, 1000000000 + c_custkey FROM customer) GROUP BY key, col",
    "log_counts": " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS versions, count(DISTINCT id) AS live FROM {t}" for t in ("content", "crawl", "outdegrees")),
    "current_content": f"SELECT id, url, wordcount, seq, CAST(length(page) AS INTEGER) AS n_chars FROM {SQL_PAGES}",
    "current_crawl": f"SELECT id, url, responsecode, seq {_CURRENT.format('crawl')}",
    "compact_content": f"SELECT id, url, seq {_CURRENT.format('content')}",
    "rename_and_delete": "SELECT * FROM region",
    "get_row": f"{_CUSTOMERS} WHERE c_name = 'Customer#000000042'",
    "get_cell": "SELECT c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042'",
    "range_scan": f"{_CUSTOMERS} WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'",
    "table_page": f"{_CUSTOMERS} WHERE c_name >= 'Customer#000000100' ORDER BY c_name LIMIT 10",
    "key_range_owner": "SELECT CASE WHEN id < 'dddd' OR id >= 'wwww' THEN 'wwww' WHEN id < 'kkkk' THEN 'dddd' WHEN id < 'pppp' THEN 'kkkk' ELSE 'pppp' END AS owner, count(DISTINCT id) AS n FROM crawl WHERE id IS NOT NULL GROUP BY 1",
    "row_log_round_trip": "SELECT CAST(n_nationkey AS VARCHAR) AS key, 'name' AS col, n_name AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR) FROM nation",
}
