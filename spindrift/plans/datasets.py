"""Queries of the dataset operators: sources, actions, projections, filters, joins, grouping, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import tokens
from spindrift.operators import store
from spindrift.operators.dataset import Dataset, PairDataset, merge_by_key
from spindrift.operators.index import consolidate
from spindrift.plans.sqltext import SQL_PAGES, sql_tokens
from spindrift.runtime import checkpoint_dir
from spindrift.sources.tables import pages, table


def _texts(spark: SparkSession, base: str) -> Dataset:
    return Dataset(pages(spark, base, "page").select(F.col("id").alias("key"), F.col("page").alias("value")))


def _events(spark: SparkSession, base: str, column: str) -> Dataset:
    return Dataset(table(spark, base, "events").select(F.col("event_id").alias("key"), F.col(column).alias("value")))


def _users(spark: SparkSession, base: str, kind: str) -> Dataset:
    return Dataset(table(spark, base, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("key"), F.col("user_id").alias("value")))


def _pairs(spark: SparkSession, base: str, name: str, key: str, col: str, value: str) -> PairDataset:
    return PairDataset(table(spark, base, name).select(F.col(key).alias("key"), F.col(col).alias("col"), F.col(value).alias("value")))


def _words(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "index_final", "word").where("word IS NOT NULL").distinct()


def parallelize_values(spark, base):
    return Dataset.parallelize(spark, ["pear", "apple", "apple", ""]).df


def from_table_rows(spark, base):
    return Dataset.from_table(table(spark, base, "nation"), F.col("n_nationkey"), F.col("n_name")).df


def from_table_null_drop(spark, base):
    return Dataset.from_table(table(spark, base, "crawl"), F.col("id"), F.col("contenttype")).df


def broadcast_dictionary(spark, base):
    each = pages(spark, base, "page").select("id", F.explode(tokens("page")).alias("w"))
    return Dataset.from_table_within(each, F.col("id"), F.col("w"), _words(spark, base)).df.groupBy("key").agg(F.count("*").alias("n"))


def count_elements(spark, base):
    return spark.createDataFrame([(_events(spark, base, "event_type").count(),)], "n bigint")


def take_ordered(spark, base):
    return Dataset(table(spark, base, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("key"), F.col("c_name").alias("value"))).taken(10)


def collect_pairs(spark, base):
    return _pairs(spark, base, "orders", "o_custkey", "o_orderkey", "o_orderpriority").pairs()


def fold_sum(spark, base):
    return Dataset(table(spark, base, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("value"))).fold(F.round(F.sum(F.col("value").cast("double")), 4), "total")


def fold_max(spark, base):
    return Dataset(table(spark, base, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value"))).fold(F.max(F.col("value").cast("double")), "most")


def fold_concat_ordered(spark, base):
    names = Dataset.from_table(table(spark, base, "nation"), F.col("n_nationkey"), F.col("n_name"))
    return names.fold_ordered("", lambda acc, x: F.concat(acc, F.when(acc == "", "").otherwise(","), x), "names")


def flat_map_tokens(spark, base):
    return _texts(spark, base).flat_map(tokens).df.groupBy("value").agg(F.count("*").alias("n"))


def flat_map_to_pair(spark, base):
    found = _texts(spark, base).flat_map_to_pair(lambda v: F.transform(tokens(v), lambda w: F.struct(w.alias("k"), F.length(w).cast("string").alias("v"))))
    return found.df.groupBy("key", "value").agg(F.count("*").alias("n"))


def map_to_pair(spark, base):
    return _events(spark, base, "props").map_to_pair(lambda v: F.get_json_object(v, "$.k"), lambda v: v).pairs()


def pair_flat_map(spark, base):
    both = _pairs(spark, base, "events", "user_id", "event_id", "event_type")
    return both.flat_map(lambda k, v: F.array(k, v)).df.groupBy("value").agg(F.count("*").alias("n"))


def pair_flat_map_to_pair(spark, base):
    both = _pairs(spark, base, "events", "user_id", "event_id", "event_type")
    turned = both.flat_map_to_pair(lambda k, v: F.array(F.struct(v.alias("k"), k.alias("v")), F.struct(F.lit("").alias("k"), v.alias("v"))))
    return turned.df.groupBy("key", "value").agg(F.count("*").alias("n"))


def map_partitions(spark, base):
    def shout(values):
        for v in values:
            yield v.upper() + "!"

    return Dataset(table(spark, base, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))).map_partitions(shout).df.select("value")


def filter_pred(spark, base):
    items = Dataset(table(spark, base, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_quantity").alias("value")))
    return items.filter(lambda v: v.cast("double") >= 45).df.select("key", F.col("value").cast("double").alias("value"))


def sample_fraction(spark, base):
    return _events(spark, base, "event_type").sample(0.1, seed=7).df


def distinct_values(spark, base):
    return _events(spark, base, "event_type").distinct().df


def union_values(spark, base):
    return _users(spark, base, "purchase").union(_users(spark, base, "signup")).df.select("value")


def subtract_values(spark, base):
    """Parts that were never returned in large lots."""
    parts = Dataset(table(spark, base, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias("value")))
    returned = table(spark, base, "lineitem", "l_partkey", "l_returnflag", "l_quantity").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49))
    return parts.subtract(Dataset(returned.select(F.col("l_partkey").alias("key"), F.col("l_partkey").cast("string").alias("value")))).distinct().df.select("value")


def intersection_users(spark, base):
    return _users(spark, base, "purchase").intersection(_users(spark, base, "signup")).df.select("value")


def group_by_list(spark, base):
    return Dataset.from_table(table(spark, base, "nation"), F.col("n_nationkey"), F.col("n_name")).group_by(lambda v: F.substring(v, 1, 1))


def group_by_pairs(spark, base):
    return Dataset.from_table(table(spark, base, "supplier"), F.col("s_suppkey"), F.col("s_name")).group_pairs(lambda v: F.substring(v, -1, 1)).pairs()


def fold_by_key_sum(spark, base):
    return _pairs(spark, base, "orders", "o_custkey", "o_orderkey", "o_totalprice").fold_by_key(F.round(F.lit(100) + F.sum(F.col("value").cast("double")), 2), "total")


def fold_by_key_concat(spark, base):
    both = _pairs(spark, base, "nation", "n_regionkey", "n_nationkey", "n_name")
    return both.fold_by_key_ordered(">", lambda acc, x: F.concat(acc, x, F.lit(";")))


def pair_join(spark, base):
    left = _pairs(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return left.join(_pairs(spark, base, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")).pairs()


def pair_cogroup(spark, base):
    return _pairs(spark, base, "customer", "c_nationkey", "c_custkey", "c_name").cogroup(_pairs(spark, base, "supplier", "s_nationkey", "s_suppkey", "s_name"))


def pair_rows(spark, base):
    kept = _pairs(spark, base, "nation", "n_regionkey", "n_nationkey", "n_name").rows()
    return kept.select("key", F.to_json("cells").alias("cells"))


def _customers_and_orders(spark, base):
    return table(spark, base, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "k"), table(spark, base, "orders", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "k")


def exists_semi(spark, base):
    return store.exists(*_customers_and_orders(spark, base), "k")


def not_exists_anti(spark, base):
    """Customers without an urgent order that is pending."""
    urgent = table(spark, base, "orders").where("o_orderstatus = 'P' AND o_orderpriority LIKE '1-%'").select(F.col("o_custkey").alias("k"))
    return store.exists(_customers_and_orders(spark, base)[0], urgent, "k", there=False)


def lookup_default(spark, base):
    ranks = table(spark, base, "pageranks").groupBy("id").agg(F.max("rank").alias("rank"))
    return store.enrich(pages(spark, base).select("id"), ranks, "id", "rank", -1.0)


def merge_by_key_words(spark, base):
    index = table(spark, base, "index_final", "word", "value").where("word IS NOT NULL AND value IS NOT NULL")
    known = table(spark, base, "content", "url").select(F.regexp_extract("url", r"/([a-z]+)$", 1).alias("word")).distinct()
    halves = [index.where(F.length("word") % 2 == i) for i in (0, 1)]
    return merge_by_key(halves, "word", "value", known)


def consolidate_words(spark, base):
    return consolidate(table(spark, base, "index_final", "word", "value").where("word IS NOT NULL"))


def save_and_reload(spark, base):
    at = f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}/region"
    Dataset.from_table(table(spark, base, "region"), F.col("r_regionkey"), F.col("r_name")).save(at)
    return spark.read.parquet(at)


QUERIES = {f.__name__: f for f in (
    parallelize_values, from_table_rows, from_table_null_drop, broadcast_dictionary, count_elements, take_ordered, collect_pairs,
    fold_sum, fold_max, fold_concat_ordered, flat_map_tokens, flat_map_to_pair, map_to_pair, pair_flat_map, pair_flat_map_to_pair,
    map_partitions, filter_pred, sample_fraction, distinct_values, union_values, subtract_values, intersection_users, group_by_list,
    group_by_pairs, fold_by_key_sum, fold_by_key_concat, pair_join, pair_cogroup, pair_rows, exists_semi, not_exists_anti,
    lookup_default, merge_by_key_words, consolidate_words, save_and_reload,
)}

_TOKENS = f"(SELECT id, unnest({sql_tokens('page')}) AS w FROM {SQL_PAGES} WHERE page IS NOT NULL)"
_USERS = "SELECT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = '{}'"
SQL = {
    "parallelize_values": "SELECT * FROM (VALUES ('0', 'pear'), ('1', 'apple'), ('2', 'apple'), ('3', '')) t(key, value)",
    "from_table_rows": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation",
    "from_table_null_drop": "SELECT id AS key, contenttype AS value FROM crawl WHERE contenttype IS NOT NULL",
    "broadcast_dictionary": f"SELECT id AS key, count(*) AS n FROM {_TOKENS} WHERE w IN (SELECT trim(lower(word)) FROM index_final WHERE word <> '') GROUP BY id",
    "count_elements": "SELECT count(*) AS n FROM events WHERE event_type IS NOT NULL",
    "take_ordered": "SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS key, c_name AS value FROM customer ORDER BY key LIMIT 10",
    "collect_pairs": "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders",
    "fold_sum": "SELECT round(sum(l_quantity), 4) AS total FROM lineitem",
    "fold_max": "SELECT max(l_extendedprice) AS most FROM lineitem",
    "fold_concat_ordered": "SELECT string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation",
    "flat_map_tokens": f"SELECT w AS value, count(*) AS n FROM {_TOKENS} GROUP BY w",
    "flat_map_to_pair": f"SELECT w AS key, CAST(length(w) AS VARCHAR) AS value, count(*) AS n FROM {_TOKENS} WHERE w <> '' GROUP BY w",
    "map_to_pair": "SELECT json_extract_string(props, '$.k') AS key, props AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "pair_flat_map": "SELECT value, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_type FROM events) GROUP BY value",
    "pair_flat_map_to_pair": "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY ALL",
    "map_partitions": "SELECT upper(o_orderpriority) || '!' AS value FROM orders",
    "filter_pred": "SELECT l_orderkey || '-' || l_linenumber AS key, l_quantity AS value FROM lineitem WHERE l_quantity >= 45",
    "distinct_values": "SELECT DISTINCT event_type AS key, event_type AS value FROM events WHERE event_type IS NOT NULL",
    "union_values": f"{_USERS.format('purchase')} UNION ALL {_USERS.format('signup')}",
    "subtract_values": "SELECT CAST(p_partkey AS VARCHAR) AS value FROM part EXCEPT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49",
    "sample_fraction": f"SELECT key, value FROM (SELECT event_id AS key, event_type AS value FROM events) WHERE CAST('0x' || substr(md5('7|' || key || '|' || value), 1, 8) AS BIGINT) < {int(0.1 * 2**32)}",
    "intersection_users": f"{_USERS.format('purchase')} INTERSECT {_USERS.format('signup')}",
    "group_by_list": "SELECT n_name[1] AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1",
    "group_by_pairs": "SELECT right(s_name, 1) AS key, s_name AS value FROM supplier",
    "fold_by_key_sum": "SELECT CAST(o_custkey AS VARCHAR) AS key, round(100 + sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "fold_by_key_concat": "SELECT CAST(n_regionkey AS VARCHAR) AS key, '>' || string_agg(n_name || ';', '' ORDER BY n_name) AS value FROM nation GROUP BY 1",
    "pair_join": "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority || ',' || l_returnflag AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "pair_cogroup": """SELECT CAST(coalesce(c.k, s.k) AS VARCHAR) AS key, '[' || coalesce(c.v, '') || '],[' || coalesce(s.v, '') || ']' AS value
        FROM (SELECT c_nationkey AS k, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer GROUP BY 1) c
        FULL JOIN (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_name) AS v FROM supplier GROUP BY 1) s ON c.k = s.k""",
    "pair_rows": """SELECT CAST(n_regionkey AS VARCHAR) AS key, '{' || string_agg('"' || n_nationkey || '":"' || n_name || '"', ',' ORDER BY CAST(n_nationkey AS VARCHAR)) || '}' AS cells FROM nation GROUP BY 1""",
    "exists_semi": "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "not_exists_anti": "SELECT c_custkey AS k, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority LIKE '1-%')",
    "lookup_default": f"SELECT p.id, coalesce(r.rank, -1.0) AS rank FROM {SQL_PAGES} p LEFT JOIN (SELECT id, max(rank) AS rank FROM pageranks GROUP BY id) r USING (id)",
    "merge_by_key_words": "SELECT word, string_agg(value, ',' ORDER BY value) AS value FROM index_final WHERE word IN (SELECT regexp_extract(url, '/([a-z]+)$', 1) FROM content) AND value IS NOT NULL GROUP BY word",
    "consolidate_words": "SELECT word, coalesce(string_agg(value, ',' ORDER BY value), '') AS value FROM index_final WHERE word IS NOT NULL GROUP BY word",
    "save_and_reload": "SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS value FROM region",
}
