"""Queries over packed fields, and the SQL text that unpacks them with plain string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.packed import unpack_urls
from spindrift.sources.tables import table


def unpacked(spark: SparkSession, base: str, name: str, column: str) -> DataFrame:
    """``src, seq, pos, item`` for each value of ``column``; a delivery repeated under one ``seq`` counts once."""
    log = table(spark, base, name, "seq", column).dropDuplicates()
    return unpack_urls(log, column).select(F.lit(name).alias("src"), "seq", "pos", "item")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return unpacked(spark, base, "outdegrees", "links").unionByName(unpacked(spark, base, "index_final", "value"))


def sql_values(relation: str, column: str, carried: str) -> str:
    """DuckDB text: ``carried, pos, item`` of the values packed in ``column`` of ``relation``, by quote parity."""
    edge = r"[\s,;|\[\]]"
    # The mark that quotes in this row, or a character that no text holds.
    q = rf"""CASE WHEN regexp_matches({column}, '(^|{edge})"https?://', 'i') THEN '"' WHEN regexp_matches({column}, '(^|{edge})''https?://', 'i') THEN '''' ELSE chr(1) END"""
    outside = rf"regexp_replace(regexp_replace(regexp_replace(x, '^{edge}+', chr(2)), '{edge}+$', chr(2)), '{edge}+(https?://)', chr(2) || '\1', 'gi')"
    return f"""
    SELECT {carried}, CAST(generate_subscripts(vals, 1) - 1 AS INTEGER) AS pos, unnest(vals) AS item FROM (
      SELECT {carried}, list_filter(list_transform(string_split(array_to_string(list_transform(pieces, lambda x, i:
          CASE WHEN i % 2 = 0 THEN x WHEN x = '' AND i > 1 AND i < len(pieces) THEN q ELSE {outside} END), ''), chr(2)), lambda v: trim(v)), lambda v: v <> '') AS vals
      FROM (SELECT {carried}, q, string_split({column}, q) AS pieces FROM (SELECT *, {q} AS q FROM {relation} WHERE {column} IS NOT NULL)))"""


QUERIES = {"p1_found": p1_found}
SQL = {
    "p1_found": f"""
    SELECT 'outdegrees' AS src, seq, pos, item FROM ({sql_values("(SELECT DISTINCT seq, links FROM outdegrees)", "links", "seq")})
    UNION ALL SELECT 'index_final' AS src, seq, pos, item FROM ({sql_values("(SELECT DISTINCT seq, value FROM index_final)", "value", "seq")})""",
}
