"""A versioned row store as DataFrames: an append log of cells or rows, and its latest-wins views.

A cell log is ``(key, col, value, seq)``; writing appends, the current cell is the one of greatest ``seq``. Row logs
replace a row wholesale, see :func:`spindrift.sources.tables.current`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.tables import current


def current_cells(log: DataFrame) -> DataFrame:
    """``key, col, value``: the latest value of each cell, combined before the shuffle; null keys are left out."""
    latest = log.where("key IS NOT NULL").groupBy("key", "col").agg(F.max(F.struct("seq", "value")).alias("m"))
    return latest.select("key", "col", F.col("m.value").alias("value"))


def current_rows(log: DataFrame) -> DataFrame:
    """``key, cells``: the current cells of each row as a map."""
    return current_cells(log).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cells"))


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with cells appended behind its greatest ``seq``, in the order of the rows' own ``seq``."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    shifted = rows.withColumn("seq", F.col("seq") + last + 1)
    return log.unionByName(shifted.select(*log.columns))


def raw(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every version in append order, of all keys or those with ``start <= key < end``."""
    log = log if start is None else log.where(F.col("key") >= start)
    return (log if end is None else log.where(F.col("key") < end)).orderBy("seq")


def get_row(table: DataFrame, key: str, name: str = "key") -> DataFrame:
    """The row of a key, or no row."""
    return table.where(F.col(name) == F.lit(key))


def get_cell(table: DataFrame, key: str, column: str, name: str = "key") -> DataFrame:
    """One cell of a row, or no row."""
    return get_row(table, key, name).select(F.col(column).alias("value"))


def exists(left: DataFrame, right: DataFrame, key: str, there: bool = True) -> DataFrame:
    """Rows of ``left`` whose key ``right`` has, or has not."""
    return left.join(right.select(key), key, "left_semi" if there else "left_anti")


def enrich(left: DataFrame, right: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """``left`` with ``column`` of the row of ``right`` with the same key, or a default."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def scan(table: DataFrame, start: object = None, end: object = None, key: str = "key") -> DataFrame:
    """Rows with ``start <= key < end`` in key order; an open end is None. ``start > end`` is an error."""
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")
    for bound, keep in ((start, lambda k, b: k >= b), (end, lambda k, b: k < b)):
        if bound is not None:
            table = table.where(keep(F.col(key), F.lit(bound)))
    return table.orderBy(key)


def page(table: DataFrame, start: object = None, size: int = 10, key: str = "key") -> DataFrame:
    """The first rows from ``start`` in key order."""
    return scan(table, start, key=key).limit(size)


def owner(key: Column, workers: list[str]) -> Column:
    """Which of the range owners, sorted, holds a key: the last whose name isn't greater; the last for lesser keys."""
    names = sorted(workers)
    out = F.lit(names[-1])
    for name in names:
        out = F.when(key >= F.lit(name), F.lit(name)).otherwise(out)
    return out


def compact(log: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Write only the current rows of a row log to a new place, and read them from there."""
    current(log, key).write.mode("errorifexists").parquet(path)
    return log.sparkSession.read.parquet(path)


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a table's folder; a missing source or an existing target is an error."""
    source, fs = _path(spark, old)
    target, _ = _path(spark, new)
    if not fs.exists(source):
        raise FileNotFoundError(old)
    if fs.exists(target):
        raise FileExistsError(new)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {old}")


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a table's folder; false if there was none."""
    target, fs = _path(spark, path)
    return bool(fs.delete(target, True)) if fs.exists(target) else False


def tables(spark: SparkSession, base: str) -> list[str]:
    """Names of the tables below a folder."""
    folder, fs = _path(spark, base)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
