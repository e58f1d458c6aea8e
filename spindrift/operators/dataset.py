"""Lazy datasets of strings and of pairs, thin over DataFrames.

A :class:`Dataset` is ``(key, value)``: each element has a key of its own. A :class:`PairDataset` is ``(key, col,
value)``: several values may share a key, told apart by ``col``. Functions are Column expressions, so that they stay in
Catalyst; :meth:`Dataset.map_partitions` takes arbitrary code over Arrow batches. Nothing runs before an action.
Order in joined texts is always explicit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _fresh_key(*parts: Column | str) -> Column:
    return F.sha1(F.concat_ws("\x1f", *parts))


def _joined(value: str = "value") -> Column:
    return F.concat_ws(",", F.array_sort(F.collect_list(value)))


class Dataset:
    """Strings with keys; rows without a value are not elements."""

    def __init__(self, df: DataFrame):
        self.df = df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).where("value IS NOT NULL")

    # sources
    @classmethod
    def parallelize(cls, spark: SparkSession, values: Iterable[str]) -> Dataset:
        """Elements of a driver-side list, keyed by their index."""
        return cls(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "key string, value string"))

    @classmethod
    def from_table(cls, df: DataFrame, key: Column, value: Column) -> Dataset:
        """One element per row, keyed as the row; null values drop the row."""
        return cls(df.select(key.alias("key"), value.alias("value")))

    @classmethod
    def from_table_within(cls, df: DataFrame, key: Column, value: Column, words: DataFrame, word: str = "word", most: int = 1_000_000) -> Dataset:
        """:meth:`from_table` of the elements that a dictionary holds; it is broadcast only up to ``most`` words."""
        known = words.select(F.trim(F.lower(F.col(word))).alias("value")).where("value <> ''").distinct()
        known = F.broadcast(known) if known.count() <= most else known
        return cls(df.select(key.alias("key"), value.alias("value")).join(known, "value", "left_semi"))

    # actions
    def count(self) -> int:
        return self.df.count()

    def collect(self) -> list[str]:
        return [r["value"] for r in self.df.orderBy("key", "value").collect()]

    def take(self, n: int) -> list[str]:
        return [r["value"] for r in self.taken(n).collect()]

    def taken(self, n: int) -> DataFrame:
        """The first ``n`` elements in key order."""
        return self.df.orderBy("key", "value").limit(max(n, 0))

    def fold(self, aggregate: Column, name: str = "value") -> DataFrame:
        """An algebraic fold as one aggregate: partial per task, then merged. An empty dataset gives the zero or null."""
        return self.df.agg(aggregate.alias(name))

    def fold_ordered(self, zero: str, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
        """A fold that isn't algebraic, over all values in order in one task; for datasets that fit into one."""
        return self.df.agg(F.aggregate(F.array_sort(F.collect_list("value")), F.lit(zero), step).alias(name))

    def save(self, path: str, overwrite: bool = False) -> None:
        """Write the elements; an existing target is an error unless ``overwrite``."""
        self.df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

    def view(self, name: str) -> str:
        """Name the dataset for SQL in this session."""
        self.df.createOrReplaceTempView(name)
        return name

    # transformations
    def flat_map(self, fn: Fn) -> Dataset:
        """``fn`` gives an array of strings per element; duplicates are kept, null and empty arrays give nothing."""
        each = self.df.select("key", F.posexplode(fn(F.col("value"))).alias("__i", "value"))
        return Dataset(each.select(_fresh_key("key", F.col("__i").cast("string")).alias("key"), "value"))

    def flat_map_to_pair(self, fn: Fn) -> PairDataset:
        """``fn`` gives an array of ``struct<k, v>``; pairs with an empty or null key are dropped."""
        each = self.df.select("key", F.posexplode(fn(F.col("value"))).alias("__i", "__p")).where("__p.k <> ''")
        return PairDataset(each.select(F.col("__p.k").alias("key"), F.concat("key", "__i").alias("col"), F.col("__p.v").alias("value")))

    def map_to_pair(self, key: Fn, value: Fn) -> PairDataset:
        """At most one pair per element; a null key drops it, an empty one doesn't."""
        v = F.col("value")
        return PairDataset(self.df.select(key(v).alias("k"), F.col("key").alias("col"), value(v).alias("v")).where("k IS NOT NULL").select(F.col("k").alias("key"), "col", F.col("v").alias("value")))

    def map_partitions(self, fn: Callable[[Iterable], Iterable]) -> Dataset:
        """``fn`` takes and gives iterators of strings, batch-wise through Arrow; keys are the new values' hashes."""

        def run(batches):
            import pyarrow as pa

            values = (v for b in batches for v in b.column(0).to_pylist())
            chunk: list[str] = []
            for out in fn(values):
                chunk.append(out)
                if len(chunk) == 4096:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(chunk, pa.string())})
                    chunk = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(chunk, pa.string())})

        out = self.df.select("value").mapInArrow(run, "value string")
        return Dataset(out.select(_fresh_key("value").alias("key"), "value"))

    def filter(self, predicate: Fn) -> Dataset:
        return Dataset(self.df.where(predicate(F.col("value"))))

    def sample(self, fraction: float, seed: int | None = None) -> Dataset:
        """Each element stays with probability ``fraction``.

        With a seed the choice follows from the seed, the key and the value alone, however the rows are laid out; elements
        of equal key and value then stay or go together. Without one every row is drawn on its own.
        """
        if seed is None:
            return Dataset(self.df.sample(False, fraction))
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("")), F.coalesce("value", F.lit(""))).cast("binary"))
        return Dataset(self.df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(fraction * 2**32)))

    def distinct(self) -> Dataset:
        return Dataset(self.df.select(F.col("value").alias("key"), "value").distinct())

    def union(self, other: Dataset) -> Dataset:
        return Dataset(self.df.unionByName(other.df))

    def intersection(self, other: Dataset) -> Dataset:
        """Distinct values that both hold."""
        both = self.df.select("value").intersect(other.df.select("value"))
        return Dataset(both.select(F.col("value").alias("key"), "value"))

    def subtract(self, other: Dataset) -> Dataset:
        """Elements whose value the other doesn't hold."""
        return Dataset(self.df.join(other.df.select("value").distinct(), "value", "left_anti"))

    def group_by(self, group: Fn) -> DataFrame:
        """``key, value``: per group its elements in order, joined by commas; a null group is dropped."""
        return self.group_pairs(group).df.groupBy("key").agg(_joined().alias("value"))

    def group_pairs(self, group: Fn) -> PairDataset:
        """One pair per element under its group; a null group is dropped."""
        return self.map_to_pair(group, lambda v: v)


class PairDataset:
    """Values under keys; a key may have many."""

    def __init__(self, df: DataFrame):
        self.df = df.select(*[F.col(c).cast("string").alias(c) for c in ("key", "col", "value")]).where("value IS NOT NULL")

    def collect(self) -> list[tuple[str, str]]:
        return [(r["key"], r["value"]) for r in self.df.orderBy("key", "value").collect()]

    def pairs(self) -> DataFrame:
        return self.df.select("key", "value")

    def rows(self) -> DataFrame:
        """``key, cells``: one row per key, its values in a map by column; of a repeated column the greatest stays."""
        cells = self.df.groupBy("key", "col").agg(F.max("value").alias("value"))
        return cells.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cells"))

    def save(self, path: str, overwrite: bool = False) -> None:
        self.rows().write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

    def flat_map(self, fn: Callable[[Column, Column], Column]) -> Dataset:
        """``fn(key, value)`` gives an array of strings per pair."""
        each = self.df.select("key", "col", F.posexplode(fn(F.col("key"), F.col("value"))).alias("__i", "v"))
        return Dataset(each.select(_fresh_key("key", "col", F.col("__i").cast("string")).alias("key"), F.col("v").alias("value")))

    def flat_map_to_pair(self, fn: Callable[[Column, Column], Column]) -> PairDataset:
        """``fn(key, value)`` gives an array of ``struct<k, v>``; all pairs are kept but those with an empty key."""
        each = self.df.select("key", "col", F.posexplode(fn(F.col("key"), F.col("value"))).alias("__i", "__p")).where("__p.k <> ''")
        return PairDataset(each.select(F.col("__p.k").alias("key"), F.concat_ws("\x1f", "key", "col", "__i").alias("col"), F.col("__p.v").alias("value")))

    def fold_by_key(self, aggregate: Column, name: str = "value") -> DataFrame:
        """``key`` and an algebraic fold of its values, combined before the shuffle; the zero counts once per key."""
        return self.df.groupBy("key").agg(aggregate.alias(name))

    def fold_by_key_ordered(self, zero: str, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
        """``key`` and any fold of its values in order; a key's values must fit into one task."""
        return self.df.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("value")), F.lit(zero), step).alias(name))

    def join(self, other: PairDataset) -> PairDataset:
        """Inner join on the key: each pair of values as ``left,right``."""
        right = other.df.select("key", F.col("col").alias("__c"), F.col("value").alias("__v"))
        return PairDataset(self.df.join(right, "key").select("key", F.concat_ws("\x1f", "col", "__c").alias("col"), F.concat_ws(",", "value", "__v").alias("value")))

    def cogroup(self, other: PairDataset) -> DataFrame:
        """``key, value`` with value ``[l,l],[r]``: both sides' values in order, an absent side empty."""
        left = self.df.groupBy("key").agg(_joined().alias("l"))
        right = other.df.groupBy("key").agg(_joined().alias("r"))
        side = lambda c: F.coalesce(F.col(c), F.lit(""))
        return left.join(right, "key", "full_outer").select("key", F.concat(F.lit("["), side("l"), F.lit("],["), side("r"), F.lit("]")).alias("value"))


def merge_by_key(parts: list[DataFrame], key: str, value: str, words: DataFrame | None = None) -> DataFrame:
    """Values of equal keys of several tables, in order, joined by commas; only keys that ``words`` holds, if given."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if words is not None:
        whole = whole.join(words, key, "left_semi")
    return whole.groupBy(key).agg(_joined(value).alias(value))
