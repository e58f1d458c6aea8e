import pytest
from pyspark.sql import functions as F

from spindrift.operators.dataset import Dataset, PairDataset, merge_by_key


def ds(spark, values):
    return Dataset(spark.createDataFrame([(f"{i:03d}", v) for i, v in enumerate(values)], "key string, value string"))


def ps(spark, pairs):
    return PairDataset(spark.createDataFrame([(k, str(i), v) for i, (k, v) in enumerate(pairs)], "key string, col string, value string"))


ODD = ["", "a b", "a,b", "x:y", "line\nfeed", "dup", "dup", None]


def test_actions(spark):
    d = ds(spark, ODD)
    assert d.count() == 7  # null is no element, repeated ones count
    assert d.take(2) == ["", "a b"] and d.take(0) == [] and len(d.take(99)) == 7
    assert sorted(d.collect()) == sorted(v for v in ODD if v is not None)
    assert ds(spark, []).count() == 0 and ds(spark, []).collect() == []
    assert Dataset.parallelize(spark, ["b", "a"]).collect() == ["b", "a"]


def test_folds(spark):
    d = ds(spark, ["3", "1", "2"])
    assert d.fold(F.sum(F.col("value").cast("int"))).first()[0] == 6
    assert d.fold_ordered("0", lambda a, x: F.concat(a, x)).first()[0] == "0123"  # the zero counts once
    assert ds(spark, []).fold_ordered("0", lambda a, x: F.concat(a, x)).first()[0] == "0"


def test_projections(spark):
    d = ds(spark, ["a b", "b", ""])
    assert sorted(d.flat_map(lambda v: F.split(v, " ")).collect()) == ["", "a", "b", "b"]
    pairs = d.flat_map_to_pair(lambda v: F.transform(F.split(v, " "), lambda w: F.struct(w.alias("k"), v.alias("v"))))
    assert pairs.collect() == [("a", "a b"), ("b", "a b"), ("b", "b")]  # the empty key is dropped
    assert d.map_to_pair(lambda v: F.when(v != "b", v), lambda v: F.lit("1")).collect() == [("", "1"), ("a b", "1")]
    assert d.filter(lambda v: F.length(v) > 0).collect() == ["a b", "b"]
    assert sorted(d.map_partitions(lambda it: (v + v for v in it)).collect()) == ["", "a ba b", "bb"]
    assert 0 < ds(spark, ["x"] * 1000).sample(0.3, seed=1).count() < 1000


def test_sets(spark):
    a, b = ds(spark, ["a b", "x", "x", ""]), ds(spark, ["x", "a b", "y"])
    assert sorted(a.intersection(b).collect()) == ["a b", "x"]
    assert sorted(a.distinct().collect()) == ["", "a b", "x"]
    assert a.union(b).count() == 7
    assert a.subtract(b).collect() == [""]
    assert a.intersection(ds(spark, [])).count() == 0


def test_groups(spark):
    d = ds(spark, ["bb", "a", "cc", "b"])
    got = {r.key: r.value for r in d.group_by(lambda v: F.when(v != "a", F.length(v).cast("string"))).collect()}
    assert got == {"2": "bb,cc", "1": "b"}  # a null group is dropped
    assert d.group_pairs(lambda v: F.length(v).cast("string")).collect() == [("1", "a"), ("1", "b"), ("2", "bb"), ("2", "cc")]


def test_pairs(spark):
    left, right = ps(spark, [("k", "1"), ("k", "2"), ("l", "3"), ("", "0")]), ps(spark, [("k", "a"), ("k", "b"), ("r", "c")])
    assert left.join(right).collect() == [("k", "1,a"), ("k", "1,b"), ("k", "2,a"), ("k", "2,b")]
    assert {r.key: r.value for r in left.cogroup(right).collect()} == {"k": "[1,2],[a,b]", "l": "[3],[]", "r": "[],[c]", "": "[0],[]"}
    assert {r.key: r.value for r in left.fold_by_key(F.lit(10) + F.sum(F.col("value").cast("int"))).collect()} == {"k": 13, "l": 13, "": 10}
    assert {r.key: r.value for r in right.fold_by_key_ordered("", lambda a, x: F.concat(a, x)).collect()} == {"k": "ab", "r": "c"}
    turned = left.flat_map_to_pair(lambda k, v: F.array(F.struct(F.lit("t").alias("k"), v.alias("v")), F.struct(F.lit("").alias("k"), v.alias("v"))))
    assert turned.collect() == [("t", "0"), ("t", "1"), ("t", "2"), ("t", "3")]  # all values of a key are kept
    assert left.flat_map(lambda k, v: F.array(k, v)).count() == 8
    assert {r.key: r.cells for r in right.rows().collect()} == {"k": {"0": "a", "1": "b"}, "r": {"2": "c"}}


def test_save(spark, tmp_path):
    at = str(tmp_path / "t")
    ds(spark, ["a"]).save(at)
    with pytest.raises(Exception, match="exist"):
        ds(spark, ["b"]).save(at)
    ps(spark, [("k", "1")]).save(at, overwrite=True)
    assert spark.read.parquet(at).first().cells == {"0": "1"}
    assert spark.table(ds(spark, ["a", "b"]).view("named")).count() == 2


def test_dictionary_and_merge(spark):
    words = spark.createDataFrame([(" Pear ",), ("fig",), ("",), (None,)], "word string")
    d = spark.createDataFrame([("1", "pear"), ("2", "plum"), ("3", "")], "k string, v string")
    assert Dataset.from_table_within(d, F.col("k"), F.col("v"), words).collect() == ["pear"]
    parts = [spark.createDataFrame(rows, "w string, v string") for rows in ([("a", "2"), ("b", "1")], [("a", "1"), ("c", "9")])]
    keep = spark.createDataFrame([("a",), ("b",)], "w string")
    assert {r.w: r.v for r in merge_by_key(parts, "w", "v", keep).collect()} == {"a": "1,2", "b": "1"}
    assert merge_by_key(parts, "w", "v").count() == 3
