import pytest
from pyspark.sql import functions as F

from spindrift.operators import store
from spindrift.sources import rowlog
from spindrift.sources.tables import current


@pytest.fixture(scope="module")
def log(spark):
    rows = [("r", "a", "1", 0), ("r", "b", "2", 1), ("r", "a", "3", 2), ("s p", "a", "", 3), ("s p", "a", "", 3), (None, "a", "x", 4), ("t", "a", None, 5)]
    return spark.createDataFrame(rows, "key string, col string, value string, seq long")


def test_cells_and_rows(log):
    assert {(r.key, r.col): r.value for r in store.current_cells(log).collect()} == {("r", "a"): "3", ("r", "b"): "2", ("s p", "a"): "", ("t", "a"): None}
    assert {r.key: r.cells for r in store.current_rows(log).collect()} == {"r": {"a": "3", "b": "2"}, "s p": {"a": ""}, "t": {"a": None}}
    assert [r.seq for r in store.raw(log).collect()] == [0, 1, 2, 3, 3, 4, 5]
    assert store.current_cells(log.limit(0)).count() == 0


def test_put(spark, log):
    new = spark.createDataFrame([("r", "a", "9", 0), ("u", "a", "8", 1)], log.schema)
    cells = {(r.key, r.col): r.value for r in store.current_cells(store.put(log, new)).collect()}
    assert cells[("r", "a")] == "9" and cells[("u", "a")] == "8"
    assert store.put(log.limit(0), new).agg(F.min("seq")).first()[0] == 0


def test_current_view(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), ("b", 0, None), (None, 9, "y"), ("c", 5, "p"), ("c", 5, "q")]
    df = spark.createDataFrame(rows, "id string, seq long, page string")
    assert {r.id: r.page for r in current(df).collect()} == {"a": "new", "b": None, "c": "p"}
    assert current(df.limit(0)).count() == 0
    assert current(df).columns == df.columns


def test_scans(spark):
    t = spark.createDataFrame([(k, k.upper()) for k in "abcdefghijklm"], "key string, v string")
    assert [r.key for r in store.scan(t, "c", "e").collect()] == ["c", "d"]
    assert store.scan(t, "e", "e").count() == 0
    with pytest.raises(ValueError):
        store.scan(t, "e", "c")
    assert [r.key for r in store.page(t, "k").collect()] == ["k", "l", "m"] and store.page(t).count() == 10
    assert store.get_row(t, "c").first().v == "C" and store.get_cell(t, "zz", "v").count() == 0
    other = spark.createDataFrame([("a", 1), ("a", 2)], "key string, n int")
    assert store.exists(t, other, "key").count() == 1 and store.exists(t, other, "key", there=False).count() == 12
    one = other.where("n = 1")
    assert {r.key: r.n for r in store.enrich(t, one, "key", "n", -1).collect()}["b"] == -1
    owners = {r.key: r.o for r in t.select("key", store.owner(F.col("key"), ["k", "d"]).alias("o")).collect()}
    assert owners["a"] == "k" and owners["d"] == "d" and owners["j"] == "d" and owners["k"] == "k"  # lesser keys wrap round


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, seq long, v string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    assert store.compact(df, old).count() == 1
    with pytest.raises(FileNotFoundError):
        store.rename(spark, str(tmp_path / "none"), new)
    with pytest.raises(FileExistsError):
        store.rename(spark, old, old)
    store.rename(spark, old, new)
    assert store.tables(spark, str(tmp_path)) == ["new"]
    assert store.delete(spark, new) and not store.delete(spark, new)


def test_row_log(spark, tmp_path):
    line = rowlog.encode("k", {"c": b"two\nlines ", "d": b""})
    assert [(k, c) for _, k, c in rowlog.decode(line * 2)] == [("k", {"c": b"two\nlines ", "d": b""})] * 2
    assert len(list(rowlog.decode(line + line[:-3]))) == 1  # a torn row ends the log
    with pytest.raises(ValueError):
        rowlog.encode("a b", {})
    (tmp_path / "t.table").write_bytes(line)
    got = rowlog.read(spark, str(tmp_path / "*.table")).collect()
    assert [(r.table, r.key, r.col, bytes(r.value), r.seq) for r in got] == [("t", "k", "c", b"two\nlines ", 0), ("t", "k", "d", b"", 0)]
    rows = spark.createDataFrame([("k", {"c": "ü", "d": None})], "key string, cells map<string,string>")
    rowlog.write(rows, str(tmp_path / "out"))
    assert {r.col: bytes(r.value).decode() for r in rowlog.read(spark, str(tmp_path / "out" / "part-*")).collect()} == {"c": "ü", "d": ""}
    with pytest.raises(Exception, match="no key"):
        rowlog.write(spark.createDataFrame([("a b", {"c": "x"})], rows.schema), str(tmp_path / "bad"))
