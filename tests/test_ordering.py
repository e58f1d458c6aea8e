import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators.ordering import lookup, previous, running_total


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.randint(0, 40), r.choice([None, 1, 2])) for i in range(3000)]


def test_running_total(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v int, w int")
    got = {r.id: (r.n, r.s) for r in running_total(running_total(df, [F.col("v").desc(), F.col("id")], ["g"], name="n"), [F.col("v").desc(), F.col("id")], ["g"], F.col("w"), "s").collect()}
    count, total = {}, {}
    for i, g, _, w in sorted(rows, key=lambda x: (-x[2], x[0])):
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + (w or 0)
        assert got[i] == (count[g], total[g])


def test_running_total_of_everything_and_nothing(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v int, w int")
    assert sorted(r.total for r in running_total(df, [F.col("v"), F.col("id")]).collect()) == list(range(1, 3001))
    assert running_total(df.limit(0), [F.col("id")]).count() == 0


def test_previous(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v int, w int")
    got = {r.id: r.previous for r in previous(df, "w", [F.col("v"), F.col("id")], ["g"]).collect()}
    last = {}
    for i, g, _, w in sorted(rows, key=lambda x: (x[2], x[0])):
        assert got[i] == last.get(g)
        last[g] = w


def test_lookup(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, v int, w int")
    sizes = df.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"))
    got = lookup(df, sizes, ["g"], "n", share=0.5)
    assert got.count() == sum(r[1] is not None for r in rows)
    assert {r.g: r.n for r in got.collect()} == {g: sum(r[1] == g for r in rows) for g in ("hot", "a", "b")}
