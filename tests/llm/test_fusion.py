import random

from spindrift.llm.fusion import fuse


def brute(rows, k=60):
    total = {}
    for c in range(1, len(rows[0])):
        values = [x[c] if x[c] is not None and x[c] == x[c] else float("-inf") for x in rows]
        for x, v in zip(rows, values, strict=True):
            rank = 1 + sum(o > v for o in values)
            total[x[0]] = total.get(x[0], 0) + int(1e12 / (k + rank) + 0.5)
    order = sorted(total, key=lambda i: (-total[i], i))
    return {i: (total[i] / 1e12, n) for n, i in enumerate(order, 1)}


def test_against_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(f"i{n:04d}", r.choice([0, 0, 0, r.randint(1, 9)]), r.choice([None, float("nan"), r.random() * 1e9]), float(r.randint(0, 3))) for n in range(700)]
    df = spark.createDataFrame(rows, "key string, rank int, score double, __v double")
    got = {x["key"]: (x.rrf, x.place) for x in fuse(df, "key", ["rank", "score", "__v"]).collect()}
    assert got == brute(rows)


def test_no_score_leads_by_its_scale(spark):
    rows = [(f"i{n}", float(n), 1e9 - 1e6 * n) for n in range(9)]
    got = {x.id: x.rrf for x in fuse(spark.createDataFrame(rows, "id string, a double, b double"), "id", ["a", "b"]).collect()}
    assert abs(got["i0"] - got["i8"]) < 1e-9


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 9.0), ("b", None), ("c", 1.0)], "id string, s double")
    got = {x.id: (x.rrf, x.place) for x in fuse(df, "id", ["s"]).collect()}
    assert got == {"a": (1 / 61, 1), "c": (1 / 61, 2), "b": (1 / 63, 3)} or {k: v[1] for k, v in got.items()} == {"a": 1, "c": 2, "b": 3}
    assert fuse(df.limit(0), "id", ["s"]).count() == 0
    twice = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "id string, s double")
    assert fuse(twice, "id", ["s"]).count() == 1
