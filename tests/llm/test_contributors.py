import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm.contributors import cap_contributors, over_share, water_level


def order():
    return [F.col("q").desc_nulls_last(), F.col("id")]


@given(counts=st.lists(st.integers(1, 500), min_size=1, max_size=60), share=st.sampled_from([0.01, 0.03, 0.1, 0.34, 1.0]), of=st.sampled_from(["input", "output"]))
def test_level_is_the_greatest_consistent_one(counts, share, of):
    def fits(level):
        total = sum(counts) if of == "input" else sum(min(c, level) for c in counts)
        return level <= max(1, math.ceil(round(share * total, 9)))

    level = water_level(counts, sum(counts), share, of)
    assert level == max(x for x in range(1, sum(counts) + 2) if fits(x))
    # The greatest 1 / share + 1 counts are enough.
    assert level == water_level(sorted(counts)[-(math.ceil(1 / share) + 1) :], sum(counts), share, of)


def test_bad_arguments():
    with pytest.raises(ValueError):
        water_level([1], 1, 0.0)
    with pytest.raises(ValueError):
        water_level([1], 1, 0.5, "sideways")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(f"p{i:05d}", r.choice(["hot"] * 10 + [f"d{r.randint(0, 300)}"] * 20 + [None]), r.choice([None, 0.0, 0.5, r.random()]), "x") for i in range(4000)]
    return out


@pytest.mark.parametrize(("share", "of", "most"), [(0.03, "input", None), (0.03, "output", None), (0.2, "input", 5)])
def test_against_a_plain_loop(spark, rows, share, of, most):
    df = spark.createDataFrame(rows, "id string, host string, q double, __n string")
    by = {}
    for i, h, q, _ in rows:
        if h is not None:
            by.setdefault(h, []).append((-(q if q is not None else -1), i))
    level = water_level([len(v) for v in by.values()], len(rows), share, of, most)
    want = {i for v in by.values() for _, i in sorted(v)[level:]}
    over = over_share(df, "host", order(), share, of, most)
    assert over.columns == df.columns
    assert {r.id for r in over.collect()} == want
    kept = cap_contributors(df, "host", order(), share, of, most)
    assert sorted(r.id for r in kept.collect()) == sorted({r[0] for r in rows} - want)
    if of == "output":
        assert max(r["count"] for r in kept.where("host IS NOT NULL").groupBy("host").count().collect()) <= math.ceil(share * kept.count())


def test_ties_repeats_and_nothing(spark):
    df = spark.createDataFrame([("a", "h", 1.0)] * 5 + [("b", "h", None), ("c", None, None)], "id string, host string, q double")
    assert cap_contributors(df, "host", order(), 0.4).groupBy("host").count().where("host = 'h'").first()["count"] == 3
    assert cap_contributors(df.limit(0), "host", order(), 0.4).count() == 0
    assert over_share(df.where("host IS NULL"), "host", order(), 0.4).count() == 0


def test_shares_that_too_few_contributors_cannot_meet():
    assert water_level([100, 100, 100], 300, 0.1, "output") == 1
    assert water_level([100, 100, 100], 300, 0.1, "input", contributors=3) == 30
    with pytest.raises(ValueError):
        water_level([100, 100, 100], 300, 0.1, "output", contributors=3)
