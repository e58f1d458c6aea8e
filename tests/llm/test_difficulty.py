import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm.difficulty import graph, is_language, levels, propagate, word_count
from spindrift.llm.queries import p10_found

VOCABULARY = [[f"{p}{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] for p in ("easy", "mid", "hard", "learned")]


def text(r, level, n=80):
    """Mostly words of the level, some of its neighbours, and some that all share."""
    near = [x for x in (level - 1, level + 1) if 0 <= x < 4]
    pick = lambda: r.choice(VOCABULARY[level] if r.random() < 0.8 else VOCABULARY[r.choice(near)])
    return " ".join("the" if r.random() < 0.3 else pick() for _ in range(n))


def test_levels_spread_from_few_grades(spark):
    r = random.Random(6)
    truth = {i: i % 4 for i in range(400)}
    docs = spark.createDataFrame([(i, text(r, k), "x") for i, k in truth.items()], "doc_id long, text string, words string")
    grades = [(i, truth[i] + 1) for i in range(0, 24)] + [(0, 1), (1, None), (9999, 4), (None, 3), (10, 4)]
    got = {x.doc_id: x.level for x in levels(propagate(docs, spark.createDataFrame(grades, "doc_id long, level int"))).collect()}
    assert sum(got[i] == k + 1 for i, k in truth.items()) > 395


def test_odd_texts(spark):
    rows = [(1, "apple pear"), (2, "tensor manifold"), (3, ""), (4, None), (5, "123 456"), (6, "unrelated"), (7, "apple " * 100_000), (1, "apple pear"), (None, "apple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(1, 1), (2, 3)], "doc_id long, level int")
    got = {r.doc_id: r.level for r in levels(propagate(docs, grades)).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 1}  # a text apart takes the middle grade
    assert levels(propagate(docs, grades)).count() == 7
    assert {r.level for r in levels(propagate(docs, grades.where("level = 1"))).collect()} == {1}
    assert {r.level for r in levels(propagate(docs, grades.limit(0))).collect()} == {None}
    assert levels(propagate(docs.limit(0), grades)).count() == 0


def test_graph(spark):
    df = spark.createDataFrame([(1, "B a b, B c1")], "doc_id long, text string")
    got = graph(df).select(F.explode("words").alias("w")).select("w.h", "w.w").collect()
    want = {r.h: r.n / 5 for r in spark.createDataFrame([("b", 3), ("a", 1), ("c", 1)], "t string, n int").select(F.xxhash64("t").alias("h"), "n").collect()}
    assert {r.h: r.w for r in got} == want


def test_shuffle_and_broadcast_agree(spark, monkeypatch):
    from spindrift.llm import difficulty

    r = random.Random(1)
    docs = spark.createDataFrame([(i, text(r, i % 4)) for i in range(80)], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 4 + 1) for i in range(12)], "doc_id long, level int")
    small = {x.doc_id: round(x.difficulty, 9) for x in propagate(docs, grades).collect()}
    monkeypatch.setattr(difficulty, "BROADCAST_WORDS", 0)
    assert {x.doc_id: round(x.difficulty, 9) for x in propagate(docs, grades).collect()} == small


def test_several_rounds_reach_what_one_cannot(spark):
    docs = spark.createDataFrame([(1, "apple apple"), (2, "quark quark"), (3, "apple pear"), (4, "pear plum"), (5, "quark gluon"), (6, "gluon boson")], "doc_id long, text string")
    grades = spark.createDataFrame([(1, 1), (2, 3)], "doc_id long, level int")
    with pytest.raises(RuntimeError):
        propagate(docs, grades, rounds=1)  # words are still being reached
    got = {r.doc_id: r.difficulty for r in propagate(docs, grades).collect()}
    assert got[4] < 2 < got[6] and got[3] < 2 < got[5]


def test_values_stay_on_the_scale_of_the_grades(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, text(r, i % 4)) for i in range(200)], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 4 + 1) for i in range(40)], "doc_id long, level int")
    rows = propagate(docs, grades).collect()
    means = [sum(x.difficulty for x in rows if x.doc_id % 4 == k) / 50 for k in range(4)]
    assert all(abs(m - k - 1) < 0.35 for k, m in enumerate(means))


def test_grades_against_the_texts(spark):
    rows = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 1.0)], "doc_id long, difficulty double, grade double")
    with pytest.raises(ValueError):
        levels(rows)


def test_languages_and_words(spark):
    rows = [(" EN ", True), ("en-GB", True), ("en_XX", True), ("eng", False), ("de", False), (None, False), ("En", True)]
    df = spark.createDataFrame(rows, "l string, ok boolean")
    assert all(r.g == r.ok for r in df.select("ok", is_language("l", "en").alias("g")).collect())
    texts = spark.createDataFrame([(" a  b\tc d ", 3), ("", 0), (None, 0)], "t string, n int")
    assert all(r.g == r.n for r in texts.select("n", word_count("t").alias("g")).collect())


def test_held_out_grades(spark):
    """Graded documents that are hidden from the propagation get their grade back, but for the few graded one off."""
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").where(is_language("lang", "en") & (word_count("text") >= 60)).select("doc_id", "text")
    grades = spark.read.parquet(f"{base}/reading_labels.parquet").distinct()
    held = {r.doc_id: r.level for r in grades.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.level for r in levels(propagate(docs, grades.where("doc_id % 3 <> 0"))).collect()}
    hits = [got[i] == v for i, v in held.items() if i in got]
    assert len(hits) > 10 and sum(hits) >= 0.85 * len(hits)
    assert p10_found(spark, base).count() == docs.count()
