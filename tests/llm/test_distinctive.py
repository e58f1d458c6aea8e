import math

from spindrift.llm.distinctive import postings, residuals


def test_postings(spark):
    rows = [("w", "http://a.test:1 2 2,http://b.test:3"), ("w", "'http://a.test':2 4"), ("w", "http://a.test:1 2 2,http://b.test:3"), ("v", None), (None, "http://a.test:1"), ("x", ""), ("y", "junk")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "word string, value string, seq int")
    assert {(r.word, r.url): r.tf for r in postings(df).collect()} == {("w", "http://a.test"): 3, ("w", "http://b.test"): 1}
    assert postings(df.limit(0)).count() == 0


def test_residuals(spark):
    counts = spark.createDataFrame([("rare", "a", 4), ("the", "a", 6), ("the", "b", 9), ("lost", "zz", 1), (None, "a", 1), ("the", None, 1)], "word string, url string, tf long")
    records = spark.createDataFrame([("1", "a", 100, 7), ("2", "b", None, 7), ("3", "c", 0, 7), ("4", None, 5, 7)], "id string, url string, wordcount int, tf int")
    got = {(r.word, r.id): r for r in residuals(counts, records).collect()}
    assert set(got) == {("rare", "1"), ("the", "1"), ("the", "2")}
    n = 100 + 1000 + 1 + 5  # unknown sizes count 1000, empty ones 1
    for (word, i), (tf, r, c) in {("rare", "1"): (4, 4, 100), ("the", "1"): (6, 15, 100), ("the", "2"): (9, 15, 1000)}.items():
        e = r * c / n
        assert math.isclose(got[(word, i)].adjusted, (tf - e) / math.sqrt(e) / math.sqrt((1 - r / n) * (1 - c / n)))
        assert got[(word, i)].n_records == (1 if word == "rare" else 2) and got[(word, i)].tf == tf
    assert got[("rare", "1")].adjusted > got[("the", "1")].adjusted
    assert residuals(counts.limit(0), records).count() == 0 and residuals(counts, records.limit(0)).count() == 0


def test_whole_margin(spark):
    counts = spark.createDataFrame([("w", "a", 10)], "word string, url string, tf long")
    records = spark.createDataFrame([("1", "a", 10)], "id string, url string, wordcount int")
    assert residuals(counts, records).first().adjusted is None
