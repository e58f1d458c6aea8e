import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import crawl, index, rank, search


def brute_rank(nodes, edges, rounds):
    edges = set(edges)
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    now = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        now = {n: 0.15 + sum(0.85 * now[a] / degree[a] for a, b in edges if b == n and a in now) for n in nodes}
    return now


def test_rank(spark):
    r = random.Random(3)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(r.choice(nodes), r.choice([*nodes, "unknown"])) for _ in range(120)] + [("n1", "n1"), ("n1", "n1")]
    n, e = spark.createDataFrame([(x,) for x in [*nodes, "n1", None]], "id string"), spark.createDataFrame([*edges, (None, "n1")], "src string, dst string")
    got = {x.id: x.curr for x in rank.page_rank(n, e, threshold=None, rounds=5).collect()}
    want = brute_rank(nodes, edges, 5)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert min(got.values()) >= 0.15
    done = rank.page_rank(n, e, threshold=0.001)
    assert rank.diffs(done).agg(F.max("diff")).first()[0] < 0.001
    assert rank.converged(done, 0.001, 75) and not rank.converged(rank.step(rank.initial(n), rank.weighted(e)), 1e-9, 50)
    assert rank.page_rank(n.limit(0), e).count() == 0


def test_frontier(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("c", None)], "src string, dst string")
    s = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert {r.id: r.depth for r in crawl.frontier(s, e).collect()} == {"a": 0, "b": 1, "c": 1}
    assert crawl.frontier(s.limit(0), e).count() == 0


def test_crawl_tables(spark):
    rows = [("1", "h", 10, 200), ("2", "h", 10, 301), ("3", "h", 500, None), ("4", "g", 11, 200), ("5", None, 12, 200)]
    df = spark.createDataFrame(rows, "id string, host string, ms long, responsecode int").withColumn("at", F.timestamp_millis("ms")).withColumn("redirecturl", F.lit("u"))
    got = crawl.too_soon(df, "host", "at", [F.col("at"), F.col("id")], 400)
    assert {r.id: r.gap_ms for r in got.collect()} == {"2": 0}
    assert [r.id for r in crawl.redirects(df).collect()] == ["2"]
    assert {r.id for r in crawl.unseen(spark.createDataFrame([("3",), ("1",), ("9",)], "id string"), df).collect()} == {"3", "9"}
    assert crawl.within_quota(df, "host", [F.col("id")], 2).where("host = 'h'").count() == 2


PAGES = [("u1", "red fox, red den"), ("u2", "fox red"), ("u3", "a red quick fox red fox"), ("u4", ""), ("u5", None), ("u6", "red " * 60), ("u7", "(den)")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "url string, page string")


def test_index(spark, pages):
    assert {r.url: r.n for r in index.word_counts(pages).collect()} == {"u1": 4, "u2": 2, "u3": 6, "u4": 1, "u5": 0, "u6": 60, "u7": 2}
    found = {(r.url, r.word): r.positions for r in index.positions(pages).collect()}
    assert found[("u1", "red")] == [1, 3] and found[("u7", "den")] == [2] and found[("u6", "red")] == list(range(1, 51))
    words = spark.createDataFrame([("fox",)], "word string")
    only = index.positions(pages, words=words)
    assert {r.word for r in only.collect()} == {"fox"}
    assert index.consolidate(index.posting_texts(only)).first().value == "u1:2,u2:1,u3:4 6"
    assert [p.url for p in index.inverted(only).first().postings] == ["u1", "u2", "u3"]
    assert index.positions(pages.limit(0)).count() == 0


def run(pages, query, ranks=None, strict=True):
    got = search.search(index.positions(pages), index.word_counts(pages), query, ranks, strict)
    return {r.url: r for r in got.collect()}


def test_search(spark, pages):
    got = run(pages, "Red FOX")
    assert got["u1"].exact and got["u3"].exact and not got["u2"].exact and got["u6"].near
    # Four pages have a term: idf of red is 4/4, of fox 4/3.
    assert got["u2"].score == round(1000 * (1 + 4 / 3) / 2, 6)
    assert got["u6"].score == round(1000 * 50 / 60 + 600, 6)
    assert run(pages, "nosuch") == {} and run(pages, "") == {}
    assert run(pages, "red")["u6"].exact  # a single term always matches
    ranked = run(pages, "red fox", spark.createDataFrame([("u2", 7.5), ("u1", None)], "url string, rank double"))
    assert ranked["u2"].score == round(1000 * (1 + 4 / 3) / 2 + 7.5, 6)
    again = run(pages, "red red")
    assert again["u1"].matched == 2 and not again["u1"].exact and again["u6"].exact


def test_phrase_forms(spark):
    # a@1 b@2 b@10 c@11: no chain, but neighbours meet pair by pair
    words = ["a", "b", *["x"] * 7, "b", "c"]
    page = spark.createDataFrame([("u", " ".join(words))], "url string, page string")
    assert not run(page, "a b c")["u"].exact and run(page, "a b c", strict=False)["u"].exact
    assert run(page, "a b nosuch")["u"].near


def test_candidate_cap(spark):
    many = spark.createDataFrame([(f"u{i:04d}", "w") for i in range(700)], "url string, page string")
    found = index.positions(many)
    assert search.candidates(found, spark, ["w"]).count() == 500
    assert search.candidates(found, spark, ["w"], most=None).count() == 700
    assert search.best(search.score(search.candidates(found, spark, ["w"]), 1, index.word_counts(many))).count() == 100


def test_preview_and_json(spark):
    df = spark.createDataFrame([(" ".join(f"W{i}," for i in range(200)), 51)], "page string, p int")
    words = df.select(search.preview(F.col("page"), F.col("p")).alias("c")).first().c.split()
    assert words[0] == "W41" and words[-1] == "W140" and len(words) == 100
    rows = spark.createDataFrame([(2, "b", 'q"'), (1, "a", None)], "place int, URL string, content string")
    assert search.as_json(rows, "URL", "content").first().json == '{"results":[{"URL":"a"},{"URL":"b","content":"q\\""}]}'
    assert search.as_json(rows.limit(0), "URL").first().json == '{"results":[]}'


def test_ranks_that_still_move_are_an_error(spark):
    n, e = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    lone = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert rank.page_rank(n, e, threshold=0.01).count() == 2
    with pytest.raises(RuntimeError):
        rank.page_rank(n, lone, threshold=1e-12, rounds=1)


def test_stored_index(spark):
    rows = [("cat", '"http://a.test":3 5 ,http://b.test:7'), ("cat", "http://a.test:5 9"), ("cat", "http://b.test:7"), ("cat", None), ("dog", "http://a.test:4"), (None, "http://x.test:1"), ("eel", "http://a.test:1")]
    df = spark.createDataFrame(rows, "word string, value string")
    got = {(r.word, r.url): r.positions for r in search.stored(df, ["cat", "dog"]).collect()}
    assert got == {("cat", "http://a.test"): [3, 5, 9], ("cat", "http://b.test"): [7], ("dog", "http://a.test"): [4]}
    assert search.stored(df.limit(0), ["cat"]).count() == 0
    assert search.parse_query("Caf%C3%A9+NOIR%20deux") == ["café", "noir", "deux"]


def test_preview_fallback(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "page string")
    got = [r.c for r in df.select(search.with_fallback(search.preview(F.col("page"), F.lit(1))).alias("c")).collect()]
    assert got == ["a b c", search.NO_PREVIEW, search.NO_PREVIEW]


def test_redirects_are_decoded(spark):
    df = spark.createDataFrame([(301, "http://a.test/%C3%A9"), (302, "http://a.test/100%"), (200, "http://a.test/%41"), (301, None)], "responsecode int, redirecturl string")
    assert sorted(r.redirecturl for r in crawl.redirects(df).collect()) == ["http://a.test/100%", "http://a.test/é"]
