import pytest

from spindrift.cli import main
from spindrift.functions import web
from spindrift.operators import crawl
from spindrift.operators.job import Job

SITE = {
    "http://a.org:80/": (200, '<a href="/x">x</a> <a href="/secret/y">y</a> <a href="http://b.com/z">z</a> <a href="http://c.shop.com/">s</a> <a href="/p.png">p</a> <a href="http://d.test/">t</a>', None),
    "http://a.org:80/x": (200, '<a href="/">home</a><a href="/m">m</a>', None),
    "http://a.org:80/m": (301, None, "/moved"),
    "http://a.org:80/moved": (200, '<a href="/1">1</a><a href="/2">2</a><a href="/3">3</a>', None),
}


def test_rounds(spark):
    site = spark.createDataFrame([(u, *v) for u, v in SITE.items()], "url string, responsecode int, html string, redirecturl string")

    def fetch(queue):
        return queue.join(site, "url", "left").na.fill({"responsecode": 404})

    seeds = spark.createDataFrame([("http://a.org",), (None,)], "url string")
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /secret"), ("b.com", None)], "host string, robots string")
    fetched, links = crawl.run(seeds, fetch, robots, quota=6)
    got = {r.url: (r.responsecode, r["round"]) for r in fetched.collect()}
    assert got == {
        "http://a.org:80/": (200, 0), "http://a.org:80/x": (200, 1), "http://b.com:80/z": (404, 1), "http://a.org:80/m": (301, 2), "http://a.org:80/moved": (200, 3),
        "http://a.org:80/1": (404, 4), "http://a.org:80/2": (404, 4),
    }
    assert ("http://a.org:80/x", "http://a.org:80/") in {(r.url, r.link) for r in links.collect()}


def test_quota_by_kind_of_domain(spark):
    pages = [(h, d, i) for h, d in (("en.wikipedia.org", "wikipedia.org"), ("intranet", "intranet"), ("a.org", "a.org")) for i in range(1100)]
    site = spark.createDataFrame([(f"http://{h}:80/", 200, " ".join(f'<a href="/{i}">{i}</a>' for _, x, i in pages if x == d), None) for h, d in dict.fromkeys(p[:2] for p in pages)], "url string, responsecode int, html string, redirecturl string")
    fetch = lambda queue: queue.join(site, "url", "left").na.fill({"responsecode": 404})
    fetched, _ = crawl.run(site.select("url"), fetch, spark.createDataFrame([], "host string, robots string"), suffixes=("org", "intranet"))
    got = {r.host: r["count"] for r in fetched.select(web.url_parts("url")["host"].alias("host")).groupBy("host").count().collect()}
    assert got == {"en.wikipedia.org": 1101, "intranet": 1000, "a.org": 200}


def test_too_few_rounds(spark):
    seeds, edges = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert crawl.frontier(seeds, edges).count() == 4
    with pytest.raises(RuntimeError):
        crawl.frontier(seeds, edges, rounds=2)
    site = spark.createDataFrame([(u, *v) for u, v in SITE.items()], "url string, responsecode int, html string, redirecturl string")
    with pytest.raises(RuntimeError):
        crawl.run(spark.createDataFrame([("http://a.org",)], "url string"), lambda q: q.join(site, "url", "left"), spark.createDataFrame([], "host string, robots string"), rounds=2)


def test_seed():
    assert crawl.parse_seed(["http://a.test"]) == ("url", "http://a.test:80/")
    assert crawl.parse_seed(["https://a.test/x/y", "list"]) == ("url", "https://a.test:443/x/y")
    assert crawl.parse_seed(["https://a.test:1/"]) == ("url", "https://a.test:1/")
    assert crawl.parse_seed(["queue"]) == ("table", "queue")
    for bad in ([], [""], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            crawl.parse_seed(bad)


def test_job():
    job = Job()
    assert job.answer() == Job.EMPTY
    job.output("a")
    job.output("b")
    assert job.answer() == "ab"


def test_cli(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("1", "red fox", 1), ("1", "red fox den", 2), ("2", "fox", 3)], "id string, page string, seq long").write.parquet(f"{base}/content.parquet")
    run = lambda *a: main([base, *a], spark)
    assert run("tables") == "content\n" and run("count", "content") == "3\n"
    assert run("get", "content", "2") == '{"id":"2","page":"fox","seq":3}\n'
    assert run("scan", "content", "--from", "2").count("\n") == 1
    assert run("compact", "content", "now") == Job.EMPTY and run("count", "now") == "2\n"
    run("rename", "now", "then")
    assert run("delete", "then") == "True\n"
    assert run("search", "red", "fox").startswith('{"url":"1","matched":2,"exact":true')
