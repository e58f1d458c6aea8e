import hashlib

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text, urls, web
from spindrift.functions.hashing import letter_hash

BASE = "https://h.test:443/a/b/c.html"
NORMAL = [
    ("http://x.test", "http://x.test:80/"), ("https://x.test/p", "https://x.test:443/p"), ("http://x.test:8080/p", "http://x.test:8080/p"),
    ("http://x.test:81", "http://x.test:81"), ("http://x.test/a:1", "http://x.test/a:1"), ("//y.test/z", "https://y.test/z"), ("//y.test/z?a=1?b", "https://y.test/z:443?a=1b"),
    ("//y.test/?a=1", "https://y.test:443/a=1"), ("/r?q", "https://h.test:443/r?q"), ("d.html", "https://h.test:443/a/b/d.html"), ("../e", "https://h.test:443/a/e"),
    ("../../f", "https://h.test:443/f"), ("../../../g", None), ("..", None), ("../", "https://h.test:443/a/"), ("", None), (None, None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, u, BASE) for i, (u, _) in enumerate(NORMAL)], "i int, u string, b string")
    got = {r.i: r.n for r in df.select("i", web.normalize("u", "b").alias("n")).collect()}
    for i, (link, want) in enumerate(NORMAL):
        assert got[i] == want, link
    bare = spark.createDataFrame([("x", "http://h.test")], "u string, b string")
    assert bare.select(web.normalize("u", "b")).first()[0] == "http://h.test/x"


def test_url_parts(spark):
    rows = ["http://h.test:80/p/q", "https://h.test", "/only/path", "", None]
    df = spark.createDataFrame([(u,) for u in rows], "u string").select(web.url_parts("u").alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [("http", "h.test", "80", "/p/q"), ("https", "h.test", None, "/"), (None, None, None, "/only/path"), (None, None, None, "/"), (None, None, None, "/")]


def test_hosts(spark):
    rows = {"HTTPS://u:p@WWW.A.Test.:8443/x": ("www.a.test", "a.test"), "http://one/": ("one", "one"), "http://[::1]:80/": ("[::1]", "[::1]"), "nothing": (None, None), "": (None, None)}
    df = spark.createDataFrame([(u,) for u in rows], "u string").select("u", urls.host("u").alias("h"), urls.domain("u").alias("d"))
    assert {r.u: (r.h, r.d) for r in df.collect()} == rows
    keys = ["http://A.test:80/x#f", "http://u@a.test./x", "HTTP://a.test/x"]
    assert spark.createDataFrame([(u,) for u in keys], "u string").select(urls.page_key("u")).distinct().count() == 1


def test_letter_hash(spark):
    def by_rule(s):
        out = ""
        for b in hashlib.sha1(s.encode()).digest():
            i = 255 if b == 0 else b if b < 128 else b - 1
            out += chr(97 + i % 26) + "acegikmoqs"[i // 26]
        return out

    rows = [f"http://h.test/{i}" for i in range(300)] + ["", "ü"]
    df = spark.createDataFrame([(u,) for u in rows], "u string").select("u", letter_hash("u").alias("h"))
    assert all(r.h == by_rule(r.u) for r in df.collect())
    assert spark.createDataFrame([(None,)], "u string").select(letter_hash("u")).first()[0] is None


def test_letter_hash_names_the_crawled_pages(spark, small):
    crawl = spark.read.parquet(f"{small}/crawl.parquet").select("id", "url").distinct()
    assert crawl.where(letter_hash("url") == F.col("id")).count() > 0.2 * crawl.count()


def test_robots(spark):
    cases = [
        ("User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b/c", True), ("User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/x", False),
        ("User-agent: *\nDisallow: ", "/x", False), ("User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b", "/b", False),
        ("User-agent: me\nDisallow: /m\n\nUser-agent: *\nDisallow: /a", "/a", False), ("", "/a", True), (None, "/a", True), ("User-agent: *\nDisallow: /a", "", False),
    ]
    df = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(cases)], "i int, r string, p string")
    got = {r.i: r.ok for r in df.select("i", web.robots_allow("p", web.robots_rules("r")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    own = df.where("i = 4").select(web.robots_rules("r", "me").alias("x")).first().x
    assert own == ["Disallow: /m"]


def test_lists(spark):
    assert len(web.BLOCKED) == len(set(web.BLOCKED)) == 61 and len(set(web.HUBS)) == len(web.HUBS) == 34
    df = spark.createDataFrame([("http://my.shop.test/",), ("http://ok.test/",), ("http://has.test/as x",), (None,)], "u string")
    assert sorted((r.u or "") for r in web.not_blocked(df, "u").collect()) == ["", "http://has.test/as x", "http://ok.test/"]
    assert web.not_blocked(df, "u", ()).count() == 4
    hosts = spark.createDataFrame([("http://a.org:80/x",), ("http://a.test/",), (None,)], "u string")
    assert [r[0] for r in hosts.select(web.followed("u")).collect()] == [True, False, False]
    assert [r[0] for r in spark.createDataFrame([("a.b.c",), ("x",)], "h string").select(web.root_domain("h")).collect()] == ["b.c", "x"]


def test_tokens(spark):
    cases = {"(Hello), it's  me.": ["", "hello", "it", "s", "me"], "": [""], " ... ": [], "a": ["a"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.tokens("t").alias("w"))
    assert {r.t: r.w for r in df.collect()} == cases
    assert spark.createDataFrame([(None,)], "t string").select(text.tokens("t")).first()[0] is None


HTML = """<style>a{}</style><script>
x="<a href='no'>n</a>"</script><p>One</p><p>two</p><A class=k HREF="/x#top">first</a><a href=/pic.JPG>img</a><a href='#f'>f</a>
<a href='y.js'></a><img src="/i.png" alt="one"><IMG SRC='/i.png' ALT="two"><img src=/j.png>"""


def test_html(spark):
    df = spark.createDataFrame([("1", HTML), ("2", ""), ("3", None)], "id string, html string")
    assert {r.id: r.b for r in df.select("id", text.strip_html("html").alias("b")).collect()}["1"].startswith("Onetwofirstimgf")
    assert df.select(text.strip_html("html", " ").alias("b")).first().b.split()[:3] == ["One", "two", "first"]
    assert [(r.id, r.pos, r.href, r.anchor) for r in text.anchors(df, "html", "id").collect()] == [("1", 0, "/x", "first"), ("1", 3, "y.js", "")]
    assert {(r.src, r.alt) for r in text.alt_texts(text.images(df, "html", "id"), "id", "src").collect()} == {("/i.png", "one,two"), ("/j.png", "")}
    assert text.anchor_texts(text.anchors(df, "html", "id"), "id").first().anchor == "first"


def test_rules_of_a_named_robot(spark):
    text = "User-agent: finder\nDisallow: /a\nAllow: /b\n\nUser-agent: *\nDisallow: /c"
    df = spark.createDataFrame([(text, "finder"), (text, "other"), (text, None), (text, ""), (None, "finder")], "robots string, agent string")
    got = [r.x for r in df.select(web.robots_rules("robots", F.col("agent")).alias("x")).collect()]
    assert got == [["Disallow: /a", "Allow: /b"], ["Disallow: /c"], ["Disallow: /c"], ["Disallow: /c"], []]


def test_blacklist_from_a_table(spark):
    table = spark.createDataFrame([("*bad.test*",), ("*bad.test*",), (None,)], "pattern string")
    patterns = web.blocked_patterns(table)
    assert patterns == ("*bad.test*",)
    urls = spark.createDataFrame([("http://bad.test/x",), ("http://good.test/x",), (None,)], "url string")
    assert sorted(str(r.url) for r in web.not_blocked(urls, "url", patterns).collect()) == ["None", "http://good.test/x"]
    with pytest.raises(ValueError):
        web.blocked_patterns(table, most=0)
