from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.operators.packed import URL_START, packed_values, split_posting, unpack, unpack_urls

CASES = [
    ("http://a.test/x,https://b.test/y", ["http://a.test/x", "https://b.test/y"]),
    ("HTTP://a.test/t?q=a,b ; https://b.test/z;v=2/x", ["HTTP://a.test/t?q=a,b", "https://b.test/z;v=2/x"]),
    ('["http://a.test/o?to=b,http://c.test","http://d.test"]', ["http://a.test/o?to=b,http://c.test", "http://d.test"]),
    ('"http://a.test/f?q=""x""",http://b.test/a|b/c | http://c.test', ['http://a.test/f?q="x"', "http://b.test/a|b/c", "http://c.test"]),
    ("'http://a.test/f?q=\"x\"','http://b.test'", ['http://a.test/f?q="x"', "http://b.test"]),
    ("'http://a.test/it''s'\thttp://b.test/it's", ["http://a.test/it's", "http://b.test/it's"]),
    ("\"http://a.test\",'http://b.test'\r\nhttp://c.test", ["http://a.test", "http://b.test", "http://c.test"]),
    ('"http://a.test":3 5 ,"http://b.test:7" ,, http://c.test:1 2', ["http://a.test:3 5", "http://b.test:7", "http://c.test:1 2"]),
    ("http://a.test,,,\n ;http://a.test,", ["http://a.test", "http://a.test"]),
    (" , ;|\n", []),
    ("", []),
    (None, None),
]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", packed_values("t", URL_START).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_rows(spark):
    rows = [(1, "http://a.test,http://b.test", "x"), (1, "http://a.test,http://b.test", "x"), (2, None, "y"), (3, "", "z"), (None, "http://c.test", None)]
    df = spark.createDataFrame(rows, "seq long, links string, item string")  # item clashes and is replaced
    out = unpack_urls(df, "links")
    assert out.columns == ["seq", "pos", "item"]
    assert sorted((r.seq or 0, r.pos, r.item) for r in out.collect()) == [(0, 0, "http://c.test"), *[(1, p, x) for p, x in ((0, "http://a.test"), (1, "http://b.test")) for _ in range(2)]]
    assert unpack_urls(df.limit(0), "links").count() == 0


def test_very_long_text(spark):
    n = 60_000
    text = ",".join(f'"http://a.test/{i}?q=""x"""' if i % 3 else f"http://a.test/{i};v=2" for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(packed_values("t", URL_START).alias("v")).first().v
    assert len(got) == n and got[1] == 'http://a.test/1?q="x"' and got[-1].startswith("http://a.test/")


def test_posting(spark):
    df = spark.createDataFrame([("http://a.test:80/x:3 5  9",), ("http://a.test:",), ("x",), (None,), ("http://a.test:1 b",)], "item string")
    got = [(r.p.url, r.p.positions) for r in df.select(split_posting("item").alias("p")).collect()]
    assert got == [("http://a.test:80/x", [3, 5, 9]), ("http://a.test", []), ("", []), (None, None), ("http://a.test", [])]


urls = st.builds(lambda s, h, p: f"{s}://{h}.test/{p}", st.sampled_from(["http", "HTTPS", "https"]), st.text("abc", min_size=1, max_size=5), st.text("abc/?=&;|,()'\"-", max_size=12).filter(lambda p: not p or p[-1] not in ",;|'\"" and p[0] not in "'\""))


@st.composite
def packed(draw):
    values = draw(st.lists(urls, max_size=8))
    out = []
    for v in values:
        mark = draw(st.sampled_from(['"', "'"]))
        plain = not any(c in v for c in "\"',;|")
        out.append(v if plain and draw(st.booleans()) else mark + v.replace(mark, mark * 2) + mark)
    text = ""
    for i, v in enumerate(out):
        text += (draw(st.sampled_from([",", ";", " | ", "\n", "\t", " , ", ",,"])) if i else "") + v
    return values, f"[{text}]" if draw(st.booleans()) else text


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(packed(), min_size=1, max_size=30))
def test_round_trip(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, t string")
    for start in (None, URL_START):
        got = {r.i: r.v for r in df.select("i", packed_values(F.col("t"), start).alias("v")).collect()}
        for i, (values, text) in enumerate(rows):
            assert got[i] == values, text


def test_any_values(spark):
    """Without a pattern that values begin with, every run of separators separates and quotes open at any value."""
    cases = [
        ('a;b;"c;d",e', ["a", "b", "c;d", "e"]), ("one, two|three  four", ["one", "two", "three", "four"]), ("'it''s here' x", ["it's here", "x"]), ('[1,2,"3 4"]', ["1", "2", "3 4"]),
        ("rock'n'roll, o'clock", ["rock'n'roll", "o'clock"]), ('""', []), (",;|", []), (None, None), ('say "so" now', ["say", "so", "now"]), ('12" disc', ['12"', "disc"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", packed_values("t").alias("v")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text
    rows = unpack(spark.createDataFrame([(1, "b;a;b")], "k int, t string"), "t").collect()
    assert [(r.k, r.pos, r.item) for r in rows] == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]
