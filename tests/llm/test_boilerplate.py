import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import boilerplate
from spindrift.llm.boilerplate import bodies, frame_lines

WORDS = "garden river table house window stone market letter road bridge village winter summer kitchen engine number picture season farmer teacher".split()
PLACES = [f"{a}{b}" for a in ("Ost", "Wel", "Kar", "Lim", "Dur") for b in ("berg", "fold", "wick", "stad", "haven")]
PARTS = ["Plumbing", "Orchards", "Telescopes", "Beekeeping", "Varnish", "Ropework", "Glazing", "Lanterns"]


def sentence(r):
    return f"The {r.choice(WORDS)} of {r.choice(PLACES)} is in the {r.choice(WORDS)} and it was {r.randint(2, 999)} years before a {r.choice(WORDS)} came to the {r.choice(WORDS)}."


#: Frames in wordings of our own, of which each site has one of four; nothing here is known to the operator.
TRAILS = ["Whereabouts:", "You stand in:", "Shelf:", "Trace:"]
NOTICES = ["Tiny crumbs are kept by your browser for us so that we can count how often you drop in.", "This shop writes small marks into your machine.", "Visits are tallied.", "We keep a note of where you go on these pages, and so do the ones who pay us."]
TEASERS = ["Peruse next", "Folk also opened", "From the attic:", "More like it:"]
CLOCKS = ["Tide table", "Barometer", "Wind from the west at", "Seats left"]


def frames(r, site):
    way = site % 4
    return {
        "menu": lambda: (" ~ ", " | ", "  ", " · ")[way].join(PARTS[way : way + 5]),
        "trail": lambda: f"{TRAILS[way]} {r.choice(PARTS)} | {r.choice(WORDS)}",
        "notice": lambda: NOTICES[way],
        "teaser": lambda: f"{TEASERS[way]} {r.choice(WORDS)} and {r.choice(WORDS)} near {r.choice(PLACES)}",
        "clock": lambda: f"{CLOCKS[way]} {r.randint(1, 12)}:{r.randint(10, 59)}",
        "foot": lambda: f"Typeset by Workshop {site}, all of it kept since {1900 + site}",
    }


@pytest.fixture(scope="module")
def crawl():
    r = random.Random(4)
    rows, truth = [], {}
    for site in range(12):
        kinds = frames(r, site)
        mine = r.sample(sorted(kinds), 4)
        for p in range(40):
            page = [(kinds[k](), True) for k in mine if k in ("menu", "trail", "notice")]
            page += [(f"{r.choice(WORDS)} in {r.choice(PLACES)}".title(), False), ("", None)]
            for _ in range(r.randint(2, 5)):
                page += [(" ".join(sentence(r) for _ in range(r.randint(1, 3))), False)]
                if r.random() < 0.2:
                    page += [(r.choice(["In brief", "Step by step"]), False), (f"* {r.choice(WORDS)}", False)]
            page += [(kinds[k](), True) for k in mine if k not in ("menu", "trail", "notice")]
            key = f"s{site:02d}p{p:02d}"
            rows.append((key, "\n".join(x for x, _ in page), f"http://www.site{site}.example/{p}"))
            truth |= {(key, i): f for i, (_, f) in enumerate(page, 1) if f is not None}
    return rows, truth


def frame(spark, rows):
    return {(r.id, r.line_no) for r in frame_lines(spark.createDataFrame(rows, "id string, page string, url string")).collect()}


def test_frames_in_words_never_seen(spark, crawl):
    rows, truth = crawl
    got, want = frame(spark, rows), {k for k, v in truth.items() if v}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)


def test_a_small_site_takes_the_lexicon_of_others(spark, crawl):
    rows, _ = crawl
    notice = NOTICES[0]
    page = f"{notice}\nA lone title\nThe house of the village is in the river and it was long before a teacher came to it."
    lone = [("lone", page, "http://lone.example/"), ("lost", page, None), ("bare", page, "no address")]
    assert {k for k in frame(spark, [*rows, *lone]) if k[0] in ("lone", "lost", "bare")} == {("lone", 1), ("lost", 1), ("bare", 1)}


def test_shuffle_and_broadcast_agree(spark, crawl, monkeypatch):
    rows, _ = crawl
    want = frame(spark, rows)
    monkeypatch.setattr(boilerplate, "BROADCAST_MARKS", 0)
    assert frame(spark, rows) == want


def test_odd_pages(spark):
    long = "\n".join(["Top"] + ["we walked to the river and it was cold in the dark of the night"] * 20_000)
    data = [("c", None, "http://a.example/", 1), ("d", "", "http://a.example/", 1), ("e", " \n\t\n", None, 1), ("g", "lone words here", "http://a.example/", 1), ("h", long, "http://a.example/", 1), (None, "x", "x", 1)]
    df = spark.createDataFrame(data, "id string, page string, url string, labels int")
    assert frame_lines(df).count() == 0 and frame_lines(df.limit(0)).count() == 0
    got = {r.id: r.body for r in bodies(df).collect()}
    assert got == {"c": None, "d": None, "e": None, "g": "lone words here", "h": long}


def test_line_ends_and_blanks(spark, crawl):
    rows, _ = crawl
    other = [(k, p.replace("\n", "\r\n"), u) for k, p, u in rows]
    assert frame(spark, other) == frame(spark, rows)
    texts = {r.id: r.body for r in bodies(spark.createDataFrame(other, "id string, page string, url string")).collect()}
    assert not any("\r" in t for t in texts.values())


def test_short_blocks_take_their_neighbours_label(spark):
    settle = lambda text: spark.createDataFrame([(re.findall("[SL_]+|G+|B+", text),)], "__runs array<string>").select(F.array_join(F.transform("__runs", boilerplate._settle), "")).first()[0]
    assert settle("BLGSLB_L") == "BGGGGB_B" and settle("L") == "B" and settle("SS") == "GG" and settle("BSLB") == "BGBB"


def test_no_sentence_is_frame(spark, small):
    """On all pages of a small crawl: sentences of the body don't become frame."""
    from spindrift.sources.tables import pages

    text = {r.id: r.page for r in pages(spark, small, "page").collect()}
    for r in frame_lines(pages(spark, small, "page", "url")).collect():
        line = text[r.id].split("\n")[r.line_no - 1].strip()
        assert line and len(re.findall(r"\. [A-Z]", line)) < 4, line
