"""Frame and body of web pages: two passes of rules over the blocks (lines) of a page, with what is a link learned from the crawl.

Tags are gone, so nothing in a line says that it is a link, a notice or a footer; no list of set phrases is used either.
What a site puts around every page tells itself apart by coming back: counts over all pages give each *mark* (a whole
line with digits and the site's name folded, its opening words, or the pieces that separators cut it into) the share of
its occurrences on sites that show it on a good part of their pages and, for openings, more often than other sites do.
Marks with such a share make up a lexicon of frame that holds for every site, small ones too.

Pass one decides each block: a block whose line or opening is in the lexicon, or most of whose characters are pieces in
it (its *link density*), is frame; stop-word density and length, or length and a closing mark in languages without a
list, make sentences; all else is undecided. Pass two lets an undecided block with some evidence inherit the label of
its nearest decided neighbours: body next to a sentence, as for headings, else frame. Without any evidence it is body.

Counting moves one row per page, line and mark, combined before each shuffle; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import domain
from spindrift.llm.words import CLOSED
from spindrift.operators.ordering import lookup
from spindrift.runtime import cut, once

#: Sentences: words, part of closed-class words, and characters where a closing mark stands in for the latter.
SENTENCE_WORDS, STOP_DENSITY, CLOSED_LENGTH = 8, 0.15, 40
#: A site can vouch for a mark that is on so many of its pages and on such a part of them, if it has so many pages. The mark
#: must also be so many times as frequent there as over all pages (headings are as frequent on one site as on another);
#: lines and pieces on this part of its pages need not be.
PAGES_LEAST, PART_LEAST, SITE_LEAST, LIFT, ANYWAY = 4, 0.2, 10, 2.0, 0.5
#: Share of a mark's occurrences on vouching sites from which it is frame by line or piece, by opening, or open to pass two.
SURE, SURE_OPENING, SOME = 0.5, 0.6, 0.2
#: Longest piece and opening label, and the greatest lexicon that is broadcast (16 bytes a mark; beyond it a shuffle).
PIECE, LABEL, BROADCAST_MARKS = 24, 24, 500_000
#: Longest line whose digits are folded as a whole; of longer ones the openings are.
FOLDED = 200
#: Kinds of marks.
LINE, OPENING, PIECES, LONG_OPENING = 0, 1, 2, 3

_SPACES = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200C)))
_SEPARATORS = r"\s*[|·•>»/,–]\s*|\s{2,}|\t|(?<=\p{Ll})(?=\p{Lu})|(?<=\))(?=\p{Lu})"
_ENDING = ".!?…。！？؟।"


def _by_first_letter(words: set[str]) -> str:
    """One alternation per first letter, so that few alternatives are tried at the beginning of a word."""
    letters = sorted({w[0] for w in words})
    return "|".join(c + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == c), key=lambda x: (-len(x), x))) + ")" for c in letters)


_STOPS = r"(?<![\p{L}\p{N}])(?:" + _by_first_letter({w for ws in CLOSED.values() for w in ws}) + r")(?![\p{L}\p{N}])"


def _fold(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "0")


def lines(df: DataFrame, key: str = "id", page: str = "page", url: str = "url") -> DataFrame:
    """``key, site, at, x, m, n, sentence``: each line, trimmed, with its masked form, number of words and form."""
    site = domain(url)
    name = F.regexp_extract(site, r"^([^.]{3,})", 1)
    named = F.coalesce(F.nullif(name, F.lit("")), F.lit("\n"))  # a line never holds a line feed
    # Per page, before its lines are rows.
    pages = df.where(F.col(key).isNotNull() & F.col(page).isNotNull()).select(key, once(site).alias("site"), once(F.initcap(named)).alias("__upper"), once(named).alias("__name"), once(F.split(page, "\n", -1)).alias("__x"))
    pages = pages.select(key, "site", "__upper", "__name", F.posexplode("__x").alias("at", "x"))
    edge = F.substring("x", 1, 1).isin(*_SPACES) | F.substring("x", -1, 1).isin(*_SPACES)
    rows = pages.withColumn("x", once(F.when(edge, F.btrim("x", F.lit(_SPACES))).otherwise(F.col("x"))))
    masked = F.replace(F.replace("x", F.col("__upper"), F.lit("§")), F.col("__name"), F.lit("§"))
    rows = rows.withColumn("m", once(F.when(F.length("x") <= FOLDED, _fold(masked)).otherwise(masked)))
    rows = rows.withColumn("n", once(F.length("x") - F.length(F.replace("x", F.lit(" "), F.lit(""))) + 1))
    stops = F.regexp_count(F.lower("x"), F.lit(_STOPS)) >= STOP_DENSITY * F.col("n")
    closed = (F.length("x") >= CLOSED_LENGTH) & F.substring("x", -1, 1).isin(*_ENDING)
    # The cheap test first: words are only counted where it fails.
    sentence = closed | ((F.col("n") >= SENTENCE_WORDS) & (F.length("x") >= 2 * SENTENCE_WORDS) & stops)
    return rows.select(key, "site", "at", "x", "m", "n", once(sentence).alias("sentence"))


def marks(rows: DataFrame, key: str = "id") -> DataFrame:
    """``key, site, at, empty, plain, whole, kind, h, size``: one row per line and mark; blank lines have one without a mark.

    ``plain`` tells that the line is a sentence or holds an address, ``whole`` counts the characters of all its pieces.
    """
    m, n = F.col("m"), F.col("n")
    words = lambda k: F.substring_index(m, " ", k)
    mark = lambda kind, text, size=None: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), text).alias("h"), (F.lit(0) if size is None else size).alias("size"))
    colon = F.instr(m, ":")
    label = (colon > 1) & (colon <= LABEL) & (colon < F.length(m))
    short = F.array(
        F.when(n > 2, mark(OPENING, words(2))),
        F.when((n > 1) & words(1).rlike(r"^.+[^\p{L}\p{N}]$"), mark(OPENING, F.concat(words(1), F.lit(" ")))),
    )
    pieces = F.filter(F.split(F.regexp_replace(m, r"^[^:]{1,20}: ", ""), _SEPARATORS, -1), lambda p: p != "")
    rows = rows.withColumn("__p", once(F.when(~F.col("sentence") & (F.col("x") != ""), pieces)))
    known = F.when((F.size("__p") > 1) | (F.length(m) <= PIECE), F.transform(F.filter("__p", lambda p: F.length(p) <= PIECE), lambda p: mark(PIECES, p, F.length(p))))
    always = F.array(F.when(F.col("x") != "", mark(LINE, m)), F.when(n > 5, mark(LONG_OPENING, _fold(words(4)))), F.when(label, mark(OPENING, _fold(F.substring(m, F.lit(1), colon)))))
    none = F.array().cast("array<struct<kind:int,h:bigint,size:int>>")
    every = F.filter(F.concat(always, F.when(F.col("sentence"), none).otherwise(F.concat(short, F.coalesce(known, none)))), lambda s: s.isNotNull())
    plain = F.col("sentence") | F.contains("x", F.lit("://"))
    whole = F.coalesce(F.aggregate("__p", F.lit(0), lambda a, p: a + F.length(p)), F.lit(0))
    each = rows.select(key, "site", "at", (F.col("x") == "").alias("empty"), plain.alias("plain"), whole.alias("whole"), F.explode_outer(once(every)).alias("__s"))
    return each.select(key, "site", "at", "empty", "plain", "whole", "__s.kind", "__s.h", "__s.size")


def lexicon(marked: DataFrame, sites: DataFrame, key: str = "id") -> DataFrame:
    """``h, kind, share, uses``: marks at least :data:`SOME` of whose occurrences are on sites that vouch for them.

    ``sites`` has ``site`` and ``pages`` (its number of pages). A mark counts once a page. Parts of a site's pages are
    taken in steps of a twentieth, so that each mark has at most 22 counts however many sites it is on.
    """
    total = sites.agg(F.sum("pages").alias("t")).first()["t"] or 0
    once_a_page = marked.where(F.col("h").isNotNull() & F.col("site").isNotNull()).groupBy(key, "site", "h").agg(F.max("kind").alias("kind"))
    counts = once_a_page.groupBy("site", "h").agg(F.count("*").alias("k"), F.max("kind").alias("kind"))
    counts = lookup(counts, sites, ["site"], "pages")  # a site may own any part of the marks
    big = F.col("pages") >= SITE_LEAST
    step = F.when(big & (F.col("k") >= PAGES_LEAST), F.floor(20 * F.col("k") / F.col("pages")).cast("int")).when(big, F.lit(-1)).otherwise(F.lit(-2))
    steps = counts.groupBy("h", step.alias("step")).agg(F.sum("k").alias("k"), F.max("kind").alias("kind"))
    by_mark = steps.groupBy("h").agg(F.max("kind").alias("kind"), F.sum("k").alias("uses"), F.sum(F.when(F.col("step") >= -1, F.col("k"))).alias("__seen"), F.collect_list(F.struct("step", "k")).alias("__steps"))
    usual = F.col("uses") / F.lit(float(max(total, 1)))
    asked = F.greatest(F.lit(PART_LEAST), F.when(F.col("kind").isin(OPENING, LONG_OPENING), LIFT * usual).otherwise(F.least(LIFT * usual, F.lit(ANYWAY))))
    vouched = F.aggregate("__steps", F.lit(0).cast("bigint"), lambda a, s: a + F.when((s["step"] >= 0) & (s["step"] / 20 >= asked - 1e-9), s["k"]).otherwise(0))
    return by_mark.select("h", "kind", (vouched / F.col("__seen")).alias("share"), "uses").where(F.col("share") >= SOME)


def labels(df: DataFrame, key: str = "id", page: str = "page", url: str = "url") -> DataFrame:
    """``key, labels``: one letter per line of each page with a text, ``G`` body, ``B`` frame, ``_`` blank.

    ``df`` should be partitioned by ``key``, as a latest-version view is; then nothing but counts is shuffled.
    """
    sites = cut(df.where(F.col(key).isNotNull() & F.col(page).isNotNull()).groupBy(domain(url).alias("site")).agg(F.count("*").alias("pages")).where(F.col("site").isNotNull()))
    marked = marks(lines(df, key, page, url), key)
    known = cut(lexicon(marked, sites, key)).select("h", "share", "uses")
    if known.count() <= BROADCAST_MARKS:
        found = marked.join(F.broadcast(known.select("h", "share")), "h", "left")
    else:  # rows without a known mark must stay, since a line may have no other
        hit = lookup(marked.where(F.col("h").isNotNull()), known, ["h"], "uses").select(*marked.columns, "share")
        found = hit.unionByName(marked.withColumns({"h": F.lit(None).cast("bigint"), "kind": F.lit(None).cast("int"), "size": F.lit(0), "share": F.lit(None).cast("double")}))
    best = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("share"))), F.lit(0.0)).alias(f"__{kind}")
    dense = F.coalesce(F.sum(F.when((F.col("kind") == PIECES) & (F.col("share") >= SURE), F.col("size"))), F.lit(0)).alias("__dense")
    each = found.groupBy(key, "at").agg(F.first("empty").alias("empty"), F.first("plain").alias("plain"), F.first("whole").alias("whole"), dense, *[best(k) for k in (LINE, OPENING, LONG_OPENING)])
    density = F.col("__dense") / F.greatest("whole", F.lit(1))
    letter = (
        F.when(F.col("empty"), "_")
        .when((F.col(f"__{LINE}") >= SURE) | (F.col(f"__{LONG_OPENING}") >= SURE) | (F.col(f"__{OPENING}") >= SURE_OPENING) | (density >= SURE), "B")
        .when(F.col("plain"), "G")
        .when(F.greatest(density, F.col(f"__{LINE}"), F.col(f"__{OPENING}")) >= SOME, "L")
        .otherwise("S")
    )
    page_rows = each.select(key, F.struct("at", letter.alias("l")).alias("__l")).groupBy(key).agg(F.array_sort(F.collect_list("__l")).alias("__ls"))
    first = F.array_join(F.transform("__ls", lambda s: s["l"]), "")
    runs = page_rows.select(key, once(F.regexp_extract_all(first, F.lit("[SL_]+|G+|B+"), 0)).alias("__runs"))
    return runs.select(key, once(F.array_join(F.transform("__runs", _settle), "")).alias("labels"))


def _settle(run: Column, i: Column) -> Column:
    good = lambda x: F.coalesce(F.substring(x, 1, 1) == "G", F.lit(False))
    runs = F.col("__runs")
    by_good = good(F.get(runs, i - 1)) | good(F.get(runs, i + 1))
    return F.when(by_good, F.translate(run, "SL", "GG")).otherwise(F.translate(run, "SL", "GB"))


def frame_lines(df: DataFrame, key: str = "id", page: str = "page", url: str = "url") -> DataFrame:
    """``key`` and ``line_no`` (from 1, blank lines counted) of each frame line.

    ``key`` must be unique. Null and empty pages and null keys have no frame; a page with a null url takes part in no
    site's counts but is judged like others. Other columns are left out, whatever their names. An empty frame gives an
    empty frame.
    """
    marked = labels(df.select(key, page, url), key, page, url).select(key, once(F.split("labels", "")).alias("__each"))
    return marked.select(key, F.posexplode("__each").alias("__at", "__label")).where(F.col("__label") == "B").select(key, (F.col("__at") + 1).alias("line_no"))


def bodies(df: DataFrame, key: str = "id", page: str = "page", url: str = "url") -> DataFrame:
    """``key`` and ``body``: the body lines of each page, trimmed, in order, joined by line feeds; null where nothing is left.

    Keys and pages as in :func:`frame_lines`; null keys are left out, a null page has a null body.
    """
    own = df.where(F.col(key).isNotNull()).select(key, page, url)
    marked = own.select(key, page).join(cut(labels(own, key, page, url)), key, "left")  # labels are short; texts are read again
    text = marked.withColumn("__lines", once(F.split(page, "\n", -1)))
    kept = F.transform(F.filter("__lines", lambda x, i: F.substr("labels", i + 1, F.lit(1)) == "G"), lambda x: F.btrim(x, F.lit(_SPACES)))
    return text.select(key, once(F.nullif(F.array_join(kept, "\n"), F.lit(""))).alias("body"))
