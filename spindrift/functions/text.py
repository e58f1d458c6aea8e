"""Text functions: tokens, tag stripping, out-links, images, anchors. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import once

#: Punctuation that separates words (fixed value).
PUNCTUATION = r"""[.,:;!?'"()-]"""
#: Styles stay within a line, scripts may span lines (fixed values).
STYLE_OR_SCRIPT = r"(?:<style.*?>.*?</style.*?>)|(?:<script.*?>[\s\S]*?</script.*?>)"
TAG = r"<[^>]*>"
ANCHOR = r"""<[Aa][^>]*[Hh][Rr][Ee][Ff]=["']?([^\s"'<>]+)["']?[^>]*>([^<]*)</[Aa]>"""
IMAGE = r"""<[Ii][Mm][Gg][^>]*[Ss][Rr][Cc]=["']?([^\s"'<>]+)["']?[^>]*>"""
#: Suffixes of targets that are no pages.
NO_PAGE = r"(?i)\.(?:jpg|jpeg|gif|png|txt|pdf)$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Words in lower case, cut at white space after punctuation has become space.

    A leading separator gives a first empty token, which counts and shifts positions; trailing ones give none. An empty
    text is one empty token, a text of separators alone none, null is null.
    """
    bare = F.lower(F.regexp_replace(_c(text), PUNCTUATION, " "))
    trimmed = F.regexp_replace(bare, r"\s+$", "")
    return F.when((trimmed == "") & (bare != ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+", -1))


def strip_code(html: Column | str) -> Column:
    """HTML without style and script elements."""
    return F.regexp_replace(_c(html), STYLE_OR_SCRIPT, "")


def strip_html(html: Column | str, gap: str = "") -> Column:
    """The text of a page; tags leave ``gap`` behind, by default nothing, so that neighbouring words may meet."""
    return F.regexp_replace(strip_code(html), TAG, gap)


def anchors(df: DataFrame, html: str, *carried: str) -> DataFrame:
    """``carried, pos, href, anchor``: each link of a page that may lead to a page, in order; fragments cut off.

    Links to a fragment alone and pages that are null or without links give no row.
    """
    clean = strip_code(html)
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(clean, F.lit(ANCHOR), 2).alias("anchor"))
    each = df.select(*carried, F.posexplode(once(pairs)).alias("pos", "__a")).where(~F.col("__a.href").rlike(NO_PAGE))
    return each.select(*carried, "pos", F.regexp_replace("__a.href", "#.*$", "").alias("href"), F.col("__a.anchor").alias("anchor")).where("href <> ''")


def images(df: DataFrame, html: str, *carried: str) -> DataFrame:
    """``carried, pos, src, alt``: each image of a page with its ``alt`` text, empty if it has none."""
    whole = F.regexp_extract_all(strip_code(html), F.lit(IMAGE), 0)
    each = df.select(*carried, F.posexplode(once(whole)).alias("pos", "__tag"))
    src = F.regexp_replace(F.regexp_extract("__tag", IMAGE, 1), "#.*$", "")
    return each.select(*carried, "pos", src.alias("src"), F.regexp_extract("__tag", r'(?i)alt="([^"]*)"', 1).alias("alt")).where("src <> ''")


def alt_texts(found: DataFrame, *keys: str) -> DataFrame:
    """Alternative texts per image, joined by commas in the order of the page; empty ones add nothing."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("alt") != "", F.struct("pos", "alt")))), lambda x: x["alt"])
    return found.groupBy(*keys).agg(F.concat_ws(",", texts).alias("alt"))


def anchor_texts(found: DataFrame, *keys: str) -> DataFrame:
    """Anchor texts per target, joined by spaces in the order of the page."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("anchor") != "", F.struct("pos", "anchor")))), lambda x: x["anchor"])
    return found.groupBy(*keys).agg(F.concat_ws(" ", texts).alias("anchor"))
