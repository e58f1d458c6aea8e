"""Positional inverted index over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import tokens
from spindrift.runtime import once

#: Positions kept per page and word.
POSITIONS = 50


def word_counts(pages: DataFrame, key: str = "url", page: str = "page") -> DataFrame:
    """``key, n``: tokens of each page, those outside any dictionary too; 0 for null pages."""
    return pages.select(key, F.coalesce(F.size(tokens(page)), F.lit(0)).alias("n"))


def positions(pages: DataFrame, key: str = "url", page: str = "page", words: DataFrame | None = None, most: int = POSITIONS) -> DataFrame:
    """``key, word, positions``: the first ``most`` positions (from 1) of each word of each page.

    With ``words`` only words of that dictionary stay. Pages are read whole; per page and word only numbers move.
    """
    each = pages.select(key, F.posexplode(once(tokens(page))).alias("__at", "word"))
    if words is not None:
        each = each.join(words.select("word"), "word", "left_semi")
    found = each.groupBy(key, "word").agg(F.array_sort(F.collect_list(F.col("__at") + 1)).alias("__p"))  # one page's word
    return found.select(key, "word", F.slice("__p", 1, most).alias("positions"))


def posting_texts(found: DataFrame, key: str = "url") -> DataFrame:
    """``word, value``: each posting as ``url:pos pos …``."""
    return found.select("word", F.concat(F.col(key), F.lit(":"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")).alias("value"))


def inverted(found: DataFrame, key: str = "url") -> DataFrame:
    """``word, postings``: arrays of ``struct<url, positions>`` in url order; commas in urls do no harm."""
    return found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("url"), "positions"))).alias("postings"))


def consolidate(postings: DataFrame) -> DataFrame:
    """``word, value``: the postings of each word joined by commas, in order."""
    return postings.groupBy("word").agg(F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("value"))
