"""Ranked search of several terms over a positional index, with phrase boosts; image search.

The score is 1000 times the sum of term frequency times inverse frequency (the number of pages with any term over the
number with this one, no logarithm), divided by the page's words, plus the page's rank if it has one, else one for each
authority in its url, plus 1000 for the exact phrase or 600 if one term is missing and the rest form the phrase.
"""

from __future__ import annotations

from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import PUNCTUATION
from spindrift.functions.web import HUBS
from spindrift.operators.packed import split_posting, unpack_urls
from spindrift.runtime import cut

#: Pages kept per term and shown, and what a page without a word count, the phrase and the near phrase are worth.
CANDIDATES, SHOWN, UNKNOWN_WORDS, EXACT, NEAR = 500, 100, 1000, 1000, 600
#: Words before and after the first hit in a preview.
BEFORE, AFTER = 10, 90
#: What a result without text shows (fixed value).
NO_PREVIEW = "No preview content available"


def parse_query(text: str) -> list[str]:
    """Terms of a query as it stands in an address: escapes decoded, lower case, cut at white space; repeated terms stay."""
    return unquote_plus(text).lower().split()


def slots(spark: SparkSession, terms: list[str]) -> DataFrame:
    """``i, word``: the terms by their place."""
    return spark.createDataFrame(list(enumerate(terms)), "i int, word string")


def stored(index: DataFrame, terms: list[str], word: str = "word", value: str = "value") -> DataFrame:
    """``word, url, positions`` of the terms in a stored index of packed postings; the terms are a filter of its scan.

    A word may have many rows; repeated rows and postings count once.
    """
    rows = index.where(F.col(word).isin(*terms)).select(F.col(word).alias("word"), F.col(value).alias("value"))
    each = unpack_urls(rows, "value").select("word", split_posting("item").alias("p")).where("p.url <> ''").select("word", "p.url", "p.positions")
    return each.groupBy("word", "url").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("positions")))).alias("positions"))


def candidates(found: DataFrame, spark: SparkSession, terms: list[str], most: int | None = CANDIDATES, key: str = "url") -> DataFrame:
    """``i, url, positions, freq``: per slot the first ``most`` pages by url."""
    hits = found.join(F.broadcast(slots(spark, terms)), "word").select("i", F.col(key).alias("url"), "positions", F.size("positions").alias("freq"))
    if most is None:
        return hits
    return hits.withColumn("__rn", F.row_number().over(Window.partitionBy("i").orderBy("url"))).where(F.col("__rn") <= most).drop("__rn")


def _chain(slots_: Column) -> Column:
    """Whether some start has each given slot's positions one after the other; true for a single slot."""
    shifted = F.transform(slots_, lambda s, i: F.transform(s["positions"], lambda p: p - i))
    first, rest = F.get(shifted, F.lit(0)), F.slice(shifted, 2, 1_000_000)
    return (F.size(slots_) == 1) | (F.size(F.aggregate(rest, first, lambda a, x: F.array_intersect(a, x))) > 0)


def _walk(slots_: Column) -> Column:
    """The looser test: each neighbouring pair of slots has positions p and p + 1, checked pair by pair."""
    following = F.slice(slots_, 2, 1_000_000)
    pairs = F.zip_with(F.slice(slots_, 1, F.greatest(F.size(slots_) - 1, F.lit(0))), following, lambda a, b: F.arrays_overlap(F.transform(a["positions"], lambda p: p + 1), b["positions"]))
    return F.forall(pairs, lambda ok: ok)


def score(hits: DataFrame, n_terms: int, words: DataFrame, ranks: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """``url, matched, exact, near, score`` of every page with a hit.

    ``words`` is ``url, n``, ``ranks`` ``url, rank``. With ``strict`` a phrase is one chain of positions; without it
    neighbouring terms only have to meet pair by pair. Scores are rounded to 6 places.
    """
    any_term = hits.select("url").distinct().agg(F.count("*")).scalar()
    idf = hits.groupBy("i").agg(F.count("*").alias("__n")).select("i", (any_term / F.col("__n")).alias("idf"))
    each = hits.join(F.broadcast(idf), "i").groupBy("url").agg(  # idf has a row per slot
        F.count("*").alias("matched"),
        F.sum(F.col("freq") * F.col("idf")).alias("__tfidf"),
        F.array_sort(F.collect_list(F.struct("i", "positions"))).alias("__slots"),  # at most one entry per slot
    )
    fits = (_chain if strict else _walk)(F.col("__slots"))
    exact = (F.col("matched") == n_terms) & fits
    near = (F.col("matched") == n_terms - 1) & fits
    hubs = sum((F.contains("url", F.lit(h)).cast("int") for h in HUBS[1:]), F.contains("url", F.lit(HUBS[0])).cast("int"))
    out = each.join(words.select("url", F.col("n").alias("__words")), "url", "left")
    out = out.join(ranks.select("url", F.col("rank").alias("__rank")), "url", "left") if ranks is not None else out.withColumn("__rank", F.lit(None).cast("double"))
    value = 1000 * F.col("__tfidf") / F.coalesce(F.nullif("__words", F.lit(0)), F.lit(UNKNOWN_WORDS)) + F.coalesce("__rank", hubs.cast("double")) + F.when(exact, EXACT).when(near, NEAR).otherwise(0)
    return out.select("url", F.col("matched").cast("int").alias("matched"), exact.alias("exact"), near.alias("near"), F.round(value, 6).alias("score"))


def best(scored: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first results: most terms, then score, then url."""
    return scored.orderBy(F.desc("matched"), F.desc("score"), F.asc("url")).limit(most)


def search(found: DataFrame, words: DataFrame, query: str, ranks: DataFrame | None = None, strict: bool = True, most: int | None = CANDIDATES) -> DataFrame:
    """The best results of a query over ``found`` (``url, word, positions``); an empty query or no hit gives none."""
    terms = parse_query(query)
    hits = cut(candidates(found, found.sparkSession, terms, most))  # counted, weighed and scored
    return best(score(hits, len(terms), words, ranks, strict))


def with_fallback(content: Column) -> Column:
    """A preview, or what stands in for one that isn't there."""
    return F.coalesce(F.nullif(content, F.lit("")), F.lit(NO_PREVIEW))


def preview(page: Column, first: Column) -> Column:
    """Words around the first hit (a position from 1), punctuation dropped, case kept."""
    words = F.split(F.regexp_replace(F.regexp_replace(page, PUNCTUATION, " "), r"\s+$", ""), r"\s+", -1)
    start = F.greatest(first - BEFORE, F.lit(0))
    return F.array_join(F.slice(words, start + 1, F.least(first + AFTER, F.size(words)) - start), " ")


def as_json(results: DataFrame, *columns: str) -> DataFrame:
    """``json``: one text ``{"results": [...]}``; of no rows an empty list. For a page of results, which is bounded."""
    rows = results.select(F.struct("place", F.struct(*columns).alias("r")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select(F.to_json(F.struct(F.transform("xs", lambda x: x["r"]).alias("results"))).alias("json"))


def image_search(index: DataFrame, images: DataFrame, query: str, most: int = 10) -> DataFrame:
    """``url, alt, n``: images of the first term by number of positions, then url; ``index`` is ``word, url, positions``."""
    term = (parse_query(query) or [""])[0]
    hits = index.where((F.col("word") == term) & F.col("url").startswith("http") & F.col("url").rlike(r"\.(?:jpg|jpeg|png)$"))
    counted = hits.groupBy("url").agg(F.max(F.size("positions")).alias("n"))
    named = counted.join(images.select("url", "alt"), "url", "left").withColumn("alt", F.coalesce("alt", F.lit("No alt text available")))
    return named.orderBy(F.desc("n"), "url").limit(most)
