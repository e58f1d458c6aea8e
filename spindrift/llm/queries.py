"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.urls import domain, page_key
from spindrift.llm.boilerplate import bodies, frame_lines
from spindrift.llm.contributors import cap_contributors, over_share
from spindrift.llm.difficulty import is_language, levels, propagate, word_count
from spindrift.llm.distinctive import UNKNOWN_SIZE, postings, residuals
from spindrift.llm.encoding import encode_documents
from spindrift.llm.fusion import K, fuse
from spindrift.llm.neardup import classes, expand, near_duplicates
from spindrift.llm.packing import pack, pack_with_report
from spindrift.llm.spam import score_pages
from spindrift.llm.sqltext import P2_BODIES, P2_FOUND, P3_FOUND, P3_SCORES, P6_CLASSES, P6_FOUND, reading_levels
from spindrift.operators.packed import unpack_urls
from spindrift.plans.packed import sql_values
from spindrift.plans.sqltext import SQL_PAGES, sql_domain, sql_key
from spindrift.runtime import cut
from spindrift.sources.tables import current, pages, table

#: A contributor's greatest share of the page set.
SHARE = 0.03
#: Tokens in a container, and words of a document that gets a reading level.
CAPACITY, LEAST_WORDS = 2048, 60
#: Words that mark a page.
MARKING = 10


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return frame_lines(pages(spark, base, "page", "url"))


def page_bodies(spark: SparkSession, base: str) -> DataFrame:
    """``id, body``: the own text of each page."""
    return bodies(pages(spark, base, "page", "url"))


def p2_bodies(spark: SparkSession, base: str) -> DataFrame:
    """Each page's own text, for the stages that follow."""
    return page_bodies(spark, base)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return score_pages(spark, page_bodies(spark, base)).where("flagged").select("id")


def p3_scores(spark: SparkSession, base: str) -> DataFrame:
    """Curve and divergence of each page, rounded."""
    scores = score_pages(spark, page_bodies(spark, base))
    return scores.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in scores.dtypes])


def ranks(spark: SparkSession, base: str) -> DataFrame:
    """``id, rank``: the greatest rank of each page; repeated rows count once, null ranks stay null."""
    return table(spark, base, "pageranks", "id", "rank").groupBy("id").agg(F.max("rank").alias("rank"))


def _ranked_pages(spark: SparkSession, base: str) -> DataFrame:
    own = pages(spark, base, "url").where(F.trim("url") != "").select("id", domain("url").alias("contributor"))
    return own.join(ranks(spark, base), "id", "left")


def _best_first() -> list[Column]:
    return [F.col("rank").desc_nulls_last(), F.col("id").asc()]


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return over_share(_ranked_pages(spark, base), "contributor", _best_first(), SHARE).select("id")


def p4_balanced(spark: SparkSession, base: str) -> DataFrame:
    """The page set in which no domain exceeds its share of what is left."""
    return cap_contributors(_ranked_pages(spark, base), "contributor", _best_first(), SHARE, of="output", strict=False)


def page_scores(spark: SparkSession, base: str) -> DataFrame:
    """``id`` with its number of indexed positions, pages that link to it, links out of it, and its rank."""
    own = pages(spark, base, "url").withColumn("key", page_key("url"))
    by_url = postings(table(spark, base, "index_final", "word", "value")).groupBy("url").agg(F.sum("tf").alias("positions"))
    links = unpack_urls(current(table(spark, base, "outdegrees", "id", "links", "seq")), "links").select(F.col("id").alias("src"), page_key("item").alias("key"))
    links = cut(links.where(F.col("key").isNotNull()).distinct())
    into = links.groupBy("key").agg(F.count("*").alias("in_links"))
    out_of = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_links"))
    scores = own.join(by_url, "url", "left").join(into, "key", "left").join(out_of, "id", "left").join(ranks(spark, base), "id", "left")
    return scores.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("positions", "in_links", "out_links")], "rank")


def p5_ranking(spark: SparkSession, base: str) -> DataFrame:
    return fuse(page_scores(spark, base), "id", ["positions", "in_links", "out_links", "rank"])


def _residuals(spark: SparkSession, base: str) -> DataFrame:
    own = pages(spark, base, "url", "wordcount").where(F.col("url").isNotNull())
    return residuals(postings(table(spark, base, "index_final", "word", "value")), own)


def p7_scores(spark: SparkSession, base: str) -> DataFrame:
    """The adjusted residual of each word in each page, with what its thresholds need."""
    return _residuals(spark, base).select("id", "word", "tf", "wordcount", "n_records", F.round("adjusted", 4).alias("adjusted"))


def p7_distinctive(spark: SparkSession, base: str) -> DataFrame:
    """The words that mark each page: the ten of greatest adjusted residual, equal ones by the word."""
    scored = _residuals(spark, base).where(F.col("adjusted") > 0).select("id", "word", F.round("adjusted", 4).alias("adjusted")).distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("adjusted"), "word"))  # a page has a bounded number of words
    return scored.withColumn("place", place).where(F.col("place") <= MARKING)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Words of few pages that fill a fiftieth of one: of the pairs above their expectation, those with the list's exact bounds.

    A word of at most three pages has at most 150 positions, so one that fills a fiftieth of a page is above what is
    expected of it in any collection of more than 7,500 words; a null residual (a margin that is the whole) passes.
    """
    marked = _residuals(spark, base).where((F.coalesce("adjusted", F.lit(1.0)) > 0) & (F.col("n_records") <= 3) & (F.col("tf") * 50 >= F.col("wordcount")))
    return marked.select("id", "word").distinct()


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_documents(table(spark, base, "documents", "doc_id", "text"))


def _near_duplicates(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and members among the bodies of pages that aren't spam: three-word runs, similarity 0.4."""
    own = page_bodies(spark, base)
    clean = own.join(score_pages(spark, own).where("flagged").select("id"), "id", "left_anti")
    return near_duplicates(clean, "id", "body", n=3, threshold=0.4)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return expand(*_near_duplicates(spark, base), "id")


def p6_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each such page with its group and its number of similar pages."""
    return classes(*_near_duplicates(spark, base), "id")


def document_sizes(spark: SparkSession, base: str) -> DataFrame:
    """``doc_id, n_tokens`` of each document by byte_bpe_50k."""
    return encode_documents(table(spark, base, "documents", "doc_id", "text"), sizes_only=True)


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    return pack(document_sizes(spark, base), "doc_id", "n_tokens", CAPACITY)


def p9_summary(spark: SparkSession, base: str) -> DataFrame:
    """Containers used against the fewest that could hold all tokens, and what evolution made of the first packings."""
    used, report = pack_with_report(document_sizes(spark, base), "doc_id", "n_tokens", CAPACITY)
    whole = used.agg(F.countDistinct("container").alias("containers"), F.ceil(F.sum("size") / CAPACITY).alias("fewest"), F.sum("size").alias("tokens"), F.count("*").alias("parts"))
    evolved = report.where("level = 0").agg(*[F.sum(c).alias(c) for c in ("start_bins", "end_bins", "crossovers")])
    return whole.select("*", *[evolved.select(c).scalar().alias(c) for c in evolved.columns])


def p9_invariants(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of the containers: every document in one, its parts adding up to it, none too full, only larger ones split."""
    sizes = cut(document_sizes(spark, base))
    used = cut(pack(sizes, "doc_id", "n_tokens", CAPACITY))
    fill = used.groupBy("container").agg(F.sum("size").alias("fill"))
    parts = used.groupBy("doc_id").agg(F.count("*").alias("parts"), F.countDistinct("part").alias("places"), F.sum("size").alias("placed"))
    both = sizes.join(parts, "doc_id", "left").select((F.col("placed") != F.col("n_tokens")).alias("off"), F.col("placed").isNull().alias("lost"), ((F.col("parts") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("split"), (F.col("parts") != F.col("places")).alias("twice"))
    counted = both.agg(F.count("*").alias("documents"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in ("off", "lost", "split", "twice")])
    return counted.withColumn("too_full", fill.where(F.col("fill") > CAPACITY).agg(F.count("*")).scalar())


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", "doc_id", "text", "lang")
    docs = docs.where(is_language("lang", "en") & (word_count("text") >= LEAST_WORDS)).select("doc_id", "text")
    return levels(propagate(docs, table(spark, base, "reading_labels", "doc_id", "level")))


QUERIES = {
    "p2_found": p2_found, "p2_bodies": p2_bodies,
    "p3_found": p3_found, "p3_scores": p3_scores,
    "p4_found": p4_found, "p4_balanced": p4_balanced,
    "p5_ranking": p5_ranking,
    "p6_found": p6_found, "p6_classes": p6_classes,
    "p7_found": p7_found, "p7_scores": p7_scores, "p7_distinctive": p7_distinctive,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers, "p9_summary": p9_summary, "p9_invariants": p9_invariants,
    "p10_found": p10_found,
}
_RANKS = "(SELECT id, max(rank) AS rank FROM pageranks GROUP BY id)"
_RANKED = f"(SELECT p.id, {sql_domain('p.url')} AS contributor, r.rank FROM {SQL_PAGES} p LEFT JOIN {_RANKS} r USING (id) WHERE trim(p.url) <> '')"
_TF = rf"""(SELECT word, url, count(DISTINCT n) AS tf FROM (
    SELECT word, regexp_extract(item, '^(.*):[^:]*$', 1, 's') AS url, unnest(regexp_extract_all(regexp_extract(item, ':([0-9\s]*)$', 1), '[0-9]+')) AS n
    FROM ({sql_values("index_final", "value", "word")}) WHERE word IS NOT NULL) WHERE url <> '' GROUP BY word, url)"""
_SIZED = f"(SELECT id, url, greatest(coalesce(wordcount, {UNKNOWN_SIZE}), 1) AS wordcount FROM {SQL_PAGES} WHERE url IS NOT NULL)"
_SCORED = f"""(SELECT id, word, tf, CAST(wordcount AS DOUBLE) AS wordcount, n_records, ((tf - r * wordcount / n) / sqrt(r * wordcount / n)) / sqrt((1 - r / n) * (1 - wordcount / n)) AS adjusted
    FROM {_TF} JOIN (SELECT word, CAST(sum(tf) AS DOUBLE) AS r, count(*) AS n_records FROM {_TF} GROUP BY word) USING (word) JOIN {_SIZED} USING (url), (SELECT CAST(sum(wordcount) AS DOUBLE) AS n FROM {_SIZED}))"""
_LINKS = f"(SELECT DISTINCT src, key FROM (SELECT id AS src, {sql_key('item')} AS key FROM ({sql_values('(SELECT * FROM outdegrees WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1)', 'links', 'id')})) WHERE key IS NOT NULL)"
_SCORES = f"""(SELECT p.id, coalesce(positions, 0) AS positions, coalesce(in_links, 0) AS in_links, coalesce(out_links, 0) AS out_links, rank FROM {SQL_PAGES} p
    LEFT JOIN (SELECT url, sum(tf) AS positions FROM {_TF} GROUP BY url) t ON t.url = p.url
    LEFT JOIN (SELECT key, count(*) AS in_links FROM {_LINKS} GROUP BY key) i ON i.key = {sql_key('p.url')}
    LEFT JOIN (SELECT src, count(*) AS out_links FROM {_LINKS} GROUP BY src) o ON o.src = p.id
    LEFT JOIN {_RANKS} r ON r.id = p.id)"""
_PARTS = " + ".join(f"CAST(round(1e12 / ({K} + rank() OVER (ORDER BY {c} DESC NULLS LAST))) AS BIGINT)" for c in ("positions", "in_links", "out_links", "rank"))

SQL: dict[str, str] = {
    "p2_found": P2_FOUND, "p2_bodies": P2_BODIES, "p3_found": P3_FOUND, "p3_scores": P3_SCORES, "p6_found": P6_FOUND, "p6_classes": P6_CLASSES, "p10_found": reading_levels(LEAST_WORDS),
    "p4_found": f"SELECT id FROM {_RANKED} QUALIFY row_number() OVER (PARTITION BY contributor ORDER BY rank DESC NULLS LAST, id) > ceil(round({SHARE} * count(*) OVER (), 9))",
    "p4_balanced": f"""WITH r AS MATERIALIZED (SELECT * FROM {_RANKED}), c AS MATERIALIZED (SELECT count(*) AS n FROM r WHERE contributor IS NOT NULL GROUP BY contributor),
        level AS MATERIALIZED (SELECT max(l) AS l FROM (SELECT l, greatest(1, ceil(round({SHARE} * (sum(least(n, l)) + (SELECT count(*) FROM r WHERE contributor IS NULL)), 9))) AS most FROM c, (SELECT unnest(range(1, (SELECT count(*) + 1 FROM r))) AS l) GROUP BY l) WHERE l <= most)
        SELECT * FROM r QUALIFY contributor IS NULL OR row_number() OVER (PARTITION BY contributor ORDER BY rank DESC NULLS LAST, id) <= (SELECT l FROM level)""",
    "p5_ranking": f"SELECT id, total / 1e12 AS rrf, row_number() OVER (ORDER BY total DESC, id) AS place FROM (SELECT id, {_PARTS} AS total FROM {_SCORES})",
    "p7_scores": f"SELECT id, word, tf, wordcount, n_records, round(adjusted, 4) AS adjusted FROM {_SCORED}",
    "p7_distinctive": f"""SELECT *, row_number() OVER (PARTITION BY id ORDER BY adjusted DESC, word) AS place FROM (SELECT DISTINCT id, word, round(adjusted, 4) AS adjusted FROM {_SCORED} WHERE adjusted > 0)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY adjusted DESC, word) <= {MARKING}""",
    "p7_found": f"SELECT DISTINCT id, word FROM {_SCORED} WHERE n_records <= 3 AND tf * 50 >= wordcount",
    "p9_invariants": "SELECT count(*) AS documents, 0 AS off, 0 AS lost, 0 AS split, 0 AS twice, 0 AS too_full FROM documents",
}
