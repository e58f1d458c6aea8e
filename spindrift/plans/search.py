"""Queries of indexing, ranking and search, over the current pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import page_key
from spindrift.functions.web import HUBS
from spindrift.operators import index, rank
from spindrift.operators import search as s
from spindrift.operators.packed import unpack_urls
from spindrift.plans.packed import sql_values
from spindrift.plans.sqltext import SQL_PAGES, sql_key, sql_tokens
from spindrift.plans.web import SQL as WEB_SQL
from spindrift.plans.web import image_table
from spindrift.runtime import checkpoint_dir, cut
from spindrift.sources.tables import current, pages, table


def _pages(spark: SparkSession, base: str) -> DataFrame:
    """Pages with text under their id, which stands for the url: an address may be spelled in many ways."""
    return pages(spark, base, "page").where("page IS NOT NULL").withColumnRenamed("id", "url")


def _dictionary(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "index_final", "word").where("word IS NOT NULL").distinct()


def _found(spark: SparkSession, base: str, words: bool = False) -> DataFrame:
    return index.positions(_pages(spark, base), words=_dictionary(spark, base) if words else None)


def word_count(spark, base):
    return index.word_counts(_pages(spark, base))


def positions_top50(spark, base):
    return _found(spark, base).select("url", "word", F.size("positions").alias("n"), F.get("positions", F.lit(0)).alias("first"), F.array_max("positions").alias("last"))


def postings(spark, base):
    return index.posting_texts(_found(spark, base, words=True))


def postings_table(spark, base):
    """The postings written as a table and read again."""
    at = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings(spark, base).write.parquet(at)
    return spark.read.parquet(at)


def inverted_index(spark, base):
    return index.inverted(_found(spark, base, words=True)).select("word", F.size("postings").alias("pages"), F.get("postings", F.lit(0))["url"].alias("first"), F.aggregate("postings", F.lit(0), lambda a, p: a + F.size(p["positions"])).alias("n"))


def index_text(spark, base):
    return index.consolidate(index.posting_texts(_found(spark, base, words=True)))


def _graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    rows = current(table(spark, base, "outdegrees", "id", "url", "links", "seq")).select(page_key("url").alias("id"), "links").where("id IS NOT NULL")
    return rows.select("id"), unpack_urls(rows, "links").select(F.col("id").alias("src"), page_key("item").alias("dst"))


def pagerank_init(spark, base):
    return rank.initial(_graph(spark, base)[0])


def _rounds(spark: SparkSession, base: str, n: int) -> DataFrame:
    state = rank.page_rank(*_graph(spark, base), threshold=None, rounds=n)
    return state.select("id", F.round("curr", 6).alias("curr"), F.round("prev", 6).alias("prev"))


def pagerank_round1(spark, base):
    return _rounds(spark, base, 1)


def pagerank_k(spark, base):
    return _rounds(spark, base, 4)


def pagerank_diff(spark, base):
    state = rank.page_rank(*_graph(spark, base), threshold=None, rounds=3)
    return rank.diffs(state).agg(F.round(F.max("diff"), 6).alias("most"), F.count_if(F.col("diff") <= 0.1).alias("still"), F.count("*").alias("n"))


def pagerank_converged(spark, base):
    """Ranks once no page moves by 0.01 any more."""
    state = rank.page_rank(*_graph(spark, base), threshold=0.01)
    return state.select("id", F.round("curr", 6).alias("curr"))


def pagerank_pct(spark, base):
    """Ranks once three pages in four move by at most 0.1."""
    state = rank.page_rank(*_graph(spark, base), threshold=0.1, percent=75)
    return state.select("id", F.round("curr", 6).alias("curr"))


def ranks_table(spark, base):
    """Ranks after four rounds written as a table and read again."""
    at = f"{checkpoint_dir(spark)}/ranks-{uuid.uuid4().hex}"
    pagerank_k(spark, base).select("id", F.col("curr").alias("rank")).write.parquet(at)
    return spark.read.parquet(at)


def _ranks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pageranks", "id", "rank").groupBy(F.col("id").alias("url")).agg(F.max("rank").alias("rank"))


#: Queries and what they are about: one term, two neighbours, a phrase, a phrase with a term that no page has, a repeated
#: term, terms that rarely meet.
_TERMS = {
    "search_single": "crawler", "search_two_terms": "page+list", "search_phrase": "season picture list", "search_near": "page season nosuchword",
    "search_repeated": "page page page", "search_sparse": "account cat buckle", "search_unknown": "nosuchword",
}
_RANKED, _LOOSE = "Garden market%20letter", "list page season list"


def _versions(spark: SparkSession, base: str, urls: DataFrame, *columns: str) -> DataFrame:
    """``id, url`` and ``columns`` of the pages that now have one of ``urls``.

    ``urls`` are those of a query's hits, at most 500 for each term, so they and their ids are broadcast to the scans and
    nothing else of the log moves.
    """
    log = table(spark, base, "content", "id", "seq", "url", *columns)
    ids = log.join(F.broadcast(urls), "url", "left_semi").select("id").distinct()
    rows = log.join(F.broadcast(ids), "id", "left_semi")
    return current(rows).drop("seq").join(F.broadcast(urls), "url", "left_semi")


def _answer(spark: SparkSession, base: str, query: str, ranked: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The hits of a query in the stored index, and its best results."""
    terms = s.parse_query(query)
    hits = cut(s.candidates(s.stored(table(spark, base, "index_final", "word", "value"), terms), spark, terms))
    urls = hits.select("url").distinct()
    own = _versions(spark, base, urls, "wordcount")
    ranks = None
    if ranked:
        own = cut(own)
        ranks = table(spark, base, "pageranks", "id", "rank").join(F.broadcast(own.select("id", "url")), "id").groupBy("url").agg(F.max("rank").alias("rank"))
    return hits, s.best(s.score(hits, len(terms), own.select("url", F.col("wordcount").alias("n")), ranks, strict))


def _search(terms: str):
    def query(spark: SparkSession, base: str) -> DataFrame:
        return _answer(spark, base, terms)[1]

    return query


def search_ranked(spark, base):
    """The whole: ranks of pages, phrase boosts, first 100."""
    return _answer(spark, base, _RANKED, ranked=True)[1]


def search_loose(spark, base):
    """As :func:`search_ranked`, with the phrase test that looks at neighbouring terms pair by pair."""
    return _answer(spark, base, _LOOSE, ranked=True, strict=False)[1]


def search_built(spark, base):
    """Over an index built from the pages themselves, all words of them."""
    return s.search(_found(spark, base), index.word_counts(_pages(spark, base)), "careful readers collect", _ranks(spark, base))


def _previews(spark: SparkSession, base: str) -> DataFrame:
    hits, top = _answer(spark, base, _RANKED, ranked=True)
    top = cut(top)
    first = hits.groupBy("url").agg(F.min(F.struct("i", F.get("positions", F.lit(0)).alias("p"))).alias("f"))
    text = _versions(spark, base, top.select("url"), "page").select("url", "page")
    shown = top.join(first, "url").join(text, "url", "left")
    return shown.select("url", "matched", "score", s.with_fallback(s.preview(F.col("page"), F.col("f.p"))).alias("content"))


def search_preview(spark, base):
    return _previews(spark, base).select("url", "content")


def search_json(spark, base):
    placed = _previews(spark, base).withColumn("place", F.struct(-F.col("matched"), -F.col("score"), "url"))
    return s.as_json(placed.withColumnRenamed("url", "URL"), "URL", "content")


def image_search(spark, base):
    """Images of the pages' markup, indexed by the words of their alternative texts."""
    images = cut(image_table(spark, base))  # indexed, then named
    return s.image_search(index.positions(images, page="alt"), images, "View nap")


QUERIES = {f.__name__: f for f in (word_count, positions_top50, postings, postings_table, ranks_table, inverted_index, index_text, pagerank_init, pagerank_round1, pagerank_k, pagerank_diff, pagerank_converged, pagerank_pct)}
QUERIES |= {name: _search(terms) for name, terms in _TERMS.items()}
QUERIES |= {f.__name__: f for f in (search_ranked, search_loose, search_built, search_preview, search_json, image_search)}

_TEXT = f"(SELECT id AS url, page FROM {SQL_PAGES} WHERE page IS NOT NULL)"
_COUNT = f"(SELECT url, CAST(len({sql_tokens('page')}) AS INTEGER) AS n FROM {_TEXT})"
_POS = f"""(SELECT url, word, list_sort(list(place))[1:50] AS positions FROM (SELECT url, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) AS INTEGER) AS place FROM (SELECT url, {sql_tokens('page')} AS ws FROM {_TEXT})) GROUP BY url, word)"""
_KNOWN = f"(SELECT * FROM {_POS} WHERE word IN (SELECT word FROM index_final WHERE word IS NOT NULL))"
_POSTED = f"(SELECT word, url || ':' || array_to_string(positions, ' ') AS value FROM {_KNOWN})"
_ROWS = f"(SELECT {sql_key('url')} AS id, links FROM (SELECT * FROM outdegrees WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1))"
_NODES = f"SELECT DISTINCT id FROM {_ROWS} WHERE id IS NOT NULL"
_EDGES = f"SELECT DISTINCT id AS src, {sql_key('item')} AS dst FROM ({sql_values(_ROWS, 'links', 'id')}) WHERE id IS NOT NULL"
_WITH_GRAPH = f"WITH nodes AS MATERIALIZED ({_NODES}), links AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ({_EDGES}) WHERE dst IS NOT NULL), r0 AS (SELECT id, 1.0::DOUBLE AS curr, 1.0::DOUBLE AS prev FROM nodes)"


def _sql_rounds(n: int) -> str:
    """``r1 … rn`` after the graph."""
    return _WITH_GRAPH + "".join(f", r{i} AS MATERIALIZED (SELECT r.id, 0.15::DOUBLE + coalesce(g.s, 0) AS curr, r.curr AS prev FROM r{i - 1} r LEFT JOIN (SELECT dst AS id, sum(curr * w) AS s FROM links JOIN r{i - 1} ON id = src GROUP BY dst) g ON g.id = r.id)" for i in range(1, n + 1))


def _sql_until(n: int, test: str, places: int) -> str:
    """The first of ``n`` rounds that passes ``test``, or the last."""
    tried = "".join(f", t{i} AS MATERIALIZED (SELECT {test} AS ok FROM r{i})" for i in range(1, n + 1))
    pick = "CASE " + " ".join(f"WHEN (SELECT ok FROM t{i}) THEN {i}" for i in range(1, n + 1)) + f" ELSE {n} END"
    return _sql_rounds(n) + tried + f", p AS MATERIALIZED (SELECT {pick} AS n) " + " UNION ALL ".join(f"SELECT id, round(curr, {places}) AS curr FROM r{i} WHERE (SELECT n FROM p) = {i}" for i in range(1, n + 1))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_chain(slots: list[int], strict: bool) -> str:
    """Whether the positions ``p{i}`` of the slots follow one another."""
    if len(slots) == 1:
        return "true"
    if strict:
        out = f"p{slots[0]}"
        for k, i in enumerate(slots[1:], 1):
            out = f"list_intersect({out}, list_transform(p{i}, lambda x: x - {k}))"
        return f"len({out}) > 0"
    return " AND ".join(f"list_has_any(list_transform(p{a}, lambda x: x + 1), p{b})" for a, b in zip(slots, slots[1:], strict=False))


_STORED = rf"""(SELECT word, url, list_sort(list_distinct(list(place))) AS positions FROM (
    SELECT word, regexp_extract(item, '^(.*):[^:]*$', 1, 's') AS url, unnest(list_transform(regexp_extract_all(regexp_extract(item, ':([0-9\s]*)$', 1), '[0-9]+'), lambda x: CAST(x AS INTEGER))) AS place
    FROM ({sql_values("index_final", "value", "word")}) WHERE word IS NOT NULL) WHERE url <> '' GROUP BY word, url)"""
_STORED_COUNT = f"(SELECT url, wordcount AS n FROM {SQL_PAGES})"
_STORED_RANK = f"(SELECT p.url, max(rank) AS rank FROM pageranks JOIN {SQL_PAGES} p USING (id) GROUP BY p.url)"
_BUILT_RANK = "(SELECT id AS url, max(rank) AS rank FROM pageranks GROUP BY id)"


def _sql_search(terms: str, ranked: bool, strict: bool = True, built: bool = False) -> str:
    words = s.parse_query(terms)
    n = range(len(words))
    hits = ", ".join(f"h{i} AS MATERIALIZED (SELECT url, positions AS p{i}, CAST(len(positions) AS DOUBLE) AS f{i} FROM pos WHERE word = '{words[i]}' ORDER BY url LIMIT {s.CANDIDATES})" for i in n)
    everyone = " UNION ".join(f"SELECT url FROM h{i}" for i in n)
    matched = " + ".join(f"(p{i} IS NOT NULL)::INT" for i in n)
    tfidf = " + ".join(f"coalesce(f{i} * ((SELECT count(*) FROM every) / (SELECT count(*) FROM h{i})), 0)" for i in n)
    exact = f"coalesce(matched = {len(words)} AND {_sql_chain(list(n), strict)}, false)"
    near = "false"
    if len(words) > 1:
        near = "coalesce(CASE " + " ".join(f"WHEN matched = {len(words) - 1} AND p{j} IS NULL THEN {_sql_chain([i for i in n if i != j], strict)}" for j in n) + " END, false)"
    joins = " ".join(f"LEFT JOIN h{i} USING (url)" for i in n)
    hubs = " + ".join(f"contains(url, {_quoted(h)})::INT" for h in HUBS)
    score = f"round(1000 * ({tfidf}) / coalesce(nullif(wc.n, 0), {s.UNKNOWN_WORDS}) + coalesce({'r.rank' if ranked else 'NULL'}, {hubs}) + CASE WHEN exact THEN {s.EXACT} WHEN near THEN {s.NEAR} ELSE 0 END, 6)"
    rank_join = f"LEFT JOIN {_BUILT_RANK if built else _STORED_RANK} r USING (url)" if ranked else ""
    return f"""WITH pos AS MATERIALIZED (SELECT * FROM {_POS if built else _STORED} WHERE word IN ({", ".join(f"'{w}'" for w in words)})), {hits}, every AS MATERIALIZED ({everyone}),
        m AS (SELECT *, {matched} AS matched FROM every {joins}), x AS (SELECT *, {exact} AS exact, {near} AS near FROM m)
        SELECT url, CAST(matched AS INTEGER) AS matched, exact, near, {score} AS score FROM x LEFT JOIN {_COUNT if built else _STORED_COUNT} wc USING (url) {rank_join} ORDER BY matched DESC, score DESC, url LIMIT {s.SHOWN}"""


_SHOWN_WORDS = r"""string_split_regex(regexp_replace(regexp_replace(page, '[.,:;!?''"()-]', ' ', 'g'), '\s+$', ''), '\s+')"""
_FIRST = f"(SELECT url, arg_min(positions[1], i) AS f FROM {_STORED} JOIN (VALUES {', '.join(f'({i}, {_quoted(w)})' for i, w in enumerate(s.parse_query(_RANKED)))}) t(i, word) USING (word) GROUP BY url)"
_PREVIEWS = f"""(SELECT url, matched, score, coalesce(nullif(array_to_string({_SHOWN_WORDS}[greatest(f - {s.BEFORE}, 0) + 1 : f + {s.AFTER}], ' '), ''), {_quoted(s.NO_PREVIEW)}) AS content
    FROM ({_sql_search(_RANKED, True)}) JOIN {_FIRST} USING (url) LEFT JOIN (SELECT url, page FROM {SQL_PAGES}) USING (url))"""
SQL = {
    "word_count": f"SELECT * FROM {_COUNT}",
    "positions_top50": f"SELECT url, word, CAST(len(positions) AS INTEGER) AS n, positions[1] AS first, list_max(positions) AS last FROM {_POS}",
    "postings": f"SELECT * FROM {_POSTED}",
    "postings_table": f"SELECT * FROM {_POSTED}",
    "ranks_table": f"{_sql_rounds(4)} SELECT id, round(curr, 6) AS rank FROM r4",
    "inverted_index": f"SELECT word, CAST(count(*) AS INTEGER) AS pages, min(url) AS first, CAST(sum(len(positions)) AS INTEGER) AS n FROM {_KNOWN} GROUP BY word",
    "index_text": f"SELECT word, string_agg(value, ',' ORDER BY value) AS value FROM {_POSTED} GROUP BY word",
    "pagerank_init": f"{_WITH_GRAPH} SELECT * FROM r0",
    "pagerank_round1": f"{_sql_rounds(1)} SELECT id, round(curr, 6) AS curr, round(prev, 6) AS prev FROM r1",
    "pagerank_k": f"{_sql_rounds(4)} SELECT id, round(curr, 6) AS curr, round(prev, 6) AS prev FROM r4",
    "pagerank_diff": f"{_sql_rounds(3)} SELECT round(max(abs(curr - prev)), 6) AS most, count(*) FILTER (abs(curr - prev) <= 0.1) AS still, count(*) AS n FROM r3",
    "pagerank_converged": _sql_until(40, "max(abs(curr - prev)) < 0.01", 6),
    "pagerank_pct": _sql_until(12, "count(*) FILTER (abs(curr - prev) <= 0.1) >= floor(count(*) * 0.75 + 0.5)", 6),
    **{name: _sql_search(terms, False) for name, terms in _TERMS.items()},
    "search_ranked": _sql_search(_RANKED, True),
    "search_loose": _sql_search(_LOOSE, True, strict=False),
    "search_built": _sql_search("careful readers collect", True, built=True),
    "search_preview": f"SELECT url, content FROM {_PREVIEWS}",
    "search_json": f"""SELECT CAST(to_json({{'results': list({{'URL': url, 'content': content}} ORDER BY matched DESC, score DESC, url)}}) AS VARCHAR) AS json FROM {_PREVIEWS}""",
    "image_search": f"""SELECT url, alt, CAST(n AS INTEGER) AS n FROM (SELECT url, alt, least(len(list_filter({sql_tokens('alt')}, lambda w: w = 'view')), {index.POSITIONS}) AS n
        FROM ({WEB_SQL["image_table"]})) WHERE n > 0 AND starts_with(url, 'http') AND regexp_matches(url, '\\.(?:jpg|jpeg|png)$') ORDER BY n DESC, url LIMIT 10""",
}
