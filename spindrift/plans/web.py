"""Queries of the crawl and text operators, over the crawl log, the hosts, the link lists and pages set in HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text, web
from spindrift.functions.hashing import letter_hash
from spindrift.functions.urls import host, page_key
from spindrift.operators import crawl
from spindrift.operators.packed import unpack_urls
from spindrift.plans.packed import sql_values
from spindrift.plans.sqltext import SQL_PAGES, sql_host, sql_key
from spindrift.runtime import cut
from spindrift.sources.tables import current, pages, table

#: What a page is set in, so that the HTML operators run over whole texts.
_BEFORE = '<html><head><style type="text/css">p { margin: 0 }</style><script>var a = "<b>";\nvar c = 1;</script></head><body><h1>'
#: Markup after the text, one form for each remainder of the id's length and last letter; ``{0}`` is the page's id.
_AFTERS = (
    '</h1><p>Read <a class="x" href="/next/{0}.html#top">the next</a> or <A HREF=\'../up/{0}\'>above</A>, <a href="picture.png">look</a></p><img src="/i/{0}.jpg" alt="view of {0}"><img src=/i/{0}.jpg alt="again"></body></html>',
    "</h1><a href=../../far/{0}?q=1>far away</a> <a href=\"Report.PDF\">report</a><a href=\"#end\">end</a><IMG alt=\"A view\" SRC='http://pictures.test/{0}.png'><img src=\"/icon.gif\"></body></html>",
    '</h1><a href="//mirror.test/{0}">mirror</a><a title="t" href="next.html" rel="n">  next  </a><a href="/Photo.JpG">photo</a><img src="/i/{0}.jpeg" alt="first view"><img src="/i/{0}.jpeg" alt="second view"></body></html>',
    '</h1><p>No way on.</p><a name="here">here</a><img alt="nothing"></body></html>',
)


def _html(spark: SparkSession, base: str) -> DataFrame:
    own = pages(spark, base, "url", "page").where("page IS NOT NULL AND url IS NOT NULL")
    form = F.ascii(F.substring("id", -1, 1)) % len(_AFTERS)
    after = F.replace(F.element_at(F.array(*[F.lit(x) for x in _AFTERS]), form + 1), F.lit("{0}"), F.col("id"))
    return own.select("id", "url", F.concat(F.lit(_BEFORE), F.replace("page", F.lit("<"), F.lit(" ")), after).alias("html"))


def _links(spark: SparkSession, base: str) -> DataFrame:
    """``id, url, pos, item``: the links of the current rows."""
    return unpack_urls(current(table(spark, base, "outdegrees", "id", "url", "links", "seq")).drop("seq"), "links")


def hash_key(spark, base):
    return table(spark, base, "crawl", "url").distinct().select("url", letter_hash("url").alias("hash"))


def parse_url_parts(spark, base):
    return table(spark, base, "crawl", "url").distinct().select("url", web.url_parts("url").alias("p")).select("url", "p.scheme", "p.host", "p.port", "p.path")


def url_hosts(spark, base):
    return table(spark, base, "crawl", "url").distinct().select("url", host("url").alias("h"), page_key("url").alias("k"))


def normalize_links(spark, base):
    return _links(spark, base).select("id", "pos", web.normalize("item", "url").alias("link"))


def normalize_relative(spark, base):
    """Links of every form against every page of the link table."""
    forms = F.array(*[F.lit(x) for x in ("/a/b?c", "d.html", "../e", "../../../../../../f", "..", "//x.test/y", "//x.test/y?q=1", "", "?q=2")])
    bases = current(table(spark, base, "outdegrees", "id", "url", "seq")).where("url IS NOT NULL").select("url")
    return bases.select("url", F.explode(forms).alias("link")).select("url", "link", web.normalize("link", "url").alias("whole")).groupBy("link").agg(F.count("whole").alias("n"), F.sum(F.length("whole")).alias("chars"), F.min("whole").alias("first"), F.max("whole").alias("last"))


def strip_html(spark, base):
    return _html(spark, base).select("id", text.strip_html("html").alias("body"))


def extract_links(spark, base):
    return text.anchors(_html(spark, base), "html", "id", "url").select("id", "pos", web.normalize("href", "url").alias("link"), "anchor")


def out_links(spark, base):
    found = text.anchors(_html(spark, base), "html", "id", "url").select("id", web.normalize("href", "url").alias("link"))
    return found.where("link IS NOT NULL").distinct().groupBy("id").agg(F.concat_ws(",", F.array_sort(F.collect_list("link"))).alias("links"))


def anchor_text(spark, base):
    return text.anchor_texts(text.anchors(_html(spark, base), "html", "id"), "id")


def extract_images(spark, base):
    return text.alt_texts(text.images(_html(spark, base), "html", "id"), "id", "src")


def image_table(spark, base):
    """Each image under its whole address, with the texts that pages give it."""
    found = text.images(_html(spark, base), "html", "id", "url").withColumn("src", web.normalize("src", "url")).where("src IS NOT NULL")
    texts = found.where("alt <> ''").groupBy("src").agg(F.concat_ws(" ", F.array_sort(F.collect_set("alt"))).alias("alt"))  # one image's texts
    return found.select("src").distinct().join(texts, "src", "left").select(letter_hash("src").alias("id"), F.col("src").alias("url"), F.coalesce("alt", F.lit("")).alias("alt"))


def robots_allow(spark, base):
    """Crawled paths that their host's rules allow or forbid."""
    rules = table(spark, base, "hosts", "host", "robots").where("robots IS NOT NULL").distinct().select("host", web.robots_rules("robots").alias("rules"))
    seen = table(spark, base, "crawl", "id", "host", "url").distinct().select("id", "host", web.url_parts("url")["path"].alias("path"))
    return seen.join(rules, "host").select("id", web.robots_allow("path", "rules").alias("allowed"))


def robots_own_rules(spark, base):
    return table(spark, base, "hosts", "host", "robots").distinct().select("host", F.coalesce("robots", F.lit("")).alias("robots"), F.concat_ws("|", web.robots_rules("robots")).alias("rules"))


def robots_agent_rules(spark, base):
    """The rules that hold for the robot that a host names, or for any where it names none."""
    named = F.regexp_extract("robots", r"User-agent: ([^*\n]+)\n", 1)
    return table(spark, base, "hosts", "host", "robots").where("robots IS NOT NULL").distinct().select("host", named.alias("agent"), F.concat_ws("|", web.robots_rules("robots", named)).alias("rules"))


def blacklist_filter(spark, base):
    """Crawled urls that no pattern of the blacklist table fits."""
    return web.not_blocked(table(spark, base, "crawl", "url").distinct(), "url", web.blocked_patterns(blacklist_table(spark, base)))


def blacklist_table(spark, base):
    return spark.createDataFrame([(p,) for p in web.BLOCKED], "pattern string").select(letter_hash("pattern").alias("id"), "pattern")


def allowed_suffix(spark, base):
    return table(spark, base, "crawl", "url").distinct().where(web.followed("url", ("example", "test"))).select("url")


def domain_quota(spark, base):
    seen = current(table(spark, base, "crawl", "id", "host", "seq")).where("host IS NOT NULL").withColumn("domain", web.root_domain("host"))
    return crawl.within_quota(seen, "domain", [F.col("seq").asc(), F.col("id").asc()], web.page_cap("domain")).select("id", "domain")


def frontier_bfs(spark, base):
    links = _links(spark, base).select(page_key("url").alias("src"), page_key("item").alias("dst"))
    seeds = pages(spark, base, "url").select(page_key("url").alias("id")).where("id IS NOT NULL").orderBy("id").limit(3)
    return crawl.frontier(seeds, links)


def _site(spark: SparkSession, base: str) -> DataFrame:
    """What a fetch finds at each address of the link table: its links as anchors, in order."""
    rows = _links(spark, base).where("url IS NOT NULL").groupBy("id", "url").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("links"))  # one page's links
    html = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a href="'), x["item"], F.lit('">to</a>'))), "\n")
    return rows.select(web.normalize("url", F.lit("http://x/")).alias("url"), F.lit(200).alias("responsecode"), html.alias("html"), F.lit(None).cast("string").alias("redirecturl")).where("url IS NOT NULL").dropDuplicates(["url"])


def crawl_run(spark, base):
    """A whole crawl of the link table from its first three pages, under the hosts' rules and the blacklist, with the round of each page."""
    site = cut(_site(spark, base))
    seeds = site.select("url").orderBy("url").limit(3)
    rules = table(spark, base, "hosts", "host", "robots")
    fetched, _ = crawl.run(seeds, lambda queue: queue.join(site, "url", "left"), rules, blacklist_table(spark, base), ("example", "test", "invalid"), quota=10_000)
    return fetched.select("url", "round", F.coalesce(F.col("responsecode") == 200, F.lit(False)).alias("found"))


def host_gap(spark, base):
    seen = table(spark, base, "crawl", "id", "host", "fetched_at", "seq").distinct()
    return crawl.too_soon(seen, "host", "fetched_at", [F.col("fetched_at").asc(), F.col("seq").asc(), F.col("id").asc()], 10_000).select("id", "seq", "gap_ms")


def redirect_targets(spark, base):
    return crawl.redirects(table(spark, base, "crawl").distinct()).select("id", "seq", web.normalize("redirecturl", "url").alias("target"))


def unseen_links(spark, base):
    links = _links(spark, base).select(F.col("item").alias("url")).distinct().withColumn("id", letter_hash("url"))
    return crawl.unseen(links, table(spark, base, "crawl", "id", "responsecode")).select("id", "url")


QUERIES = {f.__name__: f for f in (
    hash_key, parse_url_parts, url_hosts, normalize_links, normalize_relative, strip_html, extract_links, out_links, anchor_text,
    extract_images, robots_allow, robots_own_rules, robots_agent_rules, image_table, blacklist_filter, blacklist_table, allowed_suffix, domain_quota, frontier_bfs, crawl_run,
    host_gap, redirect_targets, unseen_links,
)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_hash(x: str) -> str:
    byte = f"CAST('0x' || substr(sha1({x}), 2 * i - 1, 2) AS INTEGER)"
    at = f"(CASE WHEN {byte} = 0 THEN 255 WHEN {byte} < 128 THEN {byte} ELSE {byte} - 1 END)"
    return f"array_to_string(list_transform(range(1, 21), lambda i: chr(CAST(97 + {at} % 26 AS INTEGER)) || substr('acegikmoqs', 1 + {at} // 26, 1)), '')"


def _sql_part(url: str) -> dict[str, str]:
    inner = f"regexp_extract({url}, '^[^/]*//([^/]*)', 1)"
    path = f"regexp_extract({url}, '^[^/]*//[^/]*(/.*)$', 1, 's')"
    return {
        "scheme": f"regexp_extract({url}, '^(.*?).//', 1)",
        "host": f"CASE WHEN strpos({inner}, ':') > 1 THEN split_part({inner}, ':', 1) ELSE {inner} END",
        "port": f"CASE WHEN strpos({inner}, ':') > 1 THEN regexp_extract({inner}, '^[^:]+:(.*)$', 1) END",
        "path": f"CASE WHEN {path} = '' THEN '/' ELSE {path} END",
    }


def _sql_absolute(u: str, scheme: str, port: int) -> str:
    rest = f"substr({u}, {len(scheme) + 4})"
    path = f"regexp_extract({rest}, '^[^/]*(/.*)$', 1, 's')"
    return rf"CASE WHEN regexp_matches({rest}, '^[^:]*:[0-9]') THEN {u} ELSE '{scheme}://' || split_part({rest}, '/', 1) || ':{port}' || CASE WHEN {path} = '' THEN '/' ELSE {path} END END"


def _sql_normalize(u: str, b: str) -> str:
    secure = f"starts_with({b}, 'https://')"
    scheme, port = f"CASE WHEN {secure} THEN 'https:' ELSE 'http:' END", f"CASE WHEN {secure} THEN ':443' ELSE ':80' END"
    head, tail = f"split_part({u}, '?', 1)", f"replace(substr({u}, strpos({u}, '?') + 1), '?', '')"
    rest = f"regexp_replace({b}, '^https?://', '')"
    folders = f"string_split(CASE WHEN contains({rest}, '/') THEN regexp_replace({rest}, '/[^/]*$', '') ELSE {rest} END, '/')"
    ups, left = rf"(length(regexp_extract({u}, '^((?:\.\./)*)', 1)) // 3)", rf"regexp_replace({u}, '^(?:\.\./)*', '')"
    return f"""CASE WHEN {u} IS NULL OR {u} = '' THEN NULL
        WHEN starts_with({u}, 'http://') THEN {_sql_absolute(u, "http", 80)}
        WHEN starts_with({u}, 'https://') THEN {_sql_absolute(u, "https", 443)}
        WHEN contains({u}, '//') THEN CASE WHEN NOT contains({u}, '?') THEN ({scheme}) || {u}
            WHEN ends_with({head}, '/') THEN ({scheme}) || regexp_replace({head}, '/$', '') || ({port}) || '/' || {tail} ELSE ({scheme}) || {head} || ({port}) || '?' || {tail} END
        WHEN starts_with({u}, '/') THEN ({scheme}) || '//' || split_part({rest}, '/', 1) || {u}
        WHEN {left} <> '..' AND {ups} < len({folders}) THEN ({scheme}) || '//' || array_to_string({folders}[1:len({folders}) - {ups}], '/') || '/' || {left} END"""


_LINKS = f"({sql_values('(SELECT * FROM outdegrees WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1)', 'links', 'id, url')})"
_HTML = f"(SELECT id, url, {_quoted(_BEFORE)} || replace(page, '<', ' ') || replace([{', '.join(_quoted(x) for x in _AFTERS)}][1 + ascii(right(id, 1)) % {len(_AFTERS)}], '{{0}}', id) AS html FROM {SQL_PAGES} WHERE page IS NOT NULL AND url IS NOT NULL)"
_CODE = r"regexp_replace(html, '(?:<style.*?>.*?</style.*?>)|(?:<script.*?>(?s:.)*?</script.*?>)', '', 'g')"
_A = r"""<[Aa][^>]*[Hh][Rr][Ee][Ff]=["'']?([^\s"''<>]+)["'']?[^>]*>([^<]*)</[Aa]>"""
_IMG = r"""<[Ii][Mm][Gg][^>]*[Ss][Rr][Cc]=["'']?([^\s"''<>]+)["'']?[^>]*>"""
_ANCHORS = rf"""(SELECT id, url, pos, regexp_replace(href, '#.*$', '') AS href, anchor FROM (
    SELECT id, url, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS pos, unnest(hrefs) AS href, unnest(texts) AS anchor
    FROM (SELECT id, url, regexp_extract_all({_CODE}, '{_A}', 1) AS hrefs, regexp_extract_all({_CODE}, '{_A}', 2) AS texts FROM {_HTML}))
    WHERE NOT regexp_matches(href, '\.(?:jpg|jpeg|gif|png|txt|pdf)$', 'i'))"""
_IMAGES = rf"""(SELECT id, url, pos, regexp_replace(regexp_extract(tag, '{_IMG}', 1), '#.*$', '') AS src, regexp_extract(tag, 'alt="([^"]*)"', 1, 'i') AS alt
    FROM (SELECT id, url, generate_subscripts(tags, 1) AS pos, unnest(tags) AS tag FROM (SELECT id, url, regexp_extract_all({_CODE}, '{_IMG}', 0) AS tags FROM {_HTML})))"""
_P = _sql_part("url")
_SEEN = "(SELECT DISTINCT url FROM crawl)"
_RULES = r"""(SELECT host, robots, flatten(list_transform(list_filter(string_split(coalesce(robots, ''), chr(10) || chr(10)), lambda b: starts_with(b, 'User-agent: *' || chr(10))), lambda b: string_split(b, chr(10))[2:])) AS rules FROM (SELECT DISTINCT host, robots FROM hosts))"""
_FITS = "list_filter(rules, lambda r: (starts_with(r, 'Allow: ') AND starts_with(path, substr(r, 8))) OR (starts_with(r, 'Disallow: ') AND starts_with(path, substr(r, 11))))"
SQL = {
    "hash_key": f"SELECT url, {_sql_hash('url')} AS hash FROM {_SEEN}",
    "parse_url_parts": f"SELECT url, {', '.join(f'{v} AS {k}' for k, v in _P.items())} FROM {_SEEN}",
    "url_hosts": f"SELECT url, nullif({sql_host('url')}, '') AS h, {sql_key('url')} AS k FROM {_SEEN}",
    "normalize_links": f"SELECT id, pos, {_sql_normalize('item', 'url')} AS link FROM {_LINKS}",
    "normalize_relative": f"""SELECT link, count(whole) AS n, CAST(sum(length(whole)) AS BIGINT) AS chars, min(whole) AS first, max(whole) AS last FROM (
        SELECT link, {_sql_normalize('link', 'url')} AS whole FROM (SELECT url FROM outdegrees WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1) o,
        (VALUES ('/a/b?c'), ('d.html'), ('../e'), ('../../../../../../f'), ('..'), ('//x.test/y'), ('//x.test/y?q=1'), (''), ('?q=2')) f(link) WHERE url IS NOT NULL) GROUP BY link""",
    "strip_html": f"SELECT id, regexp_replace({_CODE}, '<[^>]*>', '', 'g') AS body FROM {_HTML}",
    "extract_links": f"SELECT id, pos, {_sql_normalize('href', 'url')} AS link, anchor FROM {_ANCHORS} WHERE href <> ''",
    "out_links": f"SELECT id, string_agg(link, ',' ORDER BY link) AS links FROM (SELECT DISTINCT id, {_sql_normalize('href', 'url')} AS link FROM {_ANCHORS} WHERE href <> '') WHERE link IS NOT NULL GROUP BY id",
    "anchor_text": f"SELECT id, string_agg(anchor, ' ' ORDER BY pos) AS anchor FROM {_ANCHORS} WHERE href <> '' AND anchor <> '' GROUP BY id",
    "extract_images": f"SELECT id, src, coalesce(string_agg(nullif(alt, ''), ',' ORDER BY pos), '') AS alt FROM {_IMAGES} WHERE src <> '' GROUP BY 1, 2",
    "image_table": f"SELECT {_sql_hash('src')} AS id, src AS url, coalesce(array_to_string(list_sort(list_distinct(list(alt) FILTER (alt <> ''))), ' '), '') AS alt FROM (SELECT {_sql_normalize('src', 'url')} AS src, alt FROM {_IMAGES} WHERE src <> '') WHERE src IS NOT NULL GROUP BY src",
    "robots_agent_rules": rf"""SELECT host, agent, array_to_string(CASE WHEN agent <> '' AND len(own) > 0 THEN string_split(own[1], chr(10))[2:] ELSE rules END, '|') AS rules FROM (
        SELECT host, rules, regexp_extract(robots, 'User-agent: ([^*\n]+)\n', 1) AS agent, list_filter(string_split(robots, chr(10) || chr(10)), lambda b: starts_with(b, 'User-agent: ' || regexp_extract(robots, 'User-agent: ([^*\n]+)\n', 1) || chr(10))) AS own FROM {_RULES} WHERE robots IS NOT NULL)""",
    "robots_allow": f"SELECT id, path <> '' AND starts_with(coalesce({_FITS}[1], 'Allow'), 'Allow') AS allowed FROM (SELECT DISTINCT id, c.host, {_P['path']} AS path, rules FROM (SELECT DISTINCT id, host, url FROM crawl) c JOIN {_RULES} r ON r.host = c.host WHERE robots IS NOT NULL)",
    "robots_own_rules": f"SELECT host, coalesce(robots, '') AS robots, array_to_string(rules, '|') AS rules FROM {_RULES}",
    "blacklist_filter": f"SELECT url FROM {_SEEN} WHERE NOT regexp_full_match(url, {_quoted('|'.join('(?:' + p.replace('*', chr(92) + 'S*') + ')' for p in web.BLOCKED))})",
    "blacklist_table": f"SELECT {_sql_hash('pattern')} AS id, pattern FROM (VALUES {', '.join(f'({_quoted(p)})' for p in web.BLOCKED)}) t(pattern)",
    "allowed_suffix": f"SELECT url FROM {_SEEN} WHERE regexp_extract({_P['host']}, '([^.]*)$', 1) IN ('example', 'test')",
    "domain_quota": f"SELECT id, domain FROM (SELECT id, seq, regexp_extract(host, '([^.]*\\.[^.]*|[^.]*)$', 1) AS domain FROM crawl WHERE id IS NOT NULL AND host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq, id) <= CASE WHEN domain IN ({', '.join(map(_quoted, web.HUBS))}) THEN 10000 WHEN NOT contains(domain, '.') THEN 1000 ELSE 200 END",
    "frontier_bfs": f"""WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT {sql_key('url')} AS src, {sql_key('item')} AS dst FROM {_LINKS}),
        met AS (SELECT k AS id, 0 AS depth FROM (SELECT {sql_key('url')} AS k FROM {SQL_PAGES} WHERE url IS NOT NULL ORDER BY k LIMIT 3)
        UNION SELECT dst, depth + 1 FROM met JOIN links ON src = id WHERE depth < 40 AND dst IS NOT NULL)
        SELECT id, min(depth) AS depth FROM met GROUP BY id""",
    "crawl_run": rf"""WITH RECURSIVE rules AS MATERIALIZED (SELECT host, flatten(list_transform(list_filter(string_split(robots, chr(10) || chr(10)), lambda b: starts_with(b, 'User-agent: *' || chr(10))), lambda b: string_split(b, chr(10))[2:])) AS rules
            FROM (SELECT host, max(robots) AS robots FROM hosts WHERE robots IS NOT NULL GROUP BY host)),
        rows AS MATERIALIZED (SELECT * FROM (SELECT {_sql_normalize('url', "'http://x/'")} AS leaf, url, links FROM outdegrees WHERE id IS NOT NULL AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1) WHERE links IS NOT NULL),
        hrefs AS (SELECT DISTINCT leaf, regexp_replace(regexp_extract(item, '^[^\s"''<>]+'), '#.*$', '') AS href FROM ({sql_values('rows', 'links', 'leaf, url')}) WHERE NOT regexp_matches(regexp_extract(item, '^[^\s"''<>]+'), '\.(?:jpg|jpeg|gif|png|txt|pdf)$', 'i')),
        whole AS (SELECT DISTINCT leaf, {_sql_normalize('href', 'leaf')} AS url FROM hrefs WHERE href <> ''),
        parted AS (SELECT leaf, url, {_P['host']} AS host, {_P['path']} AS path FROM whole WHERE url IS NOT NULL),
        links AS MATERIALIZED (SELECT leaf, url FROM parted p LEFT JOIN rules r ON r.host = p.host WHERE regexp_extract(p.host, '([^.]*)$', 1) IN ('example', 'test', 'invalid')
            AND NOT regexp_full_match(url, {_quoted('|'.join('(?:' + p.replace('*', chr(92) + 'S*') + ')' for p in web.BLOCKED))}) AND (r.rules IS NULL OR (path <> '' AND starts_with(coalesce({_FITS.replace('rules', 'r.rules')}[1], 'Allow'), 'Allow')))),
        site AS MATERIALIZED (SELECT DISTINCT leaf FROM ({sql_values('rows', 'links', 'leaf')})),
        met AS (SELECT leaf AS url, 0 AS round FROM (SELECT leaf FROM site ORDER BY leaf LIMIT 3) UNION SELECT l.url, round + 1 FROM met m JOIN links l ON l.leaf = m.url WHERE round < 40)
        SELECT url, CAST(min(round) AS INTEGER) AS round, url IN (SELECT leaf FROM site) AS found FROM met GROUP BY url""",
    "host_gap": """SELECT id, seq, gap_ms FROM (SELECT id, seq, CAST(floor((epoch_us(fetched_at) - lag(epoch_us(fetched_at)) OVER (PARTITION BY host ORDER BY fetched_at, seq, id)) / 1000) AS BIGINT) AS gap_ms
        FROM (SELECT DISTINCT id, host, fetched_at, seq FROM crawl WHERE host IS NOT NULL AND fetched_at IS NOT NULL)) WHERE gap_ms < 10000""",
    "redirect_targets": f"SELECT id, seq, {_sql_normalize('redirecturl', 'url')} AS target FROM (SELECT DISTINCT * FROM crawl) WHERE responsecode IN (301, 302, 303, 307, 308) AND redirecturl IS NOT NULL",
    "unseen_links": f"SELECT id, url FROM (SELECT item AS url, {_sql_hash('item')} AS id FROM (SELECT DISTINCT item FROM {_LINKS})) WHERE id NOT IN (SELECT id FROM crawl WHERE responsecode IS NOT NULL AND id IS NOT NULL)",
}
