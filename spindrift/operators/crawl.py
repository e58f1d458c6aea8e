"""Batch forms of a crawl: frontier rounds, quotas, politeness, redirects over tables of what was fetched."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text, web
from spindrift.operators.ordering import previous, running_total
from spindrift.runtime import cut, once

#: Codes whose target is followed (fixed values).
REDIRECTS = (301, 302, 303, 307, 308)


def frontier(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id, depth``: pages reached from the seeds, breadth first, with the round that first met them.

    Each round joins the new pages with the links, drops those seen, and is checkpointed; the loop ends with an empty
    round; ``rounds`` that end before are an error. Links of a page without a row lead nowhere.
    """
    links = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    fresh = cut(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen = fresh
    for depth in islice(count(1), rounds):
        met = fresh.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        fresh = cut(met.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not fresh.limit(1).count():
            break
        seen = cut(seen.unionByName(fresh)) if depth % 8 == 0 else seen.unionByName(fresh)
    else:
        raise RuntimeError("pages are still met")
    return seen


def within_quota(pages: DataFrame, domain: str, order: list[Column], cap: int | Column) -> DataFrame:
    """The first ``cap`` pages of each domain in ``order``; ranks are taken without one task per domain."""
    placed = running_total(pages, order, [domain], name="__place")
    return placed.where(F.col("__place") <= cap).drop("__place")


def redirects(fetched: DataFrame) -> DataFrame:
    """Rows that point elsewhere, with a target, whose percent escapes are decoded; a target that can't be decoded stays."""
    moved = fetched.where(F.col("responsecode").isin(*REDIRECTS) & F.col("redirecturl").isNotNull())
    return moved.withColumn("redirecturl", F.coalesce(F.try_url_decode("redirecturl"), F.col("redirecturl")))


def too_soon(fetched: DataFrame, host: str, at: str, order: list[Column], gap_ms: int = 1000) -> DataFrame:
    """Rows fetched less than ``gap_ms`` after the same host's last fetch, with the gap; hosts may own any part of them.

    ``order`` is by time and total. Rows without a host or time are left out.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = fetched.where(F.col(host).isNotNull() & F.col(at).isNotNull()).withColumn("__us", micros)
    looked = previous(timed, "__us", order, [host], "__last")
    return looked.withColumn("gap_ms", F.floor((F.col("__us") - F.col("__last")) / 1000).cast("long")).where(F.col("gap_ms") < gap_ms).drop("__us", "__last")


def unseen(links: DataFrame, crawled: DataFrame, key: str = "id") -> DataFrame:
    """Links whose page has no response yet."""
    return links.join(crawled.where("responsecode IS NOT NULL").select(key), key, "left_anti")


def parse_seed(args: list[str]) -> tuple[str, str]:
    """``("url", normal form)`` or ``("table", name)`` of a crawl's first argument; one or two arguments are taken."""
    if not 1 <= len(args) <= 2 or not args[0]:
        raise ValueError("a seed url or a table to resume from, and perhaps a list of patterns")
    seed = args[0]
    if not seed.startswith(("http://", "https://")):
        return "table", seed
    scheme, rest = seed.split("://", 1)
    authority, slash, path = rest.partition("/")
    if ":" not in authority:
        authority += ":443" if scheme == "https" else ":80"
    return "url", f"{scheme}://{authority}/{path if slash else ''}"


def run(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots: DataFrame, blocked: tuple[str, ...] | DataFrame = web.BLOCKED, suffixes: tuple[str, ...] = web.FOLLOWED, quota: int = 200, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Crawl in rounds: fetch the queue, take links and redirect targets, keep what may be fetched, until none is left.

    ``seeds`` is ``url``; ``fetch`` gives ``url, responsecode, html, redirecturl`` for a frame of ``url`` and is the only
    part that may meet the outside; ``robots`` is ``host, robots``; ``blocked`` holds patterns or is a table of them
    (``pattern``). A new url must follow its host's rules, match no
    blocked pattern, have an allowed suffix, be new, and fit the domain's quota of pages over the whole crawl (``quota``,
    more for authorities and hosts without a dot: :func:`web.page_cap`); within a round the first by url stay. Returns the fetched pages (``url, responsecode, html, redirecturl, round``) and the
    links (``url, link``) that were allowed.
    """
    rules = cut(robots.where("robots IS NOT NULL").groupBy("host").agg(F.max("robots").alias("robots")).select("host", web.robots_rules("robots").alias("rules")))
    blocked = web.blocked_patterns(blocked) if isinstance(blocked, DataFrame) else blocked
    queue = cut(seeds.select(web.normalize("url", F.lit("http://x/")).alias("url")).where("url IS NOT NULL").distinct())
    fetched = links = seen = None
    for number in islice(count(), rounds):
        got = cut(fetch(queue).select("url", "responsecode", "html", "redirecturl").withColumn("round", F.lit(number)))
        fetched = got if fetched is None else fetched.unionByName(got)  # each round is written once
        seen = got.select("url") if seen is None else seen.unionByName(got.select("url"))
        seen = cut(seen) if number % 8 == 7 else seen
        found = text.anchors(got.where(F.col("responsecode") == 200), "html", "url").select("url", once(web.normalize("href", "url")).alias("link"))
        moved = redirects(got).select("url", once(web.normalize("redirecturl", "url")).alias("link"))
        parts = web.url_parts("link")
        new = found.unionByName(moved).where("link IS NOT NULL").distinct().withColumns({"__host": once(parts["host"]), "__path": once(parts["path"])})
        new = web.not_blocked(new.where(web.followed("link", suffixes)), "link", blocked)
        ruled = new.join(rules, new["__host"] == rules["host"], "left").where(F.col("rules").isNull() | web.robots_allow("__path", "rules"))
        allowed = cut(ruled.select("url", "link"))
        links = allowed if links is None else links.unionByName(allowed)
        known = seen
        fresh = allowed.select(F.col("link").alias("url")).distinct().join(known, "url", "left_anti")
        # Pages fetched before take their domain's first places, so that the quota holds over the whole crawl.
        placed = known.distinct().withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
        placed = placed.withColumn("__domain", web.root_domain(web.url_parts("url")["host"]))
        queue = cut(within_quota(placed, "__domain", [F.col("__new").asc(), F.col("url").asc()], web.page_cap("__domain", quota)).where("__new = 1").select("url"))
        if not queue.limit(1).count():
            break
    else:
        raise RuntimeError("urls are still queued")
    return fetched, links
