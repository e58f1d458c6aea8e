"""Rules of a crawl: url parts, normal form, robots rules, wildcard lists, allowed suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import _c

#: Top-level domains whose links are followed, and domains that count as authorities (fixed values).
FOLLOWED = ("com", "net", "org", "edu", "gov")
HUBS = (
    "wikipedia.org", "cnn.com", "w3schools.com", "geeksforgeeks.org", "forbes.com", "fortune.com", "bloomberg.com", "imbd.com",
    "rottentomatoes.com", "netflix.com", "irs.gov", "zillow.com", "nerdwallet.com", "investopedia.com", "espn.com", "cbssport.com",
    "nbcsports.com", "foxnews.com", "abcnews.com", "nytimes.com", "steampowered.com", "upenn.edu", "usnews.com", "quora.com",
    "reddit.com", "bing.com", "usa.gov", "kbb.com", "craiglist.com", "webmd.com", "mayoclinic.org", "simplyrecipes.com",
    "allrecipes.com", "etsy.com",
)
#: Wildcard patterns of urls that are left out (fixed values).
BLOCKED = (
    "*twitter*", "*youtube*", "*instagram*", "*facebook*", "*amazon*", "*cnnespanol*", "*ads*", "*espncricinfo*",
    "*disneytermsofuse.com*", "*marca.com*", "*cadenaser.com*", "*uesyndication.com*", "*calciomercato.com*", "*tuttosport.com*",
    "*viacomcbsprivacy.com*", "*as.com*", "*retinatendencias.com*", "*prisa.com*", "*/stats/*", "*/preview/*", "*/calendar/*",
    "*/week/*", "*olympics.com*", "*browsehappy.com*", "*forum*", "*apple.com*", "*wpvip.com*", "*snapchat.com*", "*bank*", "*map*",
    "*video*", "*waze*", "*spotify*", "*ticket*", "*store*", "*linkedin*", "*teamworkonline.com*", "*jamsadr.com*", "*wsop.com*",
    "*disqus*", "*tigweb.org*", "*health*", "*gobrockport.com*", "*pr.nba.com*", "*picks.cbssports.com*", "*footmercato.net*",
    "*mundodeportivo.com*", "*andro4all.com*", "*nbcuni*", "*meredith.com*", "*shop*", "*comcast*", "*nasdaq.com*",
    "*childrensplace.com*", "*signup*", "*optout*", "*login*", "*logout*", "*sports.com*", "*/author/*", "*iberdrola.com*",
)


def url_parts(url: Column | str) -> Column:
    """``struct<scheme, host, port, path>``: port null if absent, path ``/`` if absent; a text without ``//`` is a path."""
    u = _c(url)
    has = F.instr(u, "//") > 1
    authority = F.regexp_extract(u, r"^[^/]*//([^/]*)", 1)
    colon = F.instr(authority, ":") > 1
    path = F.regexp_extract(u, r"^[^/]*//[^/]*(/[\s\S]*)$", 1)
    return F.struct(
        F.when(has, F.regexp_extract(u, r"^(.*?).//", 1)).alias("scheme"),
        F.when(has, F.when(colon, F.substring_index(authority, ":", 1)).otherwise(authority)).alias("host"),
        F.when(has & colon, F.regexp_extract(authority, r"^[^:]+:(.*)$", 1)).alias("port"),
        F.when(has, F.when(path == "", "/").otherwise(path)).otherwise(F.when(F.coalesce(u, F.lit("")) == "", "/").otherwise(u)).alias("path"),
    )


def _absolute(u: Column, scheme: str, port: int) -> Column:
    rest = F.substr(u, F.lit(len(scheme) + 4))
    first, path = F.regexp_extract(rest, "^([^/]*)", 1), F.regexp_extract(rest, r"^[^/]*(/[\s\S]*)$", 1)
    with_port = F.concat(F.lit(f"{scheme}://"), first, F.lit(f":{port}"), F.when(path == "", "/").otherwise(path))
    return F.when(rest.rlike(r"^[^:]*:\d"), u).otherwise(with_port)


def normalize(link: Column | str, base: Column | str) -> Column:
    """The absolute form of ``link`` as met on the page ``base``; null where there is none.

    An absolute link gets its scheme's port and a path unless a colon and a digit follow; one that begins with ``//``
    gets the scheme of the base, and with a query also its port (before the query, whose own marks vanish); one that
    begins with ``/`` goes below the authority of the base; any other below its folder, where each leading ``../``
    leaves one folder. Too many of these, a lone ``..``, and empty or null links give null.
    """
    u, b = _c(link), _c(base)
    secure = b.startswith("https://")
    scheme, port = F.when(secure, F.lit("https:")).otherwise(F.lit("http:")), F.when(secure, F.lit(":443")).otherwise(F.lit(":80"))
    parts = F.split(u, r"\?", -1)
    head, tail = F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    asked = F.when(head.endswith("/"), F.concat(scheme, F.regexp_replace(head, "/$", ""), port, F.lit("/"), tail)).otherwise(F.concat(scheme, head, port, F.lit("?"), tail))
    protocol_relative = F.when(F.contains(u, F.lit("?")), asked).otherwise(F.concat(scheme, u))
    rest = F.regexp_replace(b, "^https?://", "")
    rooted = F.concat(scheme, F.lit("//"), F.regexp_extract(rest, "^([^/]*)", 1), u)
    # Folders of the base; each leading "../" of the link takes one away, and the authority must stay.
    folders = F.split(F.when(F.contains(rest, F.lit("/")), F.regexp_replace(rest, "/[^/]*$", "")).otherwise(rest), "/", -1)
    ups = F.length(F.regexp_extract(u, r"^((?:\.\./)*)", 1)) / 3
    left = F.regexp_replace(u, r"^(?:\.\./)*", "")
    below = F.concat(scheme, F.lit("//"), F.array_join(F.slice(folders, 1, F.greatest((F.size(folders) - ups).cast("int"), F.lit(0))), "/"), F.lit("/"), left)
    relative = F.when((left != "..") & (ups < F.size(folders)), below)
    return (
        F.when(u.isNull() | (u == ""), None)
        .when(u.startswith("http://"), _absolute(u, "http", 80))
        .when(u.startswith("https://"), _absolute(u, "https", 443))
        .when(F.contains(u, F.lit("//")), protocol_relative)
        .when(u.startswith("/"), rooted)
        .otherwise(relative)
    )


def robots_rules(robots: Column | str, agent: Column | str = "*") -> Column:
    """The rule lines that hold for ``agent``: those of its own block, else those of all blocks for ``*``, in order.

    ``agent`` is a name or a column of names. Blocks are apart by an empty line; an own block ends the search. Null and
    empty texts have no rules; a null or empty name is anyone's.
    """
    found = F.split(_c(robots), "\n\n", -1)
    lines = lambda x: F.slice(F.split(x, "\n", -1), 2, 1_000_000)
    name = F.coalesce(F.nullif(F.lit(agent) if isinstance(agent, str) else agent, F.lit("")), F.lit("*"))
    own = F.filter(found, lambda x: x.startswith(F.concat(F.lit("User-agent: "), name, F.lit("\n"))))
    anyone = F.flatten(F.transform(F.filter(found, lambda x: x.startswith("User-agent: *\n")), lines))
    first = F.transform(F.slice(own, 1, 1), lines)
    return F.coalesce(F.when((F.size(own) > 0) & (name != "*"), F.get(first, F.lit(0))).otherwise(anyone), F.array().cast("array<string>"))


def robots_allow(path: Column | str, rules: Column | str) -> Column:
    """Whether the first rule whose prefix fits ``path`` allows it; true if none fits, false for an empty or null path.

    A ``Disallow:`` with an empty prefix fits, and so forbids, every path.
    """
    path = _c(path)
    fits = F.filter(_c(rules), lambda r: (r.startswith("Allow: ") & path.startswith(F.substr(r, F.lit(8)))) | (r.startswith("Disallow: ") & path.startswith(F.substr(r, F.lit(11)))))
    return F.coalesce((path != "") & (F.coalesce(F.get(fits, F.lit(0)), F.lit("Allow")).startswith("Allow")), F.lit(False))


def wildcard_regex(pattern: str) -> str:
    """A whole-text regular expression: ``*`` is any run without white space, a dot stays any character."""
    return "^(?:" + pattern.replace("*", r"\S*") + ")$"


def blocked_patterns(table: DataFrame, column: str = "pattern", most: int = 10_000) -> tuple[str, ...]:
    """The distinct patterns of a blacklist table, which must hold at most ``most``: they become one expression."""
    rows = table.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    return tuple(r[0] for r in rows)


def not_blocked(df: DataFrame, url: str, patterns: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Rows whose url fits none of the patterns; a null url fits none."""
    if not patterns:
        return df
    return df.where(~F.coalesce(F.col(url).rlike("|".join(wildcard_regex(p) for p in patterns)), F.lit(False)))


def root_domain(host: Column | str) -> Column:
    """The last two labels of a host, or the host itself if it has no dot."""
    return F.regexp_extract(_c(host), r"([^.]*\.[^.]*|[^.]*)$", 1)


def page_cap(domain: Column | str, usual: int = 200) -> Column:
    """How many pages of a root domain are fetched: 10,000 of an authority, 1,000 of a host without a dot, else ``usual``."""
    d = _c(domain)
    return F.when(d.isin(*HUBS), F.lit(10_000)).when(~F.contains(d, F.lit(".")), F.lit(1_000)).otherwise(F.lit(usual))


def followed(url: Column | str, suffixes: tuple[str, ...] = FOLLOWED) -> Column:
    """Whether the host of ``url`` ends in one of ``suffixes``; false for null."""
    return F.coalesce(F.regexp_extract(url_parts(url)["host"], r"([^.]*)$", 1).isin(*suffixes), F.lit(False))
