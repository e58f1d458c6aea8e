"""Pages that are keywords, links or product tags rather than sentences.

Each page gives a rank-frequency curve (words by falling count, ranked by an SQL window), whose slope and residual are
fitted in logarithms and whose extent is the logarithm of its last rank over that of the page's words, and a divergence: the Jensen-Shannon distance between its distribution over closed-class words,
addresses and "any other word" and that of prose in the page's own languages, mixed as the page mixes them. Prose at
comparable lengths gives median and spread of each figure; a page is flagged where any of them stands far outside:
the curve in any language, the divergence only in a language that is the page's own. Whether it is, is learned: words
most of whose pages are prose of a language are that language's words, and a page that has few of them (a language
without closed-class words here, whatever its script) is judged by its curve alone.

Statistics cover all pages. What reaches the driver is bounded by the fixed word lists: one number per closed-class word
and language, and medians per language and length class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.words import CLOSED
from spindrift.runtime import cut, once

LANGUAGES = tuple(CLOSED)
#: Fewer words than this are no curve. Pages of the reference have at least so many, a closed-class part of at least so
#: much of their language's median, and addresses for at most so many of their words.
LEAST_WORDS, REFERENCE_WORDS, REFERENCE_PART, REFERENCE_ADDRESSES = 12, 64, 0.75, 0.05
#: Robust z-scores from which a page is flagged: by divergence; by slope (either way), residual or a small extent.
FAR, CURVE_FAR = 3.8, 6.0
#: Least spreads, so that a class of nearly equal pages doesn't make small differences extreme.
SPREADS = {"divergence": 0.02, "slope": 0.05, "residual": 0.03, "extent": 0.02}
#: Length classes are half powers of two, up to 2 ** 9 words; classes of fewer reference pages take the nearest other.
LONGEST_CLASS, CLASS_LEAST = 18, 20
#: A language's own words: on such a part of its prose pages, and with such a part of their pages being its prose. A page
#: is in a language if so many of its words are the language's own.
COMMON, OWN, KNOWN = 0.001, 0.5, 0.15
_WORD = r"(?:https?://|www\.)\S+|[\p{L}\p{N}]+"
#: Scripts without spaces: each character is a word.
_SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
_ADDRESS = "<address>"
#: Each closed-class word with its languages: the place of its only language, or -1.
LISTED = {w: (k if sum(w in ws for ws in CLOSED.values()) == 1 else -1) for k, own in enumerate(CLOSED.values()) for w in own}


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as part of the plan: from lists of Python, executors would start Python workers for them."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)}))


def word_counts(bodies: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``key, word, h, n``: words in lower case with their hash; any address is one symbol (``word`` is null for unlisted words).

    Null bodies and null keys have none.
    """
    text = F.lower(body)
    wide = F.octet_length(text) > F.length(text)  # most texts are told apart without a search
    text = F.when(wide & text.rlike(_SPACELESS), F.regexp_replace(text, f"({_SPACELESS})", " $1 ")).otherwise(text)
    each = bodies.where(F.col(key).isNotNull()).select(key, F.explode(once(F.regexp_extract_all(text, F.lit(_WORD), 0))).alias("w"))
    symbol = F.when(F.contains("w", F.lit("/")) | F.contains("w", F.lit(".")), _ADDRESS).otherwise(F.col("w"))
    counts = each.select(key, F.xxhash64(symbol).alias("h")).groupBy(key, "h").agg(F.count("*").alias("n"))
    listed = _fixed(bodies.sparkSession, [*LISTED.items(), (_ADDRESS, -2)], "word string, home int").select("word", "home", F.xxhash64("word").alias("h"))
    return counts.join(F.broadcast(listed), "h", "left").select(key, "word", "home", "h", "n")  # a fixed list of some 200 words


def curves(counts: DataFrame, key: str = "id") -> DataFrame:
    """Per page: ``words``, ``slope``, ``residual`` and ``extent`` of its rank-frequency curve, its counts of symbols and its words by count.

    Words of equal count stand at consecutive ranks; the sums of ``ln(rank)`` and its square over such a stretch are taken
    from their integrals between the half ranks around it, so that the window runs over a page's distinct counts only.
    """
    by_count = counts.groupBy(key, "n").agg(
        F.count("*").alias("m"),
        F.collect_list("h").alias("hs"),
        F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", F.col("n").cast("double").alias("n")))).alias("symbols"),
        *[F.sum(F.when(F.col("home") == k, F.col("n"))).alias(f"__{k}") for k in range(len(LANGUAGES))],
    )
    upto = F.sum("m").over(Window.partitionBy(key).orderBy(F.desc("n")))
    placed = by_count.withColumn("__b", upto + 0.5).withColumn("__a", F.col("__b") - F.col("m"))
    first = lambda t: t * F.log(t) - t
    second = lambda t: t * (F.log(t) * F.log(t) - 2 * F.log(t) + 2)
    a, b, m, y = F.col("__a"), F.col("__b"), F.col("m"), F.log(F.col("n").cast("double"))
    placed = placed.withColumns({"__x": first(b) - first(a), "__xx": second(b) - second(a), "__y": y})
    x, xx, y = F.col("__x"), F.col("__xx"), F.col("__y")
    sums = placed.groupBy(key).agg(
        F.sum(F.col("n") * m).alias("words"), F.sum(m).alias("__w"), F.sum(x).alias("sx"), F.sum(xx).alias("sxx"), F.sum(m * y).alias("sy"), F.sum(m * y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.flatten(F.collect_list("symbols")).alias("symbols"), F.collect_list(F.struct("n", "hs")).alias("by_count"),
        F.array(*[F.coalesce(F.sum(f"__{k}"), F.lit(0)).cast("double") for k in range(len(LANGUAGES))]).alias("hits"),
    )
    w = F.col("__w")
    vxx, vxy, vyy = F.col("sxx") - F.col("sx") * F.col("sx") / w, F.col("sxy") - F.col("sx") * F.col("sy") / w, F.col("syy") - F.col("sy") * F.col("sy") / w
    slope = F.when((vxx > 1e-9) & (vyy > 1e-9), vxy / vxx).otherwise(0.0)
    fitted = sums.select(key, "words", "symbols", "by_count", "hits", slope.alias("slope"), vxx.alias("__vxx"), vxy.alias("__vxy"), vyy.alias("__vyy"), "__w", (F.log(F.col("__w") + 1) / F.log(F.col("words") + 1)).alias("extent"))
    residual = F.sqrt(F.greatest(F.col("__vyy") - F.col("__vxy") * F.col("slope"), F.lit(0.0)) / F.col("__w"))
    return fitted.select(key, "words", "slope", residual.alias("residual"), "extent", "symbols", "hits", "by_count")


def mixtures(pages: DataFrame, key: str = "id") -> DataFrame:
    """The rows of :func:`curves` with their mixture of languages (``__mix``), ``language``, closed-class ``part``, and whether they may be prose (``__pure``)."""
    whole = F.col("hits")[0]
    for k in range(1, len(LANGUAGES)):
        whole = whole + F.col("hits")[k]
    # A page without any such word is measured against the first language, if it has that language's words.
    mix = F.when(whole > 0, F.transform("hits", lambda h: h / whole)).otherwise(F.array(F.lit(1.0), *[F.lit(0.0)] * (len(LANGUAGES) - 1)))
    mixed = pages.withColumn("__mix", once(mix)).drop("hits")
    most = F.array_max("__mix")
    count = lambda keep: F.aggregate("symbols", F.lit(0.0), lambda a, s: a + F.when(keep(s["word"] == _ADDRESS), s["n"]).otherwise(0.0)) / F.col("words")
    mixed = mixed.withColumns({"language": F.array_position("__mix", most).cast("int") - 1, "part": count(lambda a: ~a), "__addresses": count(lambda a: a)})
    return mixed.withColumn("__pure", (most >= 0.9) & (F.col("words") >= REFERENCE_WORDS) & (F.col("__addresses") <= REFERENCE_ADDRESSES)).drop("__addresses")


def divergences(pages: DataFrame, key: str = "id") -> DataFrame:
    """``key, words, slope, residual, extent``, ``language``, ``prose`` and ``divergence`` of the rows of :func:`mixtures`, materialised.

    Medians, means and the result read ``pages``, so it should be materialised too.
    """
    mixed = pages.drop("by_count")
    usual = mixed.where("__pure").groupBy("language").agg(F.percentile_approx("part", 0.5, 10_000).alias("__usual"))
    mixed = mixed.join(F.broadcast(usual), "language", "left")  # a row per language
    mixed = mixed.withColumn("__pure", F.coalesce(F.col("__pure") & (F.col("part") >= REFERENCE_PART * F.col("__usual")), F.lit(False)))
    # Mean distribution of each language's prose: at most one row per language and symbol.
    own = mixed.where("__pure").select("language", "words", F.explode(F.concat("symbols", F.array(F.struct(F.lit("").alias("word"), F.col("words").cast("double").alias("n"))))).alias("s"))
    sums = own.groupBy("language", F.col("s.word").alias("word")).agg(F.sum(F.col("s.n") / F.col("words")).alias("p")).collect()
    sizes = {r["language"]: r["p"] for r in sums if r["word"] == ""}
    prose = [{r["word"]: r["p"] / sizes[r["language"]] for r in sums if r["language"] == k and r["word"]} for k in range(len(LANGUAGES))]
    tables = [F.create_map(*[F.lit(v) for w in sorted(p) for v in (w, p[w])]) if p else F.create_map(F.lit(""), F.lit(0.0)) for p in prose]
    rest = [1 - sum(p.values()) for p in prose]
    share = [F.get("__mix", F.lit(k)) for k in range(len(LANGUAGES))]

    def expected(word: Column) -> Column:
        each = [F.when(share[k] > 0, share[k] * F.coalesce(F.try_element_at(tables[k], word), F.lit(0.0))).otherwise(0.0) for k in range(len(LANGUAGES))]
        return sum(each[1:], each[0])

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m) / 2).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m) / 2).otherwise(0.0)

    pairs = mixed.withColumn("__pq", once(F.transform("symbols", lambda s: F.struct((s["n"] / F.col("words")).alias("p"), expected(s["word"]).alias("q")))))
    over = lambda f: F.aggregate("__pq", F.lit(0.0), lambda a, x: a + f(x))
    q_rest = sum((share[k] * rest[k] for k in range(1, len(LANGUAGES))), share[0] * rest[0])
    p_rest = F.greatest(1 - over(lambda x: x["p"]), F.lit(0.0))
    unseen = F.greatest(1 - q_rest - over(lambda x: x["q"]), F.lit(0.0))
    value = over(lambda x: term(x["p"], x["q"])) + term(p_rest, q_rest) + unseen / 2
    return cut(pairs.select(key, "words", "slope", "residual", "extent", "language", F.col("__pure").alias("prose"), value.alias("divergence")))


def _length_class(words: Column) -> Column:
    return F.least(F.floor(2 * F.log2(words.cast("double"))), F.lit(LONGEST_CLASS)).cast("int")


def _norms(figures: DataFrame) -> list[tuple]:
    """Median and spread of each figure by language and length class, for all classes; a bounded number of rows.

    A class without enough prose takes the nearest class that has; class -1 is all prose of a language, for languages in
    which no class has. Language -1 is all prose.
    """
    prose = figures.where("prose").withColumn("cls", F.explode(F.array(_length_class(F.col("words")), F.lit(-1)))).withColumn("language", F.explode(F.array("language", F.lit(-1))))
    names = list(SPREADS)
    middle = prose.groupBy("language", "cls").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10_000).alias(f"m_{c}") for c in names])
    apart = prose.join(F.broadcast(middle), ["language", "cls"]).groupBy("language", "cls").agg(F.max("n").alias("n"), *[F.max(f"m_{c}").alias(f"m_{c}") for c in names], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 10_000).alias(f"d_{c}") for c in names])
    every = apart.collect()
    usable = lambda k: [r for r in every if r["language"] == k and r["cls"] >= 0 and r["n"] >= CLASS_LEAST] or [r for r in every if r["language"] == k and r["cls"] < 0]
    out = []
    for language in range(-1, len(LANGUAGES)):
        same = usable(language) or usable(-1)
        for cls in range(LONGEST_CLASS + 1):
            if same:
                r = min(same, key=lambda r: (abs(r["cls"] - cls), r["cls"]))
                out.append((language, cls, *[x for c in names for x in (r[f"m_{c}"], max(1.4826 * r[f"d_{c}"], SPREADS[c]))]))
    return out


def _strangers(pages: DataFrame, figures: DataFrame, suspects: DataFrame, key: str) -> DataFrame:
    """``key`` of those ``suspects`` that aren't in their language: too few of their words are words of its prose.

    A word belongs to a language if most of its pages are prose of it and if it is on a thousandth of that prose; there
    are at most a thousand times as many such words as a page has words, so the list is broadcast.
    """
    sizes = figures.where("prose").groupBy("language").agg(F.count("*").alias("size"))
    about = figures.select(key, "language", F.when(F.col("prose"), F.col("language")).otherwise(-1).alias("home")).join(suspects.select(key, F.lit(True).alias("suspect")), key, "left")
    # Pages move with their words in arrays, not word by word.
    words = pages.select(key, "by_count").join(about, key).select(key, "language", "home", "suspect", F.explode("by_count").alias("c"))
    words = words.select(key, "language", "home", "suspect", F.col("c.n").alias("n"), F.explode("c.hs").alias("h"))
    home = words.groupBy("h", F.col("home").alias("language")).agg(F.count("*").alias("k"))
    home = home.groupBy("h").agg(F.sum("k").alias("uses"), F.max_by("language", F.when(F.col("language") >= 0, F.col("k")).otherwise(0)).alias("language"), F.max(F.when(F.col("language") >= 0, F.col("k"))).alias("k"))
    vocabulary = home.where(F.col("k") >= OWN * F.col("uses")).join(F.broadcast(sizes), "language").where(F.col("k") >= COMMON * F.col("size")).select("h", F.col("language").alias("of"))
    own = words.where("suspect").join(F.broadcast(vocabulary), "h", "left")
    address = F.xxhash64(F.lit(_ADDRESS))
    n = F.when(F.col("h") != address, F.col("n")).otherwise(0)
    shares = own.groupBy(key).agg(F.sum(n).alias("__all"), F.sum(F.when(F.col("of") == F.col("language"), n).otherwise(0)).alias("__own"))
    return shares.where(F.col("__own") < KNOWN * F.col("__all")).select(key)


def score_pages(spark: SparkSession, bodies: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``key``, the four figures, their robust z-scores (``z_…``), ``cause`` and ``flagged`` for each page with a body.

    ``cause`` is ``curve``, ``divergence``, ``both`` or null. Pages of fewer than :data:`LEAST_WORDS` words and null or
    empty bodies get no row: there is no curve to speak of. A page in a language without closed-class words here has a
    null ``z_divergence``. With no prose at all nothing is flagged. ``bodies`` should be partitioned by ``key`` already,
    as a latest-version view is; then counting needs no shuffle. Each partition of what is kept here is a file, and on a
    local file system each file takes two processes that executors start (``chmod``); so pages and figures alone are kept.
    """
    pages = cut(mixtures(curves(word_counts(bodies, key, body), key).where(F.col("words") >= LEAST_WORDS), key))
    figures = divergences(pages, key)
    names = list(SPREADS)
    schema = "language int, cls int, " + ", ".join(f"m_{c} double, s_{c} double" for c in names)
    norms = _fixed(spark, _norms(figures), schema)
    classed = figures.withColumn("cls", _length_class(F.col("words")))

    def scored(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(norms), ["language", "cls"], "left").withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in names})

    suspects = scored(classed).where(F.col("z_divergence") > FAR).select(key, "language")
    strangers = _strangers(pages, figures, suspects, key).withColumn("__strange", F.lit(True))
    known = classed.join(strangers, key, "left").withColumn("language", F.when(F.col("__strange"), -1).otherwise(F.col("language")))
    out = scored(known).withColumn("z_divergence", F.when(F.col("__strange").isNull(), F.col("z_divergence")))
    far = F.coalesce(F.col("z_divergence") > FAR, F.lit(False))
    curve = F.coalesce(F.greatest(F.abs("z_slope"), F.col("z_residual"), -F.col("z_extent")) > CURVE_FAR, F.lit(False))
    cause = F.when(far & curve, "both").when(far, "divergence").when(curve, "curve")
    return out.select(key, "words", *names, *[f"z_{c}" for c in names], cause.alias("cause"), (far | curve).alias("flagged"))
