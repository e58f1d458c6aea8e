"""Reading level by propagation over the document-word graph.

Each document is joined to its words with the part of the text that a word makes up. Graded documents are clamped to
their grade; a word takes the weighted mean of its documents, a document that of its words, and repeating this spreads
difficulty to words, and documents, that no graded document is joined to. Means draw all values together, so after each
round the words are put back on the scale of the grades by the line that fits the graded documents best; rounds end when
words hardly change. Then every document, graded ones too, is read from its words alone; the medians of the graded ones
by level give the bounds between levels.

The graph is kept as one row per document. A round sends the words' values to the tasks while there are at most
:data:`BROADCAST_WORDS` of them, and combines sums of words per batch, so that documents stay where they are. Beyond
that documents and words are joined by shuffle, with hot words apart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import lookup
from spindrift.runtime import cut, once

#: Rounds before a run without end is an error, mean change of a word (in levels) that ends them, and the greatest
#: vocabulary that is sent to the tasks (16 bytes a word).
ROUNDS, TOLERANCE, BROADCAST_WORDS = 50, 0.01, 500_000


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; 0 for null, empty and blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))


def is_language(lang: Column | str, code: str) -> Column:
    """Whether a language tag is ``code``: any case, white space around it, with or without a region. Null is not."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(F.lower(F.regexp_replace(lang, r"^\s+|\s+$", "")).rlike(rf"^{code}(?:[-_].*)?$"), F.lit(False))


def graph(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``words`` (hash of a word, its part of the text), one row per row with a key; nothing is shuffled.

    The hashes of a text are sorted, and where one differs from the last a word begins.
    """
    hashes = F.array_sort(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), 0), lambda w: F.xxhash64(w)))
    rows = docs.where(F.col(key).isNotNull()).select(key, once(hashes).alias("__s"))
    n = F.size("__s")
    begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get("__s", i) != F.get("__s", i - 1))))
    rows = rows.withColumn("__at", once(begins))
    ends = F.concat(F.slice("__at", F.lit(2), F.greatest(F.size("__at") - 1, F.lit(0))), F.slice(F.array(n), 1, F.least(F.size("__at"), F.lit(1))))
    return rows.select(key, F.zip_with("__at", ends, lambda a, b: F.struct(F.get("__s", a).alias("h"), ((b - a) / n).alias("w"))).alias("words"))


def _edges(rows: DataFrame, *carried: str) -> DataFrame:
    return rows.select(*carried, F.explode("words").alias("__e")).select(*carried, "__e.h", "__e.w")


def _small(words: DataFrame):
    """The words as two arrays, ordered by hash, if they may be sent to the tasks; else None."""
    import numpy as np

    if words.count() > BROADCAST_WORDS:
        return None
    got = words.select("h", "v").toArrow()
    h, v = got.column("h").to_numpy(), got.column("v").to_numpy()
    order = np.argsort(h)
    return h[order], v[order]


def _walk(rows: DataFrame, key: str, known, sums: bool) -> DataFrame:
    """A pass over the graph with all words at hand: ``key, x, grade`` of each row, or the words' ``h, num, den, n``.

    A row's value is its grade, if ``sums``, or else the mean of its known words. Sums are combined per batch.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words = batch.column(2)
            sizes = np.diff(words.offsets.to_numpy())
            flat = words.flatten()
            h, w = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            x = np.full(len(sizes), np.nan)
            if known is not None and len(known[0]) and len(h):
                at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
                found = known[0][at] == h
                num = np.bincount(row[found], w[found] * known[1][at[found]], len(sizes))
                den = np.bincount(row[found], w[found], len(sizes))
                x = np.divide(num, den, out=x, where=den > 0)
            if not sums:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, from_pandas=True), batch.column(1)], names=[key, "x", "grade"])
                continue
            grade = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = np.where(np.isnan(grade), x, grade)
            valued = ~np.isnan(x[row])
            one, where = np.unique(h[valued], return_inverse=True)
            w, x = w[valued], x[row[valued]]
            yield pa.RecordBatch.from_arrays([pa.array(one), *[pa.array(np.bincount(where, s, len(one))) for s in (w * x, w, np.ones(len(w)))]], names=["h", "num", "den", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "grade", "words").mapInArrow(run, "h bigint, num double, den double, n double" if sums else f"`{key}` {kind}, x double, grade double")


def _documents(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``key, x, grade``: the value of each row from its words alone, null without a valued one."""
    known = _small(words)
    if known is not None:
        return _walk(rows, key, known, sums=False)
    means = lookup(_edges(rows, key), words.select("h", "v", "n"), ["h"], "n").groupBy(key).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("x"))
    return rows.select(key, "grade").join(means, key, "left").select(key, "x", "grade")


def _words(rows: DataFrame, words: DataFrame | None, key: str) -> DataFrame:
    """``h, v, den, n``: the mean value of each word's documents, which are read from ``words`` unless they are graded."""
    if words is None:
        sums = _walk(rows.where("grade IS NOT NULL"), key, None, sums=True)
    elif (known := _small(words)) is not None:
        sums = _walk(rows, key, known, sums=True)
    else:
        valued = rows.join(_documents(rows, words, key).groupBy(key).agg(F.avg("x").alias("x")), key, "left").withColumn("x", F.coalesce("grade", "x")).where("x IS NOT NULL")
        sums = _edges(valued, "x").select("h", (F.col("w") * F.col("x")).alias("num"), F.col("w").alias("den"), F.lit(1.0).alias("n"))
    sums = sums.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("num", "den", "n")])
    return cut(sums.select("h", (F.col("num") / F.col("den")).alias("v"), "den", "n"))


def _calibrated(words: DataFrame, graded: DataFrame, key: str) -> DataFrame:
    """Words on the scale of the grades: graded documents, read from their words, fit their grades best."""
    x, g = F.col("x"), F.col("grade")
    read = _documents(graded, words, key).where("x IS NOT NULL")
    r = read.agg(F.avg(x).alias("x"), F.avg(g).alias("g"), F.covar_pop(x, g).alias("xg"), F.var_pop(x).alias("xx")).first()
    if r["x"] is None:
        return words
    slope = r["xg"] / r["xx"] if r["xx"] > 1e-12 and r["xg"] > 0 else 1.0
    return words.withColumn("v", F.lit(r["g"]) + slope * (F.col("v") - r["x"]))


def _change(old: DataFrame | None, new: DataFrame) -> float:
    """Mean change of the words' values, weighted by use; infinite while words are still being reached."""
    if old is None:
        return float("inf")
    both = new.join(old.select("h", F.col("v").alias("__v")), "h", "left")
    r = both.agg((F.sum(F.col("den") * F.abs(F.col("v") - F.col("__v"))) / F.sum("den")).alias("c"), F.max(F.col("__v").isNull()).alias("more")).first()
    return float("inf") if r["more"] else (r["c"] or 0.0)


def propagate(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "level", rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``key, difficulty, grade``: the continuous difficulty of each document on the scale of the grades, and its own mean grade if any.

    Rounds go on until words change by less than ``tolerance`` of a level on average; if they still do after ``rounds``,
    it is an error. Several grades of a document are averaged; null grades and grades of documents that ``docs`` lacks are
    left out. A key that is repeated takes the mean of its texts. Difficulty is null where no path of words leads to a
    graded document.
    """
    own = grades.where(F.col(grade).isNotNull()).groupBy(key).agg(F.avg(grade).alias("grade"))
    rows = cut(graph(docs, key, text).join(own, key, "left"))
    graded = rows.where("grade IS NOT NULL")
    words = None
    for _ in range(rounds):
        new = _calibrated(_words(rows, words, key), graded, key)
        change, words = _change(words, new), new
        if change < tolerance:
            break
        if words.isEmpty():
            break
    else:
        raise RuntimeError("words still change")
    read = _documents(rows, words, key).groupBy(key).agg(F.avg("x").alias("difficulty"), F.max("grade").alias("grade"))
    return read.select(key, "difficulty", "grade")


def levels(propagated: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, level``: bounds halfway between the medians of neighbouring grades; a document apart takes the middle one.

    With one grade every document has it; with none the level is null. Grades whose medians are not in order are an error.
    """
    propagated = cut(propagated)
    graded = propagated.where("grade IS NOT NULL AND difficulty IS NOT NULL").withColumn("g", F.round("grade").cast("int"))
    middle = sorted((r["g"], r["m"]) for r in graded.groupBy("g").agg(F.percentile_approx("difficulty", 0.5, 10_000).alias("m")).collect())  # a row per level
    names = [g for g, _ in middle]
    if any(b[1] < a[1] for a, b in zip(middle, middle[1:], strict=False)):
        raise ValueError(f"the grades don't follow the texts: {middle}")
    bounds = [(a[1] + b[1]) / 2 for a, b in zip(middle, middle[1:], strict=False)]
    if not names:
        return propagated.select(key, F.lit(None).cast("int").alias("level"))
    level = F.when(F.col("difficulty").isNull(), F.lit(names[len(names) // 2]))
    for bound, name in zip(bounds, names, strict=False):
        level = level.when(F.col("difficulty") < bound, F.lit(name))
    return propagated.select(key, level.otherwise(F.lit(names[-1])).cast("int").alias("level"))
