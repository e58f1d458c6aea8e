"""How distinctive a term is of a record: adjusted residuals of correspondence analysis.

With ``o`` the count of a term in a record, ``r`` and ``c`` the term's and the record's margins and ``n`` the grand
total, ``e = r * c / n`` is expected, ``(o - e) / sqrt(e)`` the residual, and dividing it by
``sqrt((1 - r / n) * (1 - c / n))`` adjusts its variance. All of it is plain DataFrame arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ordering import lookup
from spindrift.operators.packed import split_posting, unpack_urls

#: The size of a record whose word count is unknown.
UNKNOWN_SIZE = 1000


def postings(index: DataFrame, word: str = "word", value: str = "value") -> DataFrame:
    """``word, url, tf``: one row per word and url, with the number of distinct positions over all rows of the word.

    Repeated rows, repeated postings and postings spread over several rows count once. Rows with a null word or value
    and postings without a url are left out.
    """
    items = unpack_urls(index.where(F.col(word).isNotNull()).select(F.col(word).alias("word"), F.col(value).alias("value")), "value")
    p = items.select("word", split_posting("item").alias("p")).where("p.url <> ''").select("word", "p.url", "p.positions")
    return p.groupBy("word", "url").agg(F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).cast("long").alias("tf"))  # repeats collapse before the shuffle


def residuals(counts: DataFrame, records: DataFrame, term: str = "word", record: str = "url", tf: str = "tf", size: str = "wordcount") -> DataFrame:
    """Score each ``(term, record)`` of ``counts``.

    ``records`` has one row per record with its ``size``; records that ``counts`` names and ``records`` lacks take part
    in the margins of terms but get no row. A null size is :data:`UNKNOWN_SIZE`, one below the record's counted terms is
    raised to 1. Other columns of ``records`` stay unless ``counts`` has one of that name. Adds ``n_records`` (records with the term), ``expected``, ``residual`` and ``adjusted``; where a
    margin is the whole, the adjusted residual is null. Null terms and records are left out; a record repeated in
    ``records`` counts each time. Empty inputs give an empty frame.
    """
    records = records.select(record, *[F.col(f"`{c}`") for c in records.columns if c != record and c not in counts.columns])
    sized = records.withColumn(size, F.greatest(F.coalesce(F.col(size), F.lit(UNKNOWN_SIZE)), F.lit(1)).cast("double"))
    counts = counts.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    rows = counts.groupBy(term).agg(F.sum(tf).cast("double").alias("__r"), F.count("*").alias("n_records"))
    # Words of many records own most rows: they are looked up apart.
    out = lookup(counts.join(sized, record), rows, [term], "n_records").withColumn("__n", sized.agg(F.sum(size)).scalar())
    r, c, n = F.col("__r"), F.col(size), F.greatest("__n", "__r")
    expected = r * c / n
    plain = (F.col(tf) - expected) / F.sqrt(expected)
    room = (1 - r / n) * (1 - c / n)
    return out.select("*", expected.alias("expected"), plain.alias("residual"), F.when(room > 0, plain / F.sqrt(room)).alias("adjusted")).drop("__r", "__n")
