"""Several values packed in one field: one row per value, with its place.

The text is cut at its quote marks: odd pieces are literals and are kept as they stand, even pieces are cut at
delimiters. Array expressions put the pieces together again, so that a value of a quoted part and an unquoted tail
(``"url":4 9``) stays one value, and give each value its ordinal. All steps are linear in the text and run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import once

#: What a value begins with. A delimiter only separates where a value, or the end of the piece, follows.
URL_START = r"(?i:https?://)"
#: Marks that stand for "quote" and "separator" while a text is taken apart; noncharacters, never in valid text.
_QUOTE, _CUT = "﷐", "﷑"


def packed_values(text: Column | str, start: str | None = None, separators: str = r"\s,;|", wrappers: str = r"\[\]") -> Column:
    """The values of a packed text as an array, in order, without what only quotes, wraps or separates.

    With ``start``, a pattern that each value begins with (:data:`URL_START` for addresses), separators that no value
    follows are text (``?q=a,b``); without it every run of separators separates. A quote mark (single or double) quotes
    only where it opens (before ``start``) at the beginning of a value and closes before a separator, a wrapper, a colon
    or the end; any other is ordinary text, as is a mark of the other kind inside. A doubled mark inside a quoted value
    is one mark. Separators inside quotes are text. Empty values have no place. Null gives null, an empty or blank text
    an empty array.
    """
    text = F.col(text) if isinstance(text, str) else text
    edge, start = rf"{separators}{wrappers}", start or ""
    # Both kinds in one search from the left, so that a mark inside a value of the other kind is not met on its own.
    quoted = "|".join(rf"{mark}(?={start})(?:[^{mark}]++|{mark}{mark})*+{mark}" for mark in ('"', "'"))
    text = F.regexp_replace(text, F.lit(rf"(^|[{edge}])({quoted})(?=[{edge}:]|$)"), F.lit(f"$1{_QUOTE}$2{_QUOTE}"))
    boundary = rf"[{edge}]+(?={start}|\z)|^[{edge}]+" if start else rf"[{edge}]+"

    def piece(p: Column, i: Column) -> Column:
        body, kind = p.substr(F.lit(2), F.length(p) - 2), p.substr(1, 1)
        return F.when(i % 2 == 1, F.replace(body, F.concat(kind, kind), kind)).otherwise(F.regexp_replace(p, boundary, _CUT))

    joined = F.array_join(F.transform(F.split(text, _QUOTE, -1), piece), "")
    return F.filter(F.transform(F.split(joined, _CUT, -1), lambda v: F.trim(v)), lambda v: v != "")


def unpack(df: DataFrame, column: str, value: str = "item", ordinal: str = "pos", **how: str) -> DataFrame:
    """One row for each value packed in ``column``, with its place from 0; the other columns are repeated.

    Rows whose text is null, empty or only separators give no row; repeated rows give repeated values. If the frame
    already has a column named as ``value`` or ``ordinal``, the new one takes its place.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (column, value, ordinal)]
    return df.select(*kept, F.posexplode(once(packed_values(F.col(f"`{column}`"), **how))).alias(ordinal, value))


def unpack_urls(df: DataFrame, column: str, value: str = "item", ordinal: str = "pos") -> DataFrame:
    """:func:`unpack` for values that begin with an address, such as links and postings."""
    return unpack(df, column, value, ordinal, start=URL_START)


def split_posting(item: Column | str) -> Column:
    """``url:pos pos …`` as ``struct<url, positions>``; cut at the last colon, positions that are no numbers left out."""
    item = F.col(item) if isinstance(item, str) else item
    url = F.regexp_extract(item, r"(?s)^(.*):[^:]*$", 1)
    numbers = F.regexp_extract_all(F.regexp_extract(item, r":([0-9\s]*)$", 1), F.lit(r"([0-9]+)"), 1)
    return F.struct(url.alias("url"), F.transform(numbers, lambda n: n.try_cast("int")).alias("positions"))
