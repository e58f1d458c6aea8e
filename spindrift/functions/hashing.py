"""Row keys: the letter hash of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(byte: int) -> str:
    """The two letters of a byte (fixed value, by its rule)."""
    at = 255 if byte == 0 else byte if byte < 128 else byte - 1
    return chr(97 + at % 26) + "acegikmoqs"[at // 26]


def letter_hash(text: Column | str) -> Column:
    """40 lower-case letters: each byte of the SHA-1 of the UTF-8 text as two letters.

    Byte ``b`` has the index ``b`` for 1 to 127, 255 for 0 and ``b - 1`` above 127; index ``i`` is written as the letter
    ``i mod 26`` and one of ten letters for ``i div 26``. Null gives null.
    """
    text = F.col(text) if isinstance(text, str) else text
    digest = F.sha1(text.cast("binary"))
    pairs = F.array(*[F.lit(_pair(b)) for b in range(256)])
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1
    # Twenty plain expressions, so that all of it is compiled; the digest is computed once.
    return F.when(text.isNotNull(), F.concat(*[F.element_at(pairs, 16 * digit(2 * i + 1) + digit(2 * i + 2) + 1) for i in range(20)]))
