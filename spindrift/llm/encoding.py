"""Encoding of a corpus with a public byte-level BPE vocabulary, as a monoid tree reduction.

A text is cut into leaves of fixed size; leaves are encoded alone and joined in pairs up a binary tree. A join only
re-encodes a window around the seam. The window grows until it begins and ends at a *certain* boundary: a place where
the vocabulary's splitting pattern must begin a new piece whatever stands further left or right. Merges never cross
pieces, so tokens outside the window cannot change; as a check, the window's halves must also reproduce the tokens that
the two sides already had there. Decoding is concatenation up the same tree.

Texts are encoded in their own Arrow batch where they are read: no shuffle, and a worker holds one batch. The rank file
is read once per Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 2048
WINDOW = 64

#: Where a piece must begin, by the characters on either side alone: a run of letters or digits ends at any other
#: character, a run of symbols at white space or (unless it is an apostrophe, which may take letters along) at a letter
#: or digit.
_CERTAIN = r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\s)|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"


def default_vocabulary() -> str:
    """Path of the ranks of byte_bpe_50k where the public vocabularies are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def load(path: str):
    """The encoder of a rank file; without special tokens, so that their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _certain():
    import regex

    return regex.compile(_CERTAIN)


def _seam(encode, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """Tokens of ``left + right``, by re-encoding a growing window around the seam."""
    width = WINDOW
    while True:
        whole_left, whole_right = width >= len(left), width >= len(right)
        tail, head = left if whole_left else left[-width:], right if whole_right else right[:width]
        ends = [m.start() for m in _certain().finditer(tail)]
        starts = [m.start() for m in _certain().finditer(head)]
        a = 0 if whole_left else (ends[-1] if ends else None)
        b = len(head) if whole_right else (starts[0] if starts else None)
        if whole_left and ends:
            a = ends[-1]
        if whole_right and starts:
            b = starts[0]
        if a is not None and b is not None:
            old_tail, old_head = encode(tail[a:]), encode(head[:b])
            keep, skip = len(left_ids) - len(old_tail), len(old_head)
            if left_ids[keep:] == old_tail and right_ids[:skip] == old_head:
                return left_ids[:keep] + encode(tail[a:] + head[:b]) + right_ids[skip:]
        if whole_left and whole_right:
            return encode(left + right)
        width *= 2


def encode_tree(encode, text: str, leaf: int = LEAF) -> list[int]:
    """Tokens of ``text`` by halves down to ``leaf`` characters, joined on the way up."""
    if len(text) <= leaf:
        return encode(text)
    middle = len(text) // 2
    left, right = text[:middle], text[middle:]
    return _seam(encode, left, encode_tree(encode, left, leaf), right, encode_tree(encode, right, leaf))


def decode_tree(decode_bytes, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``: halves are decoded alone and concatenated."""
    if len(ids) <= leaf:
        return decode_bytes(ids)
    middle = len(ids) // 2
    return decode_tree(decode_bytes, ids[:middle], leaf) + decode_tree(decode_bytes, ids[middle:], leaf)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, leaf: int = LEAF, sizes_only: bool = False) -> DataFrame:
    """One row per row of ``df``: ``key`` and ``ids`` (array of int), or ``n_tokens`` with ``sizes_only``.

    A null or empty text has an empty list (size 0); blank texts and control characters are ordinary text. Repeated rows
    stay repeated; other columns are left out, whatever their names. An empty frame gives an empty frame.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = load(path).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [encode_tree(encode, t, leaf) if t else [] for t in part.column(1).to_pylist()]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                if sizes_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64())], names=[key, "n_tokens"])
                    continue
                total = int(lengths.sum())
                flat = np.fromiter((i for one in lists for i in one), np.int32, total)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    narrow = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if sizes_only else "ids array<int>"))


def decode_documents(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The texts of token lists: ``key`` and ``text``; a null list gives null, an empty one the empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = load(path).decode_bytes
        for batch in batches:
            texts = [None if x is None else decode_tree(decode, x).decode("utf-8", errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    narrow = df.select(F.col(f"`{key}`"), F.col(f"`{ids}`"))
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[0].dataType.simpleString()}, text string")
