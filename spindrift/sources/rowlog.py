"""The text form of a row log: ``key SP (column SP length SP bytes SP)* LF``, one row per version.

Values are length-prefixed and may hold any byte, line feeds too, so where a row begins is known only from the row
before: a file is read by one task, as a stream, in memory for a chunk or its longest row; a log of many files is read in
parallel. Keys and column names may hold neither space nor line feed; writing such is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.runtime import shuffle_partitions

SCHEMA = "table string, key string, col string, value binary, seq bigint"


def decode(data: bytes) -> Iterator[tuple[int, str, dict[str, bytes]]]:
    """``offset, key, cells`` of each row; a torn last row ends the log, any other fault is an error."""
    return ((begin, key, cells) for begin, _, key, cells in _rows(data))


def decode_stream(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[int, str, dict[str, bytes]]]:
    """:func:`decode` for a log of any length: rows as they become whole."""
    data, base = b"", 0
    while more := stream.read(max(chunk, len(data))):
        data += more
        done = 0
        for begin, done, key, cells in _rows(data):
            yield base + begin, key, cells
        data, base = data[done:], base + done


def _rows(data: bytes) -> Iterator[tuple[int, int, str, dict[str, bytes]]]:
    """The whole rows of ``data``: where each begins and ends, its key and cells."""
    at = 0
    while at < len(data):
        begin, space = at, data.find(b" ", at)
        if space < 0:
            return
        key, at, cells = data[at:space].decode(), space + 1, {}
        while at < len(data) and data[at : at + 1] != b"\n":
            name_end = data.find(b" ", at)
            size_end = data.find(b" ", name_end + 1)
            if name_end < 0 or size_end < 0:
                return
            size = int(data[name_end + 1 : size_end])
            if size_end + 1 + size >= len(data):
                return
            cells[data[at:name_end].decode()] = data[size_end + 1 : size_end + 1 + size]
            at = size_end + 1 + size
            if data[at : at + 1] != b" ":
                raise ValueError(f"no space after a value at {at}")
            at += 1
        if at >= len(data):
            return
        at += 1
        yield begin, at, key, cells


def encode(key: str, cells: dict[str, bytes]) -> bytes:
    """One row in its text form."""
    for name in (key, *cells):
        if " " in name or "\n" in name or not name:
            raise ValueError(f"not a key or column name: {name!r}")
    return b"".join([key.encode(), b" ", *[b"%s %d %s " % (n.encode(), len(v), v) for n, v in cells.items()], b"\n"])


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """All cells of all versions of the logs that ``pattern`` names; ``seq`` is the row's place in its file."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ("table", "key", "col", "value", "seq")
        types = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                table = path.rsplit("/", 1)[-1].removesuffix(".table")
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place) as stream:
                    cells = ((table, k, c, v, at) for at, k, row in decode_stream(stream) for c, v in row.items())
                    while some := list(islice(cells, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=list(names))

    files = spark.read.format("binaryFile").load(pattern).select("path")  # listed, not read
    return files.repartition(shuffle_partitions(spark), "path").mapInArrow(run, SCHEMA)


def write(df: DataFrame, path: str) -> None:
    """Write ``key, cells`` (map of text, null as empty) as row-log files, one per task; bad names are an error."""
    bad = lambda c: F.coalesce(c.rlike(r"[ \n]|^$"), F.lit(True))
    entries = F.array_sort(F.map_entries(F.transform_values("cells", lambda k, v: F.coalesce(v, F.lit("")))))
    parts = F.transform(entries, lambda e: F.concat(F.when(bad(e["key"]), F.raise_error(F.concat(F.lit("no column name: "), e["key"]))).otherwise(e["key"]), F.lit(" "), F.octet_length(e["value"]).cast("string"), F.lit(" "), e["value"], F.lit(" ")))
    key = F.when(bad(F.col("key")), F.raise_error(F.concat(F.lit("no key: "), F.coalesce("key", F.lit("null"))))).otherwise(F.col("key"))
    df.select(F.concat(key, F.lit(" "), F.array_join(parts, "")).alias("value")).write.mode("errorifexists").text(path)
