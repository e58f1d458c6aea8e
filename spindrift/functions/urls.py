"""URL parts as Column expressions, tolerant of the many ways an authority is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def authority(url: Column | str) -> Column:
    """Text between ``//`` and the next ``/``, ``?`` or ``#``; empty when there is none."""
    return F.regexp_extract(F.trim(_c(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)


def host(url: Column | str) -> Column:
    """Host in lower case without user, port and trailing dots; null when the url has none.

    A bracketed address keeps its brackets. Null gives null.
    """
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    bare = F.regexp_replace(bare, r"(?<=[\]A-Za-z0-9.\-_~%])?:[0-9]*$", "")
    bare = F.lower(F.regexp_replace(bare, r"\.+$", ""))
    return F.when(bare != "", bare)


def domain(url: Column | str) -> Column:
    """The last two labels of the host (the whole host if it has fewer); null when there is no host."""
    return F.regexp_extract(host(url), r"([^.]+\.[^.]+|[^.]+)$", 1)


def page_key(url: Column | str) -> Column:
    """One text for all spellings of a page address: scheme and host in lower case, no user, default port or fragment.

    A missing path is ``/``. Null or a text without a host gives null.
    """
    u = F.trim(_c(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    port = F.regexp_extract(authority(u), r":([0-9]+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^#]*)", 1)
    path = F.when(F.substring(path, 1, 1) == "/", path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(scheme, F.lit("://"), host(u), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path)
