"""SQL fragments that several query modules share; DuckDB dialect."""

from __future__ import annotations

#: The current row of each page.
SQL_PAGES = "(SELECT * FROM content WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC NULLS LAST) = 1)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def sql_host(url: str) -> str:
    bare = rf"regexp_replace(regexp_extract(trim({url}), '{_SCHEME}([^/?#\\]*)', 1), '^.*@', '')"
    return rf"lower(regexp_replace(regexp_replace({bare}, ':[0-9]*$', ''), '\.+$', ''))"


def sql_domain(url: str) -> str:
    return rf"regexp_extract({sql_host(url)}, '([^.]+\.[^.]+|[^.]+)$', 1)"


def sql_key(url: str) -> str:
    scheme = f"lower(regexp_extract(trim({url}), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    port = rf"regexp_extract(regexp_extract(trim({url}), '{_SCHEME}([^/?#\\]*)', 1), ':([0-9]+)$', 1)"
    path = rf"regexp_extract(trim({url}), '{_SCHEME}[^/?#\\]*([^#]*)', 1)"
    shown = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    return f"nullif({scheme} || '://' || {sql_host(url)} || {shown} || CASE WHEN {path}[1] = '/' THEN {path} ELSE '/' || {path} END, ':///')"


def sql_tokens(text: str) -> str:
    """Words of a text: punctuation to space, lower case, cut at white space, a first empty token kept."""
    bare = rf"""lower(regexp_replace({text}, '[.,:;!?''"()-]', ' ', 'g'))"""
    return rf"CASE WHEN regexp_replace({bare}, '\s+$', '') = '' AND {bare} <> '' THEN [] ELSE string_split_regex(regexp_replace({bare}, '\s+$', ''), '\s+') END"
