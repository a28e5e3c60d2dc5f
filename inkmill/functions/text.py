"""SQL fragments for strings, spelled so that they mean what Python's methods mean."""

from __future__ import annotations

#: White space as str.strip() sees it, for the patterns below.
WS = r"[\\s\\x{1c}-\\x{1f}]"


def strip(sql: str) -> str:
    """str.strip(): SQL trim() only knows spaces."""
    return f"regexp_replace({sql}, '(?U)^{WS}+|{WS}+$', '')"


def rstrip(sql: str) -> str:
    return f"regexp_replace({sql}, '(?U){WS}+$', '')"


def strip_newlines(sql: str) -> str:
    return f"trim(both '\\n' from {sql})"


def nonblank(sql: str) -> str:
    return f"({strip(sql)} <> '')"


def unix_newlines(sql: str) -> str:
    """Universal newlines, as text files are read."""
    return f"regexp_replace({sql}, '\\r\\n?', '\\n')"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``value`` computed once. Plans inline a column into a lambda that names it, once per element."""
    return f"transform(array({value}), {name} -> {body})[0]"
