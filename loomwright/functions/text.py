"""Escaping, identifiers and the split of a query before its main select."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that escaping replaces, in this order, with their code.
ESCAPES = (("\\", r"\x5c"), ("{", r"\x7b"), ("}", r"\x7d"), (";", r"\x3b"), ("'", r"\x27"), ("$", r"\x24"), ('"', r"\x22"), ("\n", r"\x0a"), ("\r", r"\x0d"))


def escape_text(value: Any) -> Any:
    """A value as text in which quotes, braces, semicolons, dollars, backslashes and line ends are codes."""
    if isinstance(value, Column):
        out = value.cast("string")
        for plain, code in ESCAPES:
            out = F.replace(out, F.lit(plain), F.lit(code))
        return out
    text = str(value)
    for plain, code in ESCAPES:
        text = text.replace(plain, code)
    return text


def identifier_to_string(name: Any) -> Any:
    """An identifier without its pair of double quotes, escaped."""
    if isinstance(name, Column):
        return escape_text(F.regexp_replace(name, r'(?s)^"(.*)"$', "$1"))
    quoted = len(name) >= 2 and name[0] == name[-1] == '"'
    return escape_text(name[1:-1] if quoted else name)


def qualified_identifier(name: Any) -> Any:
    """A quoted identifier as it is, any other in upper case; what is no string has none."""
    if isinstance(name, Column):
        return F.when(name.startswith('"') & name.endswith('"'), name).otherwise(F.upper(name))
    if not isinstance(name, str):
        return None
    return name if name.startswith('"') and name.endswith('"') else name.upper()


_TOKEN = re.compile(r"""(?s)--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`[^`]*`|\w+|.""")


def sql_tokens(sql: str) -> list[tuple[int, str]]:
    """(offset, token) of a statement; strings, quoted names and comments are one token each."""
    return [(m.start(), m.group()) for m in _TOKEN.finditer(sql)]


def remove_select(sql: str) -> str:
    """The text before the first select outside parentheses: a query's CTEs.  The whole text when there is none."""
    depth = 0
    for at, token in sql_tokens(sql):
        depth += {"(": 1, ")": -1}.get(token, 0)
        if depth == 0 and token.lower() == "select":
            return sql[:at]
    return sql


def split_top_level(sql: str, separator: str) -> list[str]:
    """A script's parts between separators outside strings, comments and parentheses; blank parts go."""
    parts, start, depth = [], 0, 0
    for at, token in sql_tokens(sql):
        depth += {"(": 1, ")": -1}.get(token, 0)
        if depth == 0 and at >= start and token == separator[0] and sql.startswith(separator, at):
            parts.append(sql[start:at])
            start = at + len(separator)
    return [p.strip() for p in [*parts, sql[start:]] if p.strip()]
