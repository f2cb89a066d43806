"""Whitespace, line and case helpers with Python string semantics.

Spark's one-argument ``trim`` removes only U+0020, and Java's ``\\s`` differs
from Python's, so the character sets below are spelled out and used both as
trim sets (JVM-side, no regex) and as regex classes. The same classes are valid
in RE2, which keeps the DuckDB oracle SQL in step.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace: every code point for which ``str.isspace()`` is true
# (this is what ``str.strip()`` and ``re``'s ``\s`` use). Derived from the rule.
WS_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# The boundaries of Python's ``str.splitlines`` (besides "\r\n"):
# \n, \r, \x0b, \x0c, \x1c, \x1d, \x1e, \x85, \u2028, \u2029
LINE_BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _class(chars: str) -> str:
    """A regex character class for ``chars`` as ``\\x{h}`` escapes and ranges
    (valid in Java and RE2; ranges keep Java's per-character test short)."""
    codes = sorted(set(ord(c) for c in chars))
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        lo = f"\\x{{{codes[i]:x}}}"
        parts.append(lo if j == i else f"{lo}-\\x{{{codes[j]:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


WS = _class(WS_CHARS)
LINE_BREAK = r"\r\n|" + _class(LINE_BREAK_CHARS)

# The same sets written for Java's regex engine: Python's whitespace is exactly
# Java's ASCII ``\s``, U+001C-U+001F, U+0085 and the separator category
# ``\p{Z}``. Java tests such a class with three or four predicates instead of
# one per listed range, which makes whole-text scans several times faster.
# ``tests/test_text.py`` checks every code point against ``WS_CHARS``.
WS_J = r"[\s\x1c-\x1f\x85\p{Z}]"
BLANK_J = r"[\t\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"          # whitespace except "\n"
NOT_WS_J = r"[^\s\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """``str.strip()``."""
    return F.trim(col(c), F.lit(WS_CHARS))


def lstrip(c: Column | str) -> Column:
    """``str.lstrip()``."""
    return F.ltrim(col(c), F.lit(WS_CHARS))


def splitlines(c: Column | str) -> Column:
    """``str.splitlines()``: split on every line boundary, drop one trailing empty piece."""
    def drop_last_empty(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == F.lit(""),
                      F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(col(c), LINE_BREAK, -1), drop_last_empty)


def drop_trailing_dot(c: Column | str) -> Column:
    """Remove one trailing ``.``."""
    c = col(c)
    return F.when(c.endswith("."), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def letter(i: Column) -> Column:
    """0-based index -> capital letter ``A``..."""
    return F.char(F.lit(65) + i)


def sql_chars(chars: str) -> str:
    """The character set as a portable SQL string expression built from ``chr``."""
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in chars) + ")"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element ``transform``).

    Catalyst inlines aliases into every reference; for a regex over a whole
    document that means repeated scans. Binding through a lambda variable keeps
    a single evaluation however often ``body`` refers to it.
    """
    return F.transform(F.array(value), body)[0]


def bind_column(df, expr: Column, name: str):
    """Add ``expr AS name``, evaluated exactly once per row.

    A ``where`` on a projected alias is pushed below the projection and
    re-evaluates the expression there; a column produced by a one-element
    ``inline`` cannot be pushed through, so later filters read the stored value.
    """
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))
