"""Operators that need no Python: Catalyst expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.operators.grid import MAX_COLSPAN, MAX_ROWSPAN
from tagloom.operators.render import DEFAULT_SCHEMES

_WS = "[\\t\\n\\f\\r ]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_newlines(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "\\r\\n?", "\n")


def ascii_lower(c: str | Column) -> Column:
    """Of A-Z only; lower() also folds other scripts."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def escape_text(c: str | Column) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_attr(c: str | Column) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def collapse_ws(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), _WS, " "))


def split_ws(c: str | Column) -> Column:
    return F.filter(F.split(_col(c), _WS), lambda x: x != "")


def is_safe_url(c: str | Column, schemes=DEFAULT_SCHEMES) -> Column:
    clean = ascii_lower(F.regexp_replace(_col(c), "[\\x00-\\x20\\x7f]", ""))
    head = F.regexp_extract(clean, "^[^/?#:]*", 0)
    return (F.substring(clean, F.length(head) + 1, F.lit(1)) != ":") | head.isin(*schemes)


def span(c: str | Column, most: int) -> Column:
    """A colspan or rowspan: absent, invalid and zero are 1."""
    digits = F.regexp_extract(F.coalesce(_col(c), F.lit("")), "^[\\t\\n\\f\\r ]*\\+?([0-9]+)", 1)
    n = F.when(F.length(digits) > 9, F.lit(most)).otherwise(F.least(F.coalesce(F.nullif(digits, F.lit("")), F.lit("1")).cast("decimal(38,0)"), F.lit(most)))
    return F.greatest(n, F.lit(1)).cast("int")


def colspan(c: str | Column) -> Column:
    return span(c, MAX_COLSPAN)


def rowspan(c: str | Column) -> Column:
    return span(c, MAX_ROWSPAN)
