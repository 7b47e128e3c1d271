"""Column functions over HTML that are sequential by nature: Arrow-optimised Python functions, null in, null out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tagloom.operators import grid, render, scan, tree
from tagloom.operators.relation import ATTRS, parts
from tagloom.plans import matching
from tagloom.plans.matching import META
from tagloom.plans.selector import Selector

TOKENS = f"array<struct<ord: int, kind: string, name: string, attrs: {ATTRS}, self_closing: boolean, data: string, public_id: string, system_id: string, correct: boolean>>"
GRIDS = "array<array<array<string>>>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_parts(f: Callable, kind: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """f of each value of Arrow arrays, null in, null out; a part of bounded size at a time is Python objects and leaves before the next."""
    out = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for part in parts(values):
                yield pa.array([None if x is None else f(x) for x in values.slice(*part).to_pylist()], out)

    return run


def _call(f, kind: str, column: Column) -> Column:
    return F.arrow_udf(by_parts(f, kind), kind, ArrowUDFType.SCALAR_ITER)(column)


def token_row(i: int, token: tuple) -> tuple:
    kind, *rest = token
    name = attrs = closing = data = public = system = correct = None
    if kind == "StartTag":
        name, attrs, closing = rest[0], [{"name": k, "value": v} for k, v in rest[1]], rest[2]
    elif kind == "EndTag":
        name = rest[0]
    elif kind == "DOCTYPE":
        name, public, system, correct = rest
    else:
        data = rest[0]
    return i, kind, name, attrs, closing, data, public, system, correct


def token_rows(html: str, state: str | None = None, last: str = "") -> list[tuple]:
    found = scan.tokenize(html) if state is None else scan.tokenize_state(html, state, last)
    return [token_row(i, x) for i, x in enumerate(found)]


def _known(state: str | None) -> None:
    if state is not None and state not in scan.STATES:
        raise ValueError(f"unknown tokenizer state {state!r}")


def tokenize(c: str | Column, state: str | None = None, last_start_tag: str = "") -> Column:
    _known(state)
    return _call(partial(token_rows, state=state, last=last_start_tag), TOKENS, _col(c))


def decode_entities(c: str | Column) -> Column:
    c = _col(c)
    return F.when(F.instr(c, "&") == 0, c).otherwise(_call(scan.decode_entities, "string", c))


def serialize_html(c: str | Column) -> Column:
    return _call(lambda h: render.serialize(tree.parse(h)), "string", _col(c))


def strip_tags(c: str | Column) -> Column:
    return _call(lambda h: render.text_content(tree.parse(h)), "string", _col(c))


def html_to_text(c: str | Column) -> Column:
    return _call(lambda h: render.extract_text(tree.parse(h)), "string", _col(c))


def sanitize_html(c: str | Column, policy: render.Policy | None = None) -> Column:
    return _call(lambda h: render.sanitize(h, policy), "string", _col(c))


def meta_row(html: str) -> dict:
    return matching.meta_row(tree.parse(html))


def html_meta(c: str | Column) -> Column:
    return _call(meta_row, META, _col(c))


def meta_json(c: str | Column) -> Column:
    """The metadata as JSON: og is an array of pairs, what is missing is null."""
    return _call(lambda h: json.dumps(grid.meta(tree.parse(h)), ensure_ascii=False, separators=(",", ":")), "string", _col(c))


def token_json(c: str | Column, state: str | None = None, last_start_tag: str = "") -> Column:
    """The tokens as JSON arrays: kind, then name, attribute pairs and self-closing flag, or data, or what a DOCTYPE has."""
    _known(state)
    return _call(lambda h: scan.token_json(scan.tokenize(h) if state is None else scan.tokenize_state(h, state, last_start_tag)), "string", _col(c))


def html_tables(c: str | Column) -> Column:
    """Grids of all tables; pages without a table tag are not sent to Python."""
    c = _col(c)
    none = F.array().cast(GRIDS)
    return F.when(c.isNull(), F.lit(None).cast(GRIDS)).when(~c.rlike("(?i)<table"), none).otherwise(_call(grid.grids, GRIDS, c))


def html_query(c: str | Column, selector: str) -> Column:
    """Markup of the matching elements; a bad selector raises at once."""
    s = Selector(selector)

    def run(html: str) -> list[str]:
        t = tree.parse(html)
        return [render.serialize(t, n) for n in s.select(t)]

    return _call(run, "array<string>", _col(c))


def html_matches(c: str | Column, selector: str) -> Column:
    """Whether any element matches; a bad selector raises at once."""
    s = Selector(selector)
    return _call(lambda h: bool(s.select(tree.parse(h))), "boolean", _col(c))


def repair_utf8(c: str | Column) -> Column:
    """Binary to text, one U+FFFD for each ill-formed byte."""
    c = _col(c)
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(_call(lambda b: scan.repair_utf8(bytes(b)), "string", c))
