"""Selectors and facts over a table of pages: each page is parsed once, matched in its tree, and only what was asked for leaves the worker.

For a node relation that is written and read by many queries see relational.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tagloom.operators import grid, render
from tagloom.operators.relation import ATTRS, page_batches
from tagloom.operators.tree import Tree, parse
from tagloom.plans.selector import Selector

#: What can be asked of a matching element: its type and how it is found.
FIELDS: dict[str, tuple[str, Callable[[Tree, int], object]]] = {
    "name": ("string", lambda t, n: t.name[n]),
    "attrs": (ATTRS, lambda t, n: [{"name": k, "value": v} for k, v in t.attrs[n]]),
    "last_desc": ("int", lambda t, n: t.last[n]),
    "depth": ("int", lambda t, n: t.depth[n]),
    "text": ("string", render.text_content),
    "outer_html": ("string", render.serialize),
}
#: Rows of a batch.
ROWS = 20_000


def _schema(pages: DataFrame, keys: tuple[str, ...], more: list[tuple[str, str]]) -> StructType:
    own = [f for k in keys for f in pages.schema.fields if f.name == k]
    return StructType([*own, *(StructField(name, _parse_datatype_string(kind)) for name, kind in more)])


def _flat(pages: DataFrame, html_col: str, keys: tuple[str, ...], more: list[tuple[str, str]], rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """The keys of each page with the rows that rows_of(html) returns."""
    kinds = [to_arrow_type(_parse_datatype_string(kind)) for _, kind in more]
    names = [name for name, _ in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in page_batches(batches):
            rows: list[tuple] = []
            source: list[int] = []

            def batch(b=b):
                own = b.select(list(keys)).take(pa.array(source, pa.int32()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *columns], [*keys, *names])

            for i, html in enumerate(b.column("__html").to_pylist()):
                found = [] if html is None else rows_of(html)
                rows += found
                source += [i] * len(found)
                if len(rows) >= ROWS:
                    yield batch()
                    rows, source = [], []
            if rows:
                yield batch()

    return pages.select(*keys, pages[html_col].alias("__html")).mapInArrow(run, _schema(pages, keys, more))


def matches(pages: DataFrame, selector: str, fields: tuple[str, ...] = ("name", "attrs"), within: str | None = None, html_col: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, ord (from 0 in each page), node_id, el_pos and the fields of each element that matches, in document order.

    `within`: only elements below an element that matches this selector. A bad selector raises at once; a null page has no rows."""
    wanted, scope = Selector(selector), Selector(within) if within is not None else None
    getters = [FIELDS[f][1] for f in fields]

    def rows_of(html: str) -> list[tuple]:
        t = parse(html)
        found, place = wanted.placed(t)
        if scope is not None:
            below = set()
            for s in scope.select(t):
                below.update(range(s + 1, t.last[s] + 1))
            found = [n for n in found if n in below]
        return [(i, n, place[n], *(f(t, n) for f in getters)) for i, n in enumerate(found)]

    more = [("ord", "int"), ("node_id", "int"), ("el_pos", "int"), *((f, FIELDS[f][0]) for f in fields)]
    return _flat(pages, html_col, keys, more, rows_of)


#: A fact is a type and how it is found in a tree.
Fact = tuple[str, Callable[[Tree], object]]


def count(selector: str) -> Fact:
    s = Selector(selector)
    return "bigint", lambda t: len(s.select(t))


def first_text(selector: str) -> Fact:
    """Text of the first match, null without one."""
    s = Selector(selector)

    def run(t: Tree) -> str | None:
        found = s.select(t)
        return render.text_content(t, found[0]) if found else None

    return "string", run


META = "struct<title: string, description: string, canonical: string, lang: string, og: array<struct<property: string, content: string>>>"


def meta_row(t: Tree) -> dict:
    found = grid.meta(t)
    return found | {"og": [{"property": k, "content": v} for k, v in found["og"]]}


def meta() -> Fact:
    return META, meta_row


def size() -> Fact:
    """Number of nodes, the document among them; 1 for an empty page."""
    return "int", lambda t: len(t.kind)


def facts(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id",), **columns: Fact) -> DataFrame:
    """keys and a column for each fact, one row for each page that is not null, from one parse."""
    getters = [f for _, f in columns.values()]

    def rows_of(html: str) -> list[tuple]:
        t = parse(html)
        return [tuple(f(t) for f in getters)]

    return _flat(pages, html_col, keys, [(name, kind) for name, (kind, _) in columns.items()], rows_of)


def table_rows(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, table_ix, row_ix and cells: one row for each row of each table, with the texts of its cells."""

    def rows_of(html: str) -> list[tuple]:
        return [(i, j, row) for i, table in enumerate(grid.grids(html)) for j, row in enumerate(table)]

    return _flat(pages, html_col, keys, [("table_ix", "int"), ("row_ix", "int"), ("cells", "array<string>")], rows_of)
