"""Table functions for LATERAL, and registration of everything for SQL."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf

from tagloom.functions import columns as C
from tagloom.operators import grid, render, scan, tree
from tagloom.operators.relation import ATTRS, NODE_SCHEMA, node_rows
from tagloom.plans.selector import Selector

_TOKEN_SCHEMA = f"ord int, kind string, name string, attrs {ATTRS}, self_closing boolean, data string, public_id string, system_id string, correct boolean"


@udtf(returnType=_TOKEN_SCHEMA, useArrow=True)
class HtmlTokens:
    def eval(self, html: str):
        if html is not None:
            yield from C.token_rows(html)


@udtf(returnType=_TOKEN_SCHEMA, useArrow=True)
class HtmlTokensState:
    def eval(self, html: str, state: str, last_start_tag: str):
        if html is not None:
            yield from C.token_rows(html, state, last_start_tag or "")


@udtf(returnType=NODE_SCHEMA, useArrow=True)
class HtmlNodes:
    def eval(self, html: str):
        if html is not None:
            yield from node_rows(tree.parse(html))


@udtf(returnType=f"ord int, node_id int, name string, attrs {ATTRS}, text string, outer_html string", useArrow=True)
class HtmlSelect:
    def __init__(self):
        self.known = {}

    def eval(self, html: str, selector: str):
        if html is None:
            return
        s = self.known.get(selector) or self.known.setdefault(selector, Selector(selector))
        t = tree.parse(html)
        for i, n in enumerate(s.select(t)):
            yield i, n, t.name[n], [{"name": k, "value": v} for k, v in t.attrs[n]], render.text_content(t, n), render.serialize(t, n)


@udtf(returnType="table_ix int, row_ix int, col_ix int, text string", useArrow=True)
class HtmlCells:
    def eval(self, html: str):
        for i, table in enumerate(grid.grids(html) if html is not None else ()):
            for j, row in enumerate(table):
                for k, text in enumerate(row):
                    yield i, j, k, text


@udtf(returnType="table_ix int, row_ix int, width int", useArrow=True)
class HtmlTableRows:
    def eval(self, html: str):
        for i, table in enumerate(grid.grids(html) if html is not None else ()):
            for j, row in enumerate(table):
                yield i, j, len(row)


TABLE_FUNCTIONS = {"html_tokens": HtmlTokens, "html_tokens_state": HtmlTokensState, "html_nodes": HtmlNodes, "html_select": HtmlSelect, "html_cells": HtmlCells, "html_table_rows": HtmlTableRows}


def _policy(tags: list[str] | None, attrs: list[str] | None, schemes: list[str] | None) -> render.Policy:
    """The default policy and more tags, attributes (tag:attribute, * for any tag) and schemes."""
    policy = render.Policy()
    for x in tags or ():
        policy = policy.allow_tag(x)
    for x in attrs or ():
        policy = policy.allow_attr(*x.split(":", 1))
    for x in schemes or ():
        policy = policy.allow_scheme(x)
    return policy


def _sanitize(html: str | None, tags=None, attrs=None, schemes=None) -> str | None:
    return None if html is None else render.sanitize(html, _policy(tags, attrs, schemes))


def _select(html: str | None, selector: str) -> list[str] | None:
    if html is None:
        return None
    t = tree.parse(html)
    return [render.serialize(t, n) for n in _selector(selector).select(t)]


def _any_match(html: str | None, selector: str) -> bool | None:
    return None if html is None else bool(_selector(selector).select(tree.parse(html)))


@functools.lru_cache(256)
def _selector(text: str) -> Selector:
    return Selector(text)


#: SQL bodies of what needs no Python.
_NBSP = "decode(X'C2A0', 'UTF-8')"
_TEXT = f"replace(replace(replace(replace(s, '&', '&amp;'), {_NBSP}, '&nbsp;'), '<', '&lt;'), '>', '&gt;')"
_CLEAN = r"translate(regexp_replace(s, '[\\x00-\\x20\\x7f]', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = f"regexp_extract({_CLEAN}, '^[^/?#:]*', 0)"
_NATIVE = {
    "html_escape_text(s STRING) RETURNS STRING": _TEXT,
    "html_escape_attr(s STRING) RETURNS STRING": f"""replace({_TEXT}, '"', '&quot;')""",
    "html_is_safe_url(s STRING, schemes ARRAY<STRING> DEFAULT array('http', 'https', 'mailto', 'tel')) RETURNS BOOLEAN": f"substr({_CLEAN}, length({_HEAD}) + 1, 1) <> ':' OR array_contains(schemes, {_HEAD})",
}


def register(spark: SparkSession) -> None:
    """All functions under their SQL names; those that Catalyst can express as SQL functions, without Python."""
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    for head, body in _NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    some = lambda f: lambda x: None if x is None else f(x)
    scalars = {
        "html_tokenize": (some(C.token_rows), C.TOKENS),
        "html_token_json": (some(lambda h: scan.token_json(scan.tokenize(h))), "string"),
        "html_decode_entities": (some(scan.decode_entities), "string"),
        "html_serialize": (some(lambda h: render.serialize(tree.parse(h))), "string"),
        "html_strip_tags": (some(lambda h: render.text_content(tree.parse(h))), "string"),
        "html_to_text": (some(lambda h: render.extract_text(tree.parse(h))), "string"),
        "html_sanitize": (_sanitize, "string"),
        "html_query": (_select, "array<string>"),
        "html_matches": (_any_match, "boolean"),
        "html_meta": (some(C.meta_row), C.META),
        "html_tables": (some(grid.grids), C.GRIDS),
    }
    for name, (f, kind) in scalars.items():
        spark.udf.register(name, udf(f, kind, useArrow=True))
