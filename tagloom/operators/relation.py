"""The node relation: one row a node, in document order, so that tree questions become DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tagloom.operators.tree import ELEMENT, HIDDEN, KINDS, TEXT, Tree, parse

ATTRS = "array<struct<name: string, value: string>>"
NODE_SCHEMA = (
    f"node_id int, parent_id int, last_desc int, depth int, kind string, name string, data string, attrs {ATTRS},"
    " el_pos int, el_count int, is_blank boolean, hidden_by int, ancestors array<int>, table_id int"
)
_ARROW_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
#: Nodes of a batch.
BATCH = 50_000


def node_rows(t: Tree) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA."""
    n_nodes = len(t.kind)
    place, count, blank = [0] * n_nodes, [0] * n_nodes, [True] * n_nodes
    for n in range(1, n_nodes):
        if t.kind[n] == ELEMENT:
            count[t.parent[n]] += 1
            place[n] = count[t.parent[n]]
        if t.kind[n] in (ELEMENT, TEXT):
            blank[t.parent[n]] = False
    # hidden_by: the nearest element, from the node itself upwards, whose text is hidden
    hidden, above, table = [None] * n_nodes, [[]] * n_nodes, [None] * n_nodes
    for n in range(n_nodes):
        p = t.parent[n]
        element = t.kind[n] == ELEMENT
        if p >= 0:
            hidden[n] = n if element and t.name[n] in HIDDEN else hidden[p]
            above[n] = [p, *above[p]] if t.kind[p] == ELEMENT else above[p]
            table[n] = p if t.name[p] == "table" else table[p]
        yield (
            n, p if p >= 0 else None, t.last[n], t.depth[n], KINDS[t.kind[n]], t.name[n] if element else None, t.data[n] if t.kind[n] > ELEMENT else None,
            [{"name": k, "value": v} for k, v in t.attrs[n]], place[n] if element else None, count[p] if element else None, blank[n], hidden[n], above[n], table[n],
        )


_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _ARROW_ATTRS, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.int32())
_NAMES = [x.strip().split(" ")[0] for x in ("node_id parent_id last_desc depth kind name data attrs el_pos el_count is_blank hidden_by ancestors table_id").split()]


#: Pages of a batch, and their bytes, that a worker holds as objects at once; a longer page makes a batch of its own.
PAGES, PAGE_BYTES = 4096, 4 << 20


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Place and length of successive parts of texts, of bounded size."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= PAGES or held + size > PAGE_BYTES):
            yield first, i - first
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same pages (column __html) in batches of bounded size."""
    for b in batches:
        for first, n in parts(b.column("__html")):
            yield b.slice(first, n)


def _expand(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in page_batches(batches):
            rows: list[tuple] = []
            source: list[int] = []

            def batch(b=b):
                own = b.select(keys).take(pa.array(source, pa.int32()))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                return pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *columns], [*keys, *_NAMES])

            for i, html in enumerate(b.column("__html").to_pylist()):
                if html is None:
                    continue
                found = list(node_rows(parse(html)))
                rows += found
                source += [i] * len(found)
                if len(rows) >= BATCH:
                    yield batch()
                    rows, source = [], []
            if rows:
                yield batch()

    return run


def nodes(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The node relation of pages; a null page has no nodes. Each page is parsed once."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, pages[html_col].alias("__html")).mapInArrow(_expand(list(keys)), f"{kinds}, {NODE_SCHEMA}")

