"""Connected components of an edge table by alternating star contraction, with every round written to the shared folder.

First each task turns the edges that it has into a forest of stars; where one task has them all, that is the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import in_arrow, materialise

#: Edges that a task turns into a forest at once.
EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components of the links a-b between places; no loops."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for x in batches:
        held.append((np.asarray(x.column("a")), np.asarray(x.column("b"))))
        n += x.num_rows
        if n >= EDGES:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return r["n"], r["x"], r["y"]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of the edges (a, b); loops and repeated edges may occur.

    Least neighbours are partial aggregates and are written before they are joined, so a hub of any degree is split by the
    planner's skew handling. The number of rounds is logarithmic in the size of the largest component."""
    stars = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = materialise(stars.repartition("a").transform(in_arrow, _forests, "a long, b long").distinct())
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = _state(following)
        stars = following
        if now == state:
            break
        state = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
