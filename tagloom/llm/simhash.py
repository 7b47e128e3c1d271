"""SimHash near-duplicates joined through pivot distance tables.

Each distinct fingerprint gets a row of Hamming distances to reference fingerprints (the pivots). By the triangle inequality two
fingerprints within t bits differ by at most t in every coordinate, so a pair whose greatest coordinate difference is above t is
discarded; survivors are verified on the 64 bits. Pairs are only looked for where they can be: the bits are cut into t + m pieces, and
two fingerprints within t bits agree on at least m of them, so each choice of m pieces gives a key, and pairs are formed within a key
only. m grows with the number of fingerprints, so that keys get longer and random pairs do not prevail. Keys held by many
fingerprints are dealt to tiles, each pair of tiles a task's work. Within a run of a key only a spanning forest of the verified links is
emitted.

near_dedup() joins wider SimHash prints of the sets of five-word shingles through pivot distance tables too, and decides each pair found by
the Jaccard similarity of the sets: at 0.8 two 64-bit fingerprints differ in up to 18 bits, as many as those of less similar texts do, and
no choice of pieces finds pairs so far apart. Its links are those of nearcopies.py.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; equal fingerprints form one class without
being paired; a null doc_id keeps its row and counts for no component_id unless all are null; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import addressed, in_arrow, materialise, quoted, slices, table
from tagloom.llm.components import components, forest
from tagloom.llm.nearcopies import similar_classes
from tagloom.llm.pivots import pivot_table, pivots

SEED = 42
#: Fingerprints of one key that a task pairs at once; more are dealt to tiles.
TILE = 2048


def simhash(text: bytes | None, shingle: int, seed: int = SEED) -> int:
    """Of the ASCII-lower-cased words; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(body)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[s:e], seed) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _printer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = np.array([simhash(x, shingle) for x in b.column("body").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (a signed long) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return rows.transform(in_arrow, _printer(shingle), "doc_id long, fp long")


def _tabler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    refs = pivots()
    for b in batches:
        t = pivot_table(np.asarray(b.column("fp")).view(np.uint64), refs)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in t], pa.binary())], [*b.schema.names, "distances"])


def pieces(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n pieces of the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def agreeing(n: int, most: int) -> int:
    """Pieces that make a key, for n fingerprints: the number by which keys and the random pairs that share them cost least.

    With m of them the bits are cut into most + m pieces, of which two fingerprints within `most` bits agree on m or more, and a key has
    64 m / (most + m) bits. A pair costs about a fiftieth of a key's row."""

    def cost(m: int) -> float:
        return comb(most + m, m) * (n + n * n / 2 ** (1 + 64 * m / (most + m)) / 50)

    return min(range(1, 9), key=cost)


def _keys(most: int, m: int):
    cut = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in pieces(most + m)]
    return F.array(*[F.xxhash64(F.lit(i), *(cut[x] for x in chosen)) for i, chosen in enumerate(combinations(range(most + m), m))])


def _paired(key: np.ndarray, prints: np.ndarray, dist: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links within runs of equal keys, as places; from pairs at distance 1, 2, ... in the run."""
    left = np.arange(len(key))
    columns = np.ascontiguousarray(dist.T).view(np.int8)
    step = 1
    while len(left := left[left + step < len(key)]):
        left = left[key[left] == key[left + step]]
        near = left
        for c in columns:
            near = near[np.abs(c[near] - c[near + step]) <= most]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= most]
        if len(near):
            yield near, near + step
        step += 1


def _linker(most: int):
    def linked(run, prints, dist):
        found = list(_paired(run, prints, dist, most))
        if not found:
            return None
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        own = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            dist = np.frombuffer(b"".join(b.column("distances").to_pylist()), np.uint8).reshape(n, -1)
            own = (np.asarray(b.column("run")), np.asarray(b.column("fp")).view(np.uint64), dist)
            held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own, strict=True))
            # Batches come sorted by run; the last run may go on.
            last = int(np.argmax(held[0] == held[0][-1]))
            if last and (out := linked(*(x[:last] for x in held))) is not None:
                yield out
            held = tuple(x[last:] for x in held)
        if held is not None and (out := linked(*held)) is not None:
            yield out

    return run


def links(prints: DataFrame, most: int, n_pieces: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (fp) which are linked by chains of pairs within `most` bits.

    The bits are cut into n_pieces; without a number, into as many as suit the number of fingerprints."""
    tabled = materialise(prints.select("fp").transform(in_arrow, _tabler, "fp long, distances binary"))
    keys = _keys(most, n_pieces - most if n_pieces else agreeing(tabled.count(), most))
    heavy = tabled.select(F.explode(keys).alias("key")).groupBy("key").count().where(F.col("count") > tile)
    heavy = materialise(heavy.select(F.col("key").alias("heavy_key"), F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    rows = tabled.select("fp", "distances", F.explode(keys).alias("key"))
    rows = rows.join(heavy, F.col("key") == F.col("heavy_key"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # A fingerprint of tile i goes to the pairs of tiles (i, j) for all j, the lesser first.
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("fp", "distances", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"))
    rows = rows.repartition("run").sortWithinPartitions("run")
    return rows.transform(in_arrow, _linker(most), "a long, b long").distinct()


def simhash_classes(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable through links within `most` bits) of each row."""
    printed = materialise(fingerprints(docs, shingle))
    prints = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(prints, most)).withColumnRenamed("node", "linked")
    nodes = materialise(found.join(prints, F.col("linked") == F.col("fp")).select("fp", "root", "first_id"))
    least = materialise(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    labels = materialise(nodes.join(least, "root").select("fp", "component_id"))
    classes = materialise(prints.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents without near copies, one of each group staying: that of the smallest doc_id (null last, then by its set of shingles), so
    that the order of the input's files decides nothing. Links are pairs of a Jaccard similarity of 5-word shingles of 0.8 or more.

    Null texts and texts without words are one group; columns of any name stay; an empty table gives an empty one."""
    rows, uid = addressed(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "uid"))
    kept = similar_classes(rows, uid).groupBy("root").agg(best.alias("best")).select(F.col("best.uid").alias("__kept"))
    return rows.join(kept, F.col(uid) == F.col("__kept"), "left_semi").select(*quoted(docs))


def op5_simhash(spark, sf_dir):
    out = simhash_classes(table(spark, sf_dir, "documents"), 4, 4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
