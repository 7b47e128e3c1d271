"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the four high bits of a 32-bit gear hash (h = 2 h + GEAR[byte]) are zero, at least MIN_CHUNK bytes after
the last cut and at most MAX_CHUNK, so cuts depend on the 32 bytes before them and come back after an insertion. Chunks are compared
by their BLAKE2b digests (16 bytes) over the whole table. A chunk is repeated if its digest occurred earlier in its text or in a document of
smaller doc_id. Runs of adjacent repeated chunks of MIN_RUN bytes or more are removed; shorter ones are chance and stay.

Texts are chunked twice: digests with the first document that has them are counted, and then only chunks that may be repeated (by a bit
set of bounded size) are located. What is shuffled is digests and places; nothing of a chunk is written.

Defined results: null texts have no chunks and stay null, empty texts stay empty; cuts inside a character are moved so that spans
hold whole characters; rows of the same doc_id count as one document; rows without a doc_id rank after all others (doc_id under 2**62),
by a hash of their text, and equal ones count as one; extra columns are ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import bit_set, bit_width, in_arrow, materialise, slices, table

MIN_CHUNK, MAX_CHUNK, CUT_BITS, MIN_RUN = 12, 256, 4, 128
GEAR = np.random.Generator(np.random.PCG64(71)).integers(0, 1 << 32, 256, np.uint32)
#: Bytes that are hashed at once.
PIECE = 1 << 20
#: Chunks of a batch.
ROWS = 50_000
#: Ranks from here on are those of rows without a doc_id.
NO_ID = 1 << 62


def gear(data: bytes) -> np.ndarray:
    """The hash after each byte, over the 32 bytes before it; by doubling the window five times."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            longer = h.copy()
            longer[shift:] += h[:-shift] << np.uint32(shift)
            h = longer
    return h


def candidates(data: bytes) -> list[int]:
    """Ends of possible chunks."""
    out: list[int] = []
    for at in range(0, len(data), PIECE):
        back = min(at, 31)
        h = gear(data[at - back : at + PIECE])[back:]
        out.extend((np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + (at + 1)).tolist())
    return out


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last of them the length."""
    possible, out, last, i = candidates(data), [], 0, 0
    n = len(data)
    while last < n:
        i = bisect_left(possible, last + MIN_CHUNK, i)
        last = min(possible[i] if i < len(possible) else n, last + MAX_CHUNK, n)
        out.append(last)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """rank, mark, start, end, digest and whether its text had it before, of each chunk."""
    for b in slices(batches):
        for rank, mark, data in zip(b.column("rank").to_pylist(), b.column("mark").to_pylist(), b.column("body").to_pylist(), strict=True):
            first, seen = 0, set()
            for end in cuts(data or b""):
                digest = hashlib.blake2b(data[first:end], digest_size=16).digest()
                yield rank, mark, first, end, digest, digest in seen
                seen.add(digest)
                first = end


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, i]) for i in (0, 1)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _chunks(batches)
    while held := list(islice(((x[0], x[4]) for x in rows), ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), *_halves([d for _, d in held])], ["rank", "h1", "h2"])


def _located(shared, width: int):
    names, kinds = ["rank", "mark", "at", "size", "again"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = shared.value, width - 1
        rows = ((r, m, s, e - s, again, d) for r, m, s, e, d, again in _chunks(batches) if bits[(at := int.from_bytes(d[:8], "little") & last) >> 3] >> (at & 7) & 1)
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in held], k) for i, k in enumerate(kinds)), *_halves([x[5] for x in held])], [*names, "h1", "h2"])

    return run


def _ranked(docs: DataFrame) -> DataFrame:
    """doc_id, rank (the order of documents), mark (of the text; with the rank it names what is the same document) and body."""
    mark = F.xxhash64("text")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(mark, 2))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rank.alias("rank"), mark.alias("mark"), F.col("text").cast("binary").alias("body"))


def runs(parts: list[tuple[int, int]], least: int = MIN_RUN) -> list[tuple[int, int]]:
    """Spans (start, end) of adjacent (at, size) that are long enough."""
    out: list[list[int]] = []
    for at, size in sorted(parts):
        if out and out[-1][1] == at:
            out[-1][1] = at + size
        else:
            out.append([at, at + size])
    return [(s, e) for s, e in out if e - s >= least]


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """data without the spans, which are first narrowed to whole characters."""
    kept, at, own = [], 0, []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(data[at:s])
        own.append((s, e))
        at = e
    return b"".join([*kept, data[at:]]), own


_OUT = "doc_id long, n_bytes long, removed_bytes long, spans array<struct<start: int, end: int>>, repeats_of array<long>, text string"


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for b in slices(batches):
        spans, removed, texts, sources = [], [], [], []
        for data, parts in zip(b.column("body").to_pylist(), b.column("parts").to_pylist(), strict=True):
            own = runs([(p["at"], p["size"]) for p in parts or []])
            left, own = without(data or b"", own)
            spans.append([{"start": s, "end": e} for s, e in own])
            removed.append(sum(e - s for s, e in own))
            texts.append(None if data is None else left.decode())
            inside = {p["first"] for p in parts or [] if any(s <= p["at"] + p["size"] // 2 < e for s, e in own)}
            sources.append(sorted(x for x in inside if x < NO_ID))
        n = [len(x or b"") for x in b.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(sources, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["doc_id", "n_bytes", "removed_bytes", "spans", "repeats_of", "text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed_bytes, spans (byte offsets removed), repeats_of (documents that hold the first
    occurrence of what was removed, as far as they have an id), text (what stays)."""
    rows = _ranked(docs)
    digests = rows.select("rank", "mark", "body").transform(in_arrow, _digests, "rank long, h1 long, h2 long")
    repeated = materialise(digests.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1").select("h1", "h2", "first"))
    width = bit_width(repeated.count())
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(repeated.select(F.col("h1").bitwiseAND(F.lit(width - 1)).alias("at")), width))
    located = rows.select("rank", "mark", "body").transform(in_arrow, _located(bits, width), "rank long, mark long, at int, size int, again boolean, h1 long, h2 long")
    found = located.join(repeated, ["h1", "h2"]).where("again OR rank > first")
    # Equal rows of one document find the same places.
    parts = found.groupBy(F.col("rank").alias("r"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("at", "size", "first")).alias("parts"))
    rows = rows.join(parts, (F.col("rank") == F.col("r")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "body", "parts")
    return rows.transform(in_arrow, _remover, _OUT)


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))
