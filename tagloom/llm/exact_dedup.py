"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting white space (0x20, 0x09-0x0D). Its bytes, read as one number in base 256, are taken modulo
a 127-bit prime. Fingerprints compose: F(a + b) = F(a) * 256**len(b) + F(b), so pieces of huge documents are hashed in
parallel and put together by length-shifted arithmetic: one pass cuts a huge text (and takes its SHA-256, which nothing can parallelise),
its pieces are dealt to all tasks, hashed there and composed. Texts of equal fingerprint and length are then compared chunk by
chunk (the least and the greatest chunk of each place must agree); a group that fails is split by SHA-256.

Defined results: null text counts as empty; a null doc_id ranks after all others; of repeated rows exactly one is kept; extra
columns are ignored by the query and kept by kept_documents(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACE_BYTES, UID, addressed, bit_set, bit_width, in_arrow, materialise, quoted, slices, text_or_empty

#: A prime of 127 bits.
MODULUS = 89410556338362034677157363187998816313
#: Bytes hashed at once.
CHUNK = 1 << 16
#: Documents of more characters are cut into pieces of so many bytes, which are hashed in parallel.
HUGE = 1 << 15
_FULL_SHIFT = pow(256, CHUNK, MODULUS)


def fingerprint(data: bytes) -> int:
    """Of one piece, at once."""
    return int.from_bytes(data, "big") % MODULUS


def compose(left: int, right: int, right_len: int) -> int:
    return (left * (_FULL_SHIFT if right_len == CHUNK else pow(256, right_len, MODULUS)) + right) % MODULUS


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    return (data[i : i + size] for i in range(0, len(data), size))


def fingerprint_stream(data: bytes, size: int = CHUNK) -> int:
    total = 0
    for c in chunks(data, size):
        total = compose(total, fingerprint(c), len(c))
    return total


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE_BYTES)


def _pack(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        prints, sizes, shas = [], [], []
        for raw in b.column("body").to_pylist():
            data = normalised(raw)
            prints.append(_pack(fingerprint_stream(data)))
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("n_points"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["uid", "doc_id", "n_points", "fp", "n_bytes", "sha"])


def _cutter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i, raw in enumerate(b.column("body").to_pylist()):
                data = normalised(raw)
                parts = list(chunks(data, size)) or [b""]
                own = b.slice(i, 1).take(pa.array([0] * len(parts), pa.int32()))
                more = (pa.array([hashlib.sha256(data).hexdigest()] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("uid", "doc_id", "n_points")), *more], ["uid", "doc_id", "n_points", "sha", "piece", "data"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data = b.column("data").to_pylist()
        prints = (pa.array([_pack(fingerprint_stream(x)) for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:5], *prints], [*b.schema.names[:5], "fp", "n_bytes"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints, sizes = [], []
        for parts in b.column("parts").to_pylist():
            total = size = 0
            for p in sorted(parts, key=lambda x: x["piece"]):
                total = compose(total, int.from_bytes(p["fp"], "big"), p["n_bytes"])
                size += p["n_bytes"]
            prints.append(_pack(total))
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("n_points"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), b.column("sha")], ["uid", "doc_id", "n_points", "fp", "n_bytes", "sha"])


_PRINTED = f"uid {UID}, doc_id long, n_points long, fp binary, n_bytes long, sha string"


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """uid, doc_id, n_points (code points), fp, n_bytes and sha of the normalised text of each row (uid, doc_id, text)."""
    rows = docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("n_points"), text_or_empty().cast("binary").alias("body"))
    small = rows.where(F.col("n_points") <= huge).transform(in_arrow, _whole, _PRINTED)
    known = f"uid {UID}, doc_id long, n_points long, sha string, piece int"
    cut = rows.where(F.col("n_points") > huge).transform(in_arrow, _cutter(huge), f"{known}, data binary")
    hashed = cut.repartition("uid", "piece").transform(in_arrow, _pieces, f"{known}, fp binary, n_bytes long")
    parts = hashed.groupBy("uid", "doc_id", "n_points", "sha").agg(F.collect_list(F.struct("piece", "fp", "n_bytes")).alias("parts"))
    return small.unionByName(parts.transform(in_arrow, _joined, _PRINTED))


def _chunk_rows(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in slices(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = 0
            for raw in b.column("body").to_pylist():
                data = normalised(raw)
                fp = fingerprint_stream(data)
                at = fp % width
                if not bits[at >> 3] >> (at & 7) & 1:
                    continue
                for i, c in enumerate(chunks(data)):
                    for column, value in zip(out, (_pack(fp), len(data), i, c), strict=True):
                        column.append(value)
                    held += len(c)
                if held > 1 << 23:
                    yield _chunk_batch(out)
                    out, held = ([], [], [], []), 0
            if out[0]:
                yield _chunk_batch(out)

    return run


def _chunk_batch(out) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["fp", "n_bytes", "chunk_no", "chunk"])


def _low(fp, width: int):
    """fp modulo a power of two up to 2**28, from the last bytes."""
    return F.pmod(F.conv(F.right(F.hex(fp), F.lit(8)), 16, 10).cast("long"), F.lit(width))


def collided(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(fp, n_bytes) of the groups of two or more whose texts differ in some chunk.

    Only texts that a bit set of the repeated fingerprints lets through are shuffled; the set has at most 2**28 bits (32 MB)."""
    repeated = groups.where("group_size > 1").select("fp", "n_bytes")
    width = bit_width(repeated.count())
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(repeated.select(_low("fp", width).alias("at")), width))
    rows = docs.select(text_or_empty().cast("binary").alias("body")).transform(in_arrow, _chunk_rows(bits, width), "fp binary, n_bytes long, chunk_no int, chunk binary")
    spread = rows.groupBy("fp", "n_bytes", "chunk_no").agg((F.min("chunk") != F.max("chunk")).alias("differ"))
    return spread.where("differ").select("fp", "n_bytes").distinct().join(repeated, ["fp", "n_bytes"], "left_semi")


def decided(docs: DataFrame, uid: str, huge: int = HUGE) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept and text_sha256 for each row of docs, whose column `uid` tells them apart."""
    printed = materialise(fingerprints(docs.select(F.col(uid).alias("uid"), "doc_id", "text"), huge))
    groups = printed.groupBy("fp", "n_bytes").agg(F.count("*").alias("group_size"))
    groups = materialise(groups.where("group_size > 1"))
    bad = materialise(collided(docs, groups))
    if bad.isEmpty():
        keyed = printed.withColumn("part", F.lit(""))
    else:
        keyed = printed.join(bad.withColumn("bad", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise("")).drop("bad")
    key = ["fp", "n_bytes", "part"]
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    chosen = keyed.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size"))
    chosen = chosen.select(*key, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    out = keyed.join(chosen, key)
    return out.select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """One row per row of docs: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row of most code points stays, then that of the smallest doc_id."""
    return decided(*addressed(docs.select("doc_id", "text")), huge)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, uid = addressed(docs)
    kept = decided(rows, uid).where("kept").select(F.col("uid").alias("__kept"))
    return rows.join(kept, F.col(uid) == F.col("__kept"), "left_semi").select(*quoted(docs))


def op7_exact_dedup(spark, sf_dir):
    from tagloom.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT *, sha256(body) AS text_sha256 FROM t
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""
