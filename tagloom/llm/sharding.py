"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The source blocks are the input's partitions: its files, in blocks of at most BLOCK rows, or what was written once of an input that is
no table of files. The number of rows that each block sends to each shard is drawn exactly (multivariate hypergeometric: row sums are
the blocks' sizes, column sums the shards' sizes), so the shards' sizes are known before any row moves. Each block permutes its rows
locally, by places alone, and deals them out by its row of the matrix; rows then go to a random cell of their shard, cells being as many
as keep a task's work bounded, and are permuted again there. The result is a uniform permutation by one exchange; no task holds
a block's or a shard's rows, equal rows are dealt like others, and the number of tasks grows with the rows.

Law `rows`: the shards' row counts are at most one apart. The seed, the files and the order of rows in them decide the result, however
they are cut into tasks. The driver and the tasks hold the matrix, 4 bytes for each shard and block; blocks get larger when there would be
over MOST of them.

Defined results: null text has size 1 and the CRC of no bytes; null ids and repeated rows are rows as any other; an empty table gives
an empty result; extra columns named shard or slot are replaced, others stay (names may hold dots; those this module makes begin with __).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tagloom.llm.common import addressed, in_arrow, materialise, mixed, quoted, table

#: Rows of a block at least (the last one of a file has fewer), blocks besides one for each file at most, rows of a cell.
BLOCK, MOST, CELL = 1 << 16, 1 << 19, 1 << 16


def capacities(n_rows: int, n_shards: int) -> list[int]:
    """Sizes of the shards, one row apart at most."""
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


def communication_matrix(sizes: list[int], cells: list[int], seed: int) -> np.ndarray:
    """counts[block, cell] with the given sums, as a uniform permutation would have them."""
    if sum(sizes) != sum(cells):
        raise ValueError("blocks and cells hold different numbers of rows")
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(cells, np.int64)
    out = np.zeros((len(sizes), len(cells)), np.int64)
    for i, n in enumerate(sizes):
        # One block at a time from what the cells still hold; each draw splits by single hypergeometric draws.
        need, rest = int(n), int(left.sum())
        for j in range(len(left)):
            if not need:
                break
            rest -= int(left[j])
            got = need if not rest else _hypergeometric(rng, int(left[j]), rest, need)
            out[i, j] = got
            need -= got
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn; exact for any size."""
    if good < 1_000_000_000 and bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    if 2 * n > good + bad:
        return good - _hypergeometric(rng, good, bad, good + bad - n)
    if n <= 16:
        got = 0
        for i in range(n):
            got += rng.random() * (good + bad - i) < good - got
        return got
    # Beyond numpy's limit: include each item on its own with chance n / total, then correct the number, which takes about sqrt(n) more.
    chance = n / (good + bad)
    a, b = int(rng.binomial(good, chance)), int(rng.binomial(bad, chance))
    if a + b >= n:
        return a - _hypergeometric(rng, a, b, a + b - n)
    return a + _hypergeometric(rng, good - a, bad - b, n - a - b)


def _named(file: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A number for each block: its file and its place there."""
    return mixed(mixed(file) ^ part.astype(np.uint64))


def _dealer(blocks: np.ndarray, matrix: np.ndarray, block: int, seed: int):
    """shard and u (a random number) of rows that come with their address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            row = np.asarray(b.column("__row"))
            at = np.searchsorted(blocks, _named(np.asarray(b.column("__file")), row // block))
            shard = np.empty(len(at), np.int32)
            for k in np.unique(at).tolist():
                if k not in known:
                    # The block's permutation, as the shard of each place in it.
                    known = {k: np.random.Generator(np.random.PCG64([seed, k])).permutation(np.repeat(np.arange(matrix.shape[1], dtype=np.int32), matrix[k]))}
                own = at == k
                shard[own] = known[k][row[own] % block]
            u = mixed(at * (1 << 32) + row % block, seed + 1) >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(u.astype(np.int64))], [*b.schema.names, "__shard", "__u"])

    return run


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 17, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """df with shard (from 0) and slot (gapless from 0 within the shard). block: a power of two."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    own = quoted(df, "shard", "slot")
    rows, uid = addressed(df.select(*own), whole=True)
    rows = rows.select(*own, F.col(f"{uid}.file").alias("__file"), F.col(f"{uid}.row").alias("__row"))
    n = rows.count()
    while n > block * MOST:
        block *= 2
    found = rows.groupBy("__file", F.floor(F.col("__row") / block).alias("part")).agg(F.count("*").alias("n")).toArrow()
    names = _named(np.asarray(found.column("__file")), np.asarray(found.column("part")))
    order = np.argsort(names)
    shards = capacities(n, n_shards)
    matrix = communication_matrix(np.asarray(found.column("n"))[order].tolist(), shards, seed).astype(np.int32)
    deal = _dealer(names[order], matrix, block, seed)

    def dealt(df: DataFrame) -> DataFrame:
        out = df.transform(in_arrow, deal, StructType([*df.schema.fields]).add("__shard", IntegerType()).add("__u", LongType()))
        cells = F.element_at(F.array(*[F.lit(-(-x // cell) or 1) for x in shards]), F.col("__shard") + 1).cast("long")
        return out.withColumn("__cell", F.shiftrightunsigned(F.shiftrightunsigned("__u", 31) * cells, 32))

    sizes = dealt(rows.select("__file", "__row")).groupBy("__shard", "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialise(sizes.select(F.col("__shard").alias("__of"), F.col("__cell").alias("__at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first")))
    again = Window.partitionBy("__shard", "__cell").orderBy("__u", "__file", "__row")
    out = dealt(rows).withColumn("__rank", F.row_number().over(again))
    out = out.join(firsts, (F.col("__shard") == F.col("__of")) & (F.col("__cell") == F.col("__at")))
    return out.select(*own, F.col("__shard").alias("shard"), (F.col("__first") + F.col("__rank") - 1).cast("long").alias("slot"))


def op2_sharding(spark, sf_dir):
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shuffle_into_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
