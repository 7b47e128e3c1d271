"""What the corpus operators share: materialised tables, text columns and letter codes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (Spark and Python regex syntax).
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
FOLDS = 5


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a session of local mode without one gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + _local_root()
    return root.rstrip("/")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tagloom-")


def materialise(df: DataFrame) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: cuts lineage, and a lost executor costs no recomputation.

    The files go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tagloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without]


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Of a row's address: its file and its place there.
UID = "struct<file: bigint, row: bigint>"


def _of_files(df: DataFrame, whole: bool) -> bool:
    """Whether df is rows of one table of files, without joins, unions or the like (and without filters, if whole)."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias") or node.nodeName() == "Filter" and not whole:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in df.columns}


def addressed(df: DataFrame, whole: bool = False) -> tuple[DataFrame, str]:
    """df with one more column, and that column's name: an address of the row that is the same in every read.

    Rows of files have their file and their place in it, however the files are cut into tasks. All other rows are written once with a number.
    If `whole`, the places of a file (or task) have no gaps."""
    name = fresh(df, "__uid")
    if _of_files(df, whole):
        where = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return df.select("*", where.alias(name)), name
    where = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return materialise(df.select("*", where.alias(name))), name


#: Bytes of an Arrow batch between the JVM and a Python worker; a single longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow with batches of bounded size, whatever the length of the texts (a setting of the session, read when the plan runs)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    names = df.columns
    if all(c.replace("_", "a").isalnum() for c in names):
        return df.mapInArrow(f, schema)
    # mapInArrow cannot read columns whose names hold dots and the like; the worker has the names.
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(lambda batches: f(b.rename_columns(names) for b in batches), schema)


#: Rows of a batch that Python holds as objects at once.
SLICE = 512


def slices(batches):
    """The same rows in smaller batches, so that a worker never holds thousands of texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        at = np.asarray(b.column("at"))
        for block in np.unique(at >> 15):
            held = blocks.setdefault(int(block), np.zeros(4096, np.uint8))
            own = at[at >> 15 == block] & 0x7FFF
            np.bitwise_or.at(held, own >> 3, (1 << (own & 7)).astype(np.uint8))
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(blocks.keys(), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])


def bit_width(n: int) -> int:
    """Bits for a set of n places: 16 to 32 a place, and at most 2**28 (32 MB); beyond, the set lets more through but never less."""
    return min(max(1 << 20, 1 << (16 * n).bit_length()), 1 << 28)


def bit_set(places: DataFrame, width: int) -> bytes:
    """The bits at the places (column `at`, below width)."""
    bits = bytearray(width // 8)
    blocks = places.select("at").repartition(F.shiftright("at", 15)).transform(in_arrow, _positions, "block long, bits binary")
    for row in blocks.toLocalIterator():
        whole = int.from_bytes(bits[row.block * 4096 : (row.block + 1) * 4096], "little") | int.from_bytes(row.bits, "little")
        bits[row.block * 4096 : (row.block + 1) * 4096] = whole.to_bytes(4096, "little")
    return bytes(bits)


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def word_count(col: str | Column = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def unit(*cols: Column, seed: int = 0) -> Column:
    """A number in the open interval (0, 1) that depends on the columns and the seed alone."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(2**52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- letter codes: 16 bits a character, for packed n-grams of up to four ------------------------------------------

BOUNDARY = 1
CODE_BITS = 16


@functools.cache
def _code_table() -> np.ndarray:
    """Code of each code point: BOUNDARY for what is no letter; letters of the basic plane all differ, those beyond it share their codes."""
    t = np.full(0x110000, BOUNDARY, np.uint16)
    letters = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()], np.int64)
    t[letters] = 2 + letters % 65_533
    return t


def code_runs(text: str, keep: int, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """Codes of the lower-cased text between boundaries, runs of non-letters as one boundary.

    A long text comes in pieces; each piece starts with the last `keep` codes of the one before, so that every n-gram of
    keep + 1 codes lies in exactly one piece."""
    t = _code_table()
    carry = np.array([BOUNDARY], np.uint16)
    last = len(text)
    for at in range(0, max(last, 1), piece):
        raw = t[np.frombuffer(text[at : at + piece].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + piece >= last:
            raw = np.append(raw, np.uint16(BOUNDARY))
        codes = np.concatenate([carry, raw])
        stay = np.ones(len(codes), bool)
        stay[len(carry) :] = (raw != BOUNDARY) | (codes[len(carry) - 1 : -1] != BOUNDARY)
        codes = codes[stay]
        yield codes
        carry = codes[-keep:] if keep else codes[:0]
        if not len(carry):
            carry = np.array([BOUNDARY], np.uint16)


def packed(codes: np.ndarray, n: int) -> np.ndarray:
    """n-grams of codes as int64, the first character in the highest bits (that of the sign, if n is 4)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    c = codes.astype(np.int64)
    k = c[:m].copy()
    for j in range(1, n):
        k <<= CODE_BITS
        k |= c[j : j + m]
    return k


def mixed(keys: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit mix of packed n-grams (splitmix finaliser), uint64."""
    z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
