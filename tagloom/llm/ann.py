"""Approximate nearest neighbours by inner product with randomly rotated one-bit codes.

Fit: c, the mean of all vectors. Each vector v is centred, and its direction o = (v - c) / |v - c| is turned by a random rotation; the
code is the sign of each coordinate, packed into bytes. With x = signs / sqrt(d), the unit vector that the code stands for, two scalars
are kept: |v - c| and <o, x>. For a query y with rotated centred direction t, <o, t> is estimated by <x, t> / <o, x>, with an error of at
most eps / sqrt(d - 1) * sqrt((1 - <o, x>^2) / <o, x>^2) up to the probability that eps sets. t is quantised to 4 bits with random
rounding, so that <x, t> comes from population counts of the packed code with the 4 bit planes.
<v, y> = |v - c| |y - c| <o, t> + <v, c> + <c, y> - <c, c>; a third scalar, <v, c>, completes it.

Search: queries in blocks against blocks of rows. The 2k rows of the largest estimates are ranked with the original vectors in double
precision; then every row whose upper bound reaches the k-th of them is reranked too. The k best of each block are merged. Every row has
a code; nothing is capped. A row (code, scalars and vector as it came) is sent once for every QUERY_BLOCK queries.

There is no coarse index: on directions that are spread evenly it saves nothing. Of 64 clusters of check_l's 51,282 vectors, a query had to
look into 32 to find 0.88 of its 20 nearest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those whose length is
not the most common one (the smaller of equals); rows with a null id take no part; of rows with the same vec_id each is a row of its own:
a candidate for the other, and a query with results and ranks of its own; ties go to the smaller vec_id; an empty table gives an
empty result; extra columns are ignored. A vector equal to the mean has an exact estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import in_arrow, materialise, mixed, table

#: Confidence of the error bound, in units of its standard deviation.
EPS = 1.9
#: Rows and queries of a block.
ROW_BLOCK, QUERY_BLOCK = 8192, 32_768
#: Queries whose estimates are held at once.
STRIP = 16
PLANES = 4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes (uint8) and the scalars |v - c|, <o, x>, <v, c>."""
    dim = len(centre)
    off = vectors - centre
    norm = np.sqrt((off * off).sum(axis=1))
    turned = (off / np.where(norm > 0, norm, 1)[:, None]) @ turn.T
    bits = turned >= 0
    match = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    return np.packbits(bits, axis=1), np.stack([norm, np.where(norm > 0, match, 1.0), (vectors * centre).sum(axis=1)], axis=1)


def words(packed: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, for population counts."""
    short = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, short)))).view(np.uint64)


def query_planes(directions: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes (plane, query, word), and least value, step and sum of the quantised coordinates, rounded as each query's seed says."""
    least = directions.min(axis=1)
    step = np.maximum((directions.max(axis=1) - least) / (2**PLANES - 1), 1e-300)
    noise = (mixed(mixed(seeds)[:, None] + np.arange(directions.shape[1], dtype=np.uint64), 1) >> np.uint64(11)) / 2.0**53
    level = np.clip(np.floor((directions - least[:, None]) / step[:, None] + noise), 0, 2**PLANES - 1).astype(np.uint8)
    planes = np.stack([words(np.packbits(level >> p & 1, axis=1)) for p in range(PLANES)])
    return planes, least, step, level.sum(axis=1, dtype=np.int64)


def set_levels(planes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each query and code, the sum of the quantised levels over the code's set bits: population counts by bit plane."""
    total = np.zeros((planes.shape[1], len(codes)), np.int32)
    for p in range(PLANES):
        for w in range(codes.shape[1]):
            total += np.bitwise_count(planes[p, :, w, None] & codes[None, :, w]).astype(np.int32) << p
    return total


def _search_block(q_rows, q_ids, q_own, q_vec, rows, ids, vec, packed, scalars, centre, turn, k: int, eps: float) -> Iterator[tuple]:
    dim = len(centre)
    codes, ones = words(packed), np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    norm, match, dot_c = scalars.T
    lean = norm / match
    spread = norm * eps / np.sqrt(max(dim - 1, 1)) * np.sqrt(np.maximum(1 - match**2, 0)) / match
    cc = float((centre * centre).sum())
    for at in range(0, len(q_rows), STRIP):
        y, own = q_vec[at : at + STRIP], q_own[at : at + STRIP]
        off = y - centre
        y_norm = np.sqrt((off * off).sum(axis=1))
        t = (off / np.where(y_norm > 0, y_norm, 1)[:, None]) @ turn.T
        planes, least, step, level_sum = query_planes(t, q_ids[at : at + STRIP])
        # <x, t> sqrt(d) = 2 (step * levels of set bits + least * set bits) - (step * all levels + least * d)
        over = set_levels(planes, codes) * (2 * step * y_norm)[:, None]
        over += (2 * least * y_norm)[:, None] * ones - ((step * level_sum + least * dim) * y_norm)[:, None]
        over *= lean / np.sqrt(dim)
        over += dot_c + ((y * centre).sum(axis=1) - cc)[:, None]
        # Rounding to 4 bits adds at most half a step a coordinate as standard deviation, independent and of mean 0.
        high = over + y_norm[:, None] * spread + (0.5 * eps * step * y_norm)[:, None] * lean + 1e-9
        itself = own[:, None] == rows[None, :]
        over[itself] = high[itself] = -np.inf
        first = min(2 * k, len(ids))
        likely = np.argpartition(over, len(ids) - first, axis=1)[:, len(ids) - first :]
        for i in range(len(own)):
            # The k-th of the likeliest in double precision: what cannot reach it is not reranked.
            exact = (vec[likely[i]] * y[i]).sum(axis=1)[~itself[i, likely[i]]]
            floor = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
            reach = high[i] >= floor
            reach[likely[i]] = True
            take = np.flatnonzero(reach & ~itself[i])
            near = vec[take] @ y[i]
            if len(take) > k:  # all but what rounding cannot lift into the k best
                least_near = np.partition(near, len(take) - k)[len(take) - k]
                take = take[near >= least_near - 1e-9 * max(1.0, abs(least_near))]
            exact = (vec[take] * y[i]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            best = np.lexsort((ids[take], -exact))[:k]
            yield int(q_rows[at + i]), ids[take][best], exact[best]


def _list_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, vector (array of floats if it came so, else of doubles): the rows that take part."""
    kind = "float" if df.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _partial_sums(dim: int):
    def run(batches):
        total = np.zeros(dim)
        for b in batches:
            total += _list_matrix(b.column("vector"), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["total"])

    return run


def _coder(centre, turn):
    def run(batches):
        for b in batches:
            packed, scalars = encode(_list_matrix(b.column("vector"), len(centre)), centre, turn)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(scalars.tolist(), pa.list_(pa.float64()))], ["vec_id", "vector", "code", "scalars"])

    return run


def build_index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Every usable vector with its code and scalars; the centre and the rotation (both bounded by the dimension)."""
    counts = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    kind = vectors.schema["vector"].dataType.simpleString()
    if not counts:
        return vectors.select("vec_id", "vector", F.lit(b"").alias("code"), F.array().cast("array<double>").alias("scalars")), np.zeros(0), np.zeros((0, 0))
    dim, n = counts[0]["dim"], counts[0]["count"]
    vectors = vectors.where(F.size("vector") == dim)
    sums = vectors.select("vector").transform(in_arrow, _partial_sums(dim), "total array<double>").select(F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    centre, turn = np.array([r["s"] for r in sums]) / n, rotation(dim)
    return vectors.transform(in_arrow, _coder(centre, turn), f"vec_id long, vector {kind}, code binary, scalars array<double>"), centre, turn


def _searcher(centre, turn, k, eps):
    dim = len(centre)

    def run(key, left, right):
        q, r = left, right
        if not q.num_rows or not r.num_rows:
            return _found([])
        rows, ids, vec = np.asarray(r.column("row")), np.asarray(r.column("vec_id")), _list_matrix(r.column("vector").combine_chunks(), dim)
        packed = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        scalars = _list_matrix(r.column("scalars").combine_chunks(), 3)
        asked = (*(np.asarray(q.column(c)) for c in ("query_row", "query_id", "own")), _list_matrix(q.column("vector").combine_chunks(), dim))
        return _found(list(_search_block(*asked, rows, ids, vec, packed, scalars, centre, turn, k, eps)))

    return run


def _found(rows: list[tuple]) -> pa.Table:
    """Of (query row, ids, scores)."""
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
    return pa.table({"query_row": cat([np.full(len(i), q, np.int64) for q, i, _ in rows], np.int64), "vec_id": cat([i for _, i, _ in rows], np.int64), "score": cat([s for _, _, s in rows], np.float64)})


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, eps: float = EPS, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query other than its own row (one of its vec_id and vector, if there is one).

    queries and vectors: vec_id and vector, as usable() returns them. Both are cut into blocks by a hash of the row; each pair of blocks is
    one task's work, of bounded size."""
    index, centre, turn = build_index(vectors)
    index = materialise(index.withColumn("row", F.monotonically_increasing_id()))
    queries = materialise(queries.where(F.size("vector") == len(centre)).withColumn("query_row", F.monotonically_increasing_id()))
    n_rows, n_queries = index.count(), queries.count()
    rows_in, queries_in = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    if not len(centre) or not n_queries:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = index.groupBy(F.col("vec_id").alias("own_id"), F.xxhash64("vector").alias("own_hash")).agg(F.min("row").alias("own"))
    asked = queries.join(own, (F.col("vec_id") == F.col("own_id")) & (F.xxhash64("vector") == F.col("own_hash")), "left")
    asked = materialise(asked.select("query_row", F.col("vec_id").alias("query_id"), F.coalesce("own", F.lit(-1)).alias("own"), "vector"))
    block = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(n)).cast("int")
    q = asked.withColumn("qb", block(F.col("query_row"), queries_in, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rows_in - 1))))
    r = index.select("row", "vec_id", "vector", "code", "scalars", block(F.col("row"), rows_in, 2).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(queries_in - 1))).alias("qb"))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(_searcher(centre, turn, k, eps), "query_row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = asked.select(F.col("query_row").alias("asked"), "query_id")
    return best.join(ids, F.col("query_row") == F.col("asked")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir):
    v = usable(table(spark, sf_dir, "embeddings"))
    return search(v.where("vec_id % 20 = 0"), v, 20)
