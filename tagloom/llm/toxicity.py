"""Toxicity by class-conditional Kneser-Ney models of character sequences.

Text becomes a sequence of letters with one boundary for each run of other characters. Two models of order 4, one of toxic and one of
ordinary labelled texts, give each letter a probability after the three before it. Both back off to one interpolated Kneser-Ney
model of the pooled counts (orders 4, 3, 2 and 1; lower orders count distinct left contexts), so an expression that is rare in either class
is smoothed by shared backoff counts and says little, while one that only toxic texts hold says much. A document's log-likelihoods
under the models are compared after normalisation by length: their difference over the number of letters is the input of a logistic
calibration.

Counts come from all labelled texts of folds 2 to 4, the calibration from those of fold 1; fold 0 is held out. Counts and model are made
by Spark. Each sequence keeps its own log ratio: up to BROADCAST_SEQUENCES of them every task holds two hash tables of sequences and ratios
that grow with their number (24 to 48 bytes a sequence); beyond, the sequences of the texts are joined with the ratios.

Defined results: null and empty texts get the score of a text without evidence; labels that are null or other than 0 and 1 are not
learned from, of several labels of a doc_id the greatest counts; without both labels in the training rows every score is the share of
toxic training labels, 0 if there are none; repeated rows get the same score; extra columns are ignored by the query and kept by
clean_documents(), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import CODE_BITS, UID, addressed, code_runs, fold, fresh, in_arrow, materialise, mixed, packed, quoted, slices, table, text_or_empty

#: Letters of a sequence, and the orders that it backs off to.
ORDER, LOWER = 4, (3, 2, 1)
DISCOUNT = 0.5
#: Sequences up to this number are held by every task; more are joined by a shuffle.
BROADCAST_SEQUENCES = 2_000_000
#: Labels up to this number are broadcast (about 75 bytes each, 38 MB); more are joined by a shuffle of the learned texts.
BROADCAST_LABELS = 500_000
#: Rows of the calibration fold to fit two numbers on: an expected bound, drawn by a hash of the id.
CALIBRATION_ROWS = 50_000
#: Letters counted at once.
BUFFER = 1 << 20


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled documents outside fold 0."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = materialise(marks.where(fold() != 0))
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.select("doc_id", text_or_empty().alias("text")).where(fold() != 0).join(marks, "doc_id")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held):
        both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in held]
        keys, where = np.unique(np.concatenate(both), return_inverse=True)
        ordinary = np.bincount(where[: len(both[0])], minlength=len(keys))
        toxic = np.bincount(where[len(both[0]) :], minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(toxic.astype(np.int64)), pa.array(ordinary.astype(np.int64))], ["key", "t", "o"])

    held, size = ([], []), 0
    for b in slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            for codes in code_runs(text, ORDER - 1):
                held[toxic].append(packed(codes, ORDER))
                size += len(codes)
                if size >= BUFFER:
                    yield flush(held)
                    held, size = ([], []), 0
    if size:
        yield flush(held)


def _pooled(level: DataFrame, lower: DataFrame | None, below: int | None) -> DataFrame:
    """level (key, c) with b: the interpolated probability of its last character after the others; lower has the order `below`."""
    after = Window.partitionBy(F.shiftright("key", CODE_BITS))
    level = level.withColumn("s", F.sum("c").over(after)).withColumn("n", F.count("*").over(after))
    if lower is None:
        back = F.lit(1 / (1 << CODE_BITS))
    else:
        level = level.withColumn("__low", F.col("key").bitwiseAND(F.lit((1 << CODE_BITS * below) - 1)))
        level = level.join(lower.select(F.col("key").alias("__low"), F.col("b").alias("__b")), "__low").drop("__low")
        back = F.col("__b")
    return level.withColumn("b", (F.col("c") - DISCOUNT + DISCOUNT * F.col("n") * back) / F.col("s")).drop("__b", "s", "n")


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, llr, c) of the sequences of ORDER letters, and (key, llr, c) of their contexts for sequences never seen."""
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << CODE_BITS * n) - 1)).alias("key")
    orders, above = {}, counts
    for n in LOWER:
        orders[n] = above = materialise(above.groupBy(low(n)).agg(F.count("*").alias("n")))
    level, below = None, None
    for n in reversed(LOWER):
        # A sequence's distinct left contexts are the rows of the next order that end in it.
        level, below = materialise(_pooled(orders[n].withColumnRenamed("n", "c"), level, below)), n
    top = _pooled(counts.withColumn("c", F.col("t") + F.col("o")), level, below)
    after = Window.partitionBy(F.shiftright("key", CODE_BITS))
    for x in "to":
        top = top.withColumn(f"s{x}", F.sum(x).over(after)).withColumn(f"n{x}", F.sum((F.col(x) > 0).cast("int")).over(after))
    top = materialise(top)

    def chance(x: str):
        own = (F.greatest(F.col(x) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"n{x}") * F.col("b")) / F.col(f"s{x}")
        return F.when(F.col(f"s{x}") > 0, own).otherwise(F.col("b"))

    spare = lambda x: F.when(F.col(f"s{x}") > 0, DISCOUNT * F.col(f"n{x}") / F.col(f"s{x}")).otherwise(F.lit(1.0))
    grams = top.select("key", (F.log(chance("t")) - F.log(chance("o"))).cast("float").alias("llr"))
    contexts = top.groupBy(F.shiftright("key", CODE_BITS).alias("key")).agg(F.first(F.log(spare("t")) - F.log(spare("o"))).cast("float").alias("llr"))
    return grams, contexts


class Ratios:
    """Sequences and their ratios by open addressing, between a quarter and a half of the slots filled."""

    def __init__(self, rows: DataFrame):
        got = rows.toArrow()
        keys, values = np.asarray(got.column("key")), np.asarray(got.column("llr"))
        self.last = (2 << max(3, len(keys).bit_length())) - 1
        self.keys, self.values = np.full(self.last + 1, -1, np.int64), np.full(self.last + 1, np.nan, np.float32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 1) & np.uint64(self.last)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ratios, NaN where there are none."""
        at = self._home(keys)
        held, out = self.keys[at], self.values[at]
        left = np.flatnonzero(held != keys)
        while len(left):
            out[left] = np.nan
            left = left[self.keys[at[left]] >= 0]
            at[left] = (at[left] + 1) & self.last
            out[left] = self.values[at[left]]
            left = left[self.keys[at[left]] != keys[left]]
        return out


def evidence(text: str, grams: Ratios, contexts: Ratios) -> tuple[float, int]:
    """Toxic minus ordinary log-likelihood, and the number of letters that it is a sum over."""
    total, n = 0.0, 0
    for codes in code_runs(text, ORDER - 1):
        keys = packed(codes, ORDER)
        if not len(keys):
            continue
        got = grams.find(keys)
        unseen = np.flatnonzero(np.isnan(got))
        if len(unseen):
            got[unseen] = np.nan_to_num(contexts.find(keys[unseen] >> CODE_BITS))
        total += float(got.sum(dtype=np.float64))
        n += len(keys)
    return total, n


def _scorer(model, kept: list[str], name: str, out: list[str]):
    def run(batches):
        grams, contexts = (x.value for x in model)
        for b in slices(batches):
            found = [evidence(x, grams, contexts) for x in b.column(name).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.int64())], [*kept, *out])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for i, text in enumerate(b.column("text").to_pylist()):
            for codes in code_runs(text, ORDER - 1):
                keys, n = np.unique(packed(codes, ORDER), return_counts=True)
                own = b.column("uid").slice(i, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                yield pa.RecordBatch.from_arrays([own, pa.array(keys), pa.array(n.astype(np.int64))], ["uid", "key", "n"])


def weighed(rows: DataFrame, grams: DataFrame, contexts: DataFrame, name: str, out: list[str]) -> DataFrame:
    """rows without the text column `name`, with the log ratio and the number of letters of it (named as `out` says) by joins with the ratios."""
    rows, uid = addressed(rows)
    found = rows.select(F.col(uid).alias("uid"), F.col(name).alias("text")).transform(in_arrow, _sequences, f"uid {UID}, key long, n long")
    found = found.join(grams, "key", "left").withColumn("__context", F.shiftright("key", CODE_BITS))
    backed = contexts.select(F.col("key").alias("__context"), F.col("llr").alias("__back"))
    found = found.join(backed, "__context", "left").withColumn("llr", F.coalesce("llr", "__back", F.lit(0.0)).cast("double"))
    key = fresh(rows, "__row")
    sums = materialise(found.groupBy(F.col("uid").alias(key)).agg(F.sum(F.col("llr") * F.col("n")).alias(out[0]), F.sum("n").alias(out[1])))
    kept = quoted(rows, name, uid)
    return rows.join(sums, F.col(uid) == F.col(key), "left").select(*kept, F.coalesce(out[0], F.lit(0.0)).alias(out[0]), F.coalesce(out[1], F.lit(0).cast("long")).alias(out[1]))


def _inputs(llr: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), llr / n], axis=1)


def calibrate(llr: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Weights of a constant and the normalised difference, by Newton's method with a small ridge."""
    x = _inputs(llr, n)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), slope)
        w += np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return (w / scale).tolist()


def scored(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("llr", "n", "score", "predicted")) -> DataFrame:
    """docs, with all its columns but those of the given names, with the log ratio, the letters, the score and the prediction so named."""
    spark = docs.sparkSession
    llr, n, score, predicted = names
    own = quoted(docs, *names)
    name = fresh(docs, "__text")
    train = labelled(docs, labels)
    seen = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    rows = docs.select(*own, text_or_empty().alias(name))
    if len(seen) < 2:
        out = rows.drop(name).select("*", F.lit(0.0).alias(llr), F.lit(0).cast("long").alias(n), F.lit(1.0 if 1 in seen else 0.0).alias(score))
    else:
        counts = train.where(fold() != 1).select("text", F.col("toxic").cast("int").alias("toxic")).transform(in_arrow, _count, "key long, t long, o long")
        counts = materialise(counts.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
        grams, contexts = (materialise(x) for x in ratios(counts))
        if grams.count() <= BROADCAST_SEQUENCES:
            model = [spark.sparkContext.broadcast(Ratios(x)) for x in (grams, contexts)]

            def weigh(df):
                kept = [f for f in df.schema.fields if f.name != name]
                kind = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept), f"`{llr}` double, `{n}` long"])
                return df.transform(in_arrow, _scorer(model, [f.name for f in kept], name, [llr, n]), kind)

        else:
            weigh = lambda df: weighed(df, grams, contexts, name, [llr, n])
        share = min(1.0, CALIBRATION_ROWS * 5 / max(1, sum(seen.values())))
        tuned = train.where((fold() == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))))
        tuned = materialise(tuned.select(F.col("toxic").cast("int").alias("toxic"), F.col("text").alias(name)))
        got = weigh(tuned).toPandas()
        w = calibrate(got[llr].to_numpy(), got[n].to_numpy(), got["toxic"].to_numpy(float)) if got["toxic"].nunique() == 2 else [0.0, 1.0]
        z = F.lit(w[0]) + F.lit(w[1]) * F.col(llr) / F.greatest(F.col(n), F.lit(1))
        out = weigh(rows).withColumn(score, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0)))))
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    names = [fresh(docs, x) for x in ("__llr", "__n", "__score", "__predicted")]
    return scored(docs, labels, tuple(names)).where(F.col(names[-1]) == 0).select(*quoted(docs))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the log-likelihood ratio llr over n letters, for each row of docs."""
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    # The scorer needs the text once; the result does not carry it.
    return scored(rows, labels).select("doc_id", "held_out", "score", "predicted", "llr", "n")


def op6_toxicity(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
