"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Each source has a target number of words. Of its documents, longer ones are expected more often: the expected copies of a document are
k times its pull, at most MOST, with the k of its source by which the expected words are the target. The pull is LEAN plus the number of
binary digits of the size, so that the longest are expected about twice as often as the shortest.
The whole part of the expected copies is allocated with certainty; the rest of it is the inclusion probability p of one more copy, so p
differs within a source. One more copy goes to a sample of unequal probability and fixed size, measured in words: ranks are
odds(u) / odds(p), u a number that the seed and the document decide, and the sample is the beginning of that order whose words come
nearest to what the target still lacks.

The order is cut without sorting a whole source: words are summed by 4096 ranges of the rank, a running sum over those few rows
finds the range in which the target falls, and only documents of that range are sorted. A hot source therefore costs no large task.
Targets are worked out over one row a source in one task, expected copies over one row a source and pull.

Defined results: null text has size 0; a null source is a source of its own, the last; a null doc_id counts as the empty string;
rows repeated with the same doc_id are ordered by a hash of the text, then by their place; columns of any name pass through
mixed_documents(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import addressed, fresh, materialise, quoted, table, word_count

#: No document is taken more often.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
RANGES = 4096
#: What every document has besides its digits.
LEAN = 8


def draw(seed: str) -> Column:
    """u: 52 bits of the MD5 digest of doc_id and seed, in the open interval (0, 1)."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> with target: shares by weight of all words, none above most times its source's size.

    Sources reach that bound in the order of size / weight; with the first k at the bound, each other gets the rest by weight.
    k is the least for which nobody else exceeds the bound. There is one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    picked = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(picked, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everyone))
    s = s.withColumn("rest", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("place", F.row_number().over(rising))
    free = F.col("weight") * F.col("rest") <= most * F.col("source_size") * F.col("rest_weight")
    s = s.withColumn("level", F.min(F.when(free, F.struct("place", "rest", "rest_weight"))).over(everyone))
    shared = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.rest_weight")
    return s.select("source", "source_size", F.when(F.col("place") >= F.col("level.place"), shared).otherwise((most * F.col("source_size")).cast("double")).alias("target"))


def pull(size: Column) -> Column:
    """What the expected copies are in proportion to: LEAN and the binary digits of the size (1 for 0)."""
    return (F.length(F.bin(size)) + LEAN).cast("long")


def expected_copies(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """source, pull, source_size, target, certain, p and lacks, from sizes (source, pull, words) and targets (source, source_size, target).

    Documents reach the bound in the order of their pull; with the j strongest classes at it, the others get the rest of the target by
    pull. j is the least for which nobody else exceeds the bound."""
    d = targets.withColumnRenamed("source", "of")
    d = sizes.join(d, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    falling = Window.partitionBy("source").orderBy(F.desc("pull"))
    everyone = Window.partitionBy("source")
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("target") - (most * F.coalesce(F.sum("words").over(before), F.lit(0))).cast("double")
    weighted = F.col("pull") * F.col("words")
    weight = F.sum(weighted).over(everyone) - F.coalesce(F.sum(weighted).over(before), F.lit(0))
    d = d.withColumn("rest", rest).withColumn("weight", weight.cast("double")).withColumn("place", F.row_number().over(falling))
    free = F.col("pull").cast("double") * F.col("rest") <= most * F.col("weight")
    d = d.withColumn("level", F.min(F.when(free, F.struct("place", "rest", "weight"))).over(everyone))
    share = F.when(F.col("level.weight") > 0, F.col("pull").cast("double") * F.col("level.rest") / F.col("level.weight")).otherwise(F.lit(0.0))
    d = d.withColumn("copies", F.when(F.col("place") < F.col("level.place"), F.lit(float(most))).otherwise(share))
    d = d.withColumn("certain", F.floor("copies")).withColumn("p", F.col("copies") - F.floor("copies"))
    lacks = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(everyone).cast("double")
    return d.select("source", "pull", "source_size", "target", "certain", "p", lacks.alias("lacks"))


def _mix(docs: DataFrame, uid: str, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    narrow = docs.select(F.col(uid).alias("uid"), "doc_id", "source", word_count("text").alias("size"), draw(seed).alias("u"), F.xxhash64("text").alias("tie"))
    narrow = materialise(narrow.withColumn("pull", pull(F.col("size"))))
    sizes = materialise(narrow.groupBy("source", "pull").agg(F.sum("size").alias("words")))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = materialise(expected_copies(sizes, targets, most).withColumnRenamed("source", "of").withColumnRenamed("pull", "with"))
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    d = narrow.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("pull") == F.col("with"))).drop("of", "with").withColumn("q", odds)
    d = d.withColumn("range", F.least(F.floor(F.col("q") / (1 + F.col("q")) * RANGES), F.lit(RANGES - 1)))

    # Words by range of the rank: at most RANGES rows a source.
    sums = d.where("q IS NOT NULL").groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"))
    up = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(up), F.lit(0)))
    cut = sums.where("before < lacks AND before + words >= lacks").groupBy(F.col("source").alias("cut_source")).agg(F.min("range").alias("cut"), F.min("before").alias("before"))
    cut = materialise(cut)  # of known size, so the planner need not deal all rows by source
    d = d.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")

    inside = F.col("q").isNotNull() & F.col("cut").isNotNull() & (F.col("range") == F.col("cut"))
    run = Window.partitionBy("source").orderBy("q", "doc_id", "tie", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = d.where(inside).withColumn("total", F.col("before") + F.sum("size").over(run))
    edge = edge.withColumn("more", (2 * F.col("total") - F.col("size") <= 2 * F.col("lacks")).cast("int")).drop("total")
    # Without a cut, all words of the order do not reach what lacks (rounding), so all of it is in; unless nothing lacks.
    whole = (F.col("lacks") > 0).cast("int")
    sure = d.where(~inside).withColumn("more", F.when(F.col("q").isNull(), F.lit(0)).when(F.col("cut").isNull(), whole).otherwise((F.col("range") < F.col("cut")).cast("int")))
    out = sure.unionByName(edge).withColumn("copies", (F.col("certain") + F.col("more")).cast("int"))
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", "p", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: uid, doc_id, source, size, source_size, target, p (the probability of one more copy), copies and taken (= size *
    copies)."""
    return _mix(*addressed(docs.select("doc_id", "source", "text")), seed, weights, most)


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    rows, uid = addressed(docs)
    key, copies = fresh(rows, "__taken"), fresh(rows, "__copies")
    taken = _mix(rows, uid, seed, WEIGHTS, MOST).where("copies > 0").select(F.col("uid").alias(key), F.col("copies").alias(copies))
    out = rows.join(taken, F.col(uid) == F.col(key)).select("*", F.explode(F.sequence(F.lit(1), F.col(copies))).alias(fresh(rows, "__copy")))
    return out.select(*quoted(docs))


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER o AS place,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), l AS (
  SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(rest_weight, place) AS rest_weight FROM r WHERE weight * rest <= 3 * source_size * rest_weight
), t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.place >= l.place THEN CAST(r.weight * l.rest AS DOUBLE) / CAST(l.rest_weight AS DOUBLE) ELSE CAST(3 * r.source_size AS DOUBLE) END AS target
  FROM r LEFT JOIN l ON true
), c AS (
  SELECT d.source, 8 + length(bin(size)) AS pull, CAST(sum(size) AS BIGINT) AS words, any_value(t.source_size) AS source_size, any_value(t.target) AS target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, 8 + length(bin(size))
), w AS (
  SELECT *, row_number() OVER f AS place,
         target - CAST(3 * coalesce(sum(words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
         CAST(sum(pull * words) OVER (PARTITION BY source) - coalesce(sum(pull * words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS weight
  FROM c WINDOW f AS (PARTITION BY source ORDER BY pull DESC)
), v AS (
  SELECT source, min(place) AS place, arg_min(rest, place) AS rest, arg_min(weight, place) AS weight FROM w WHERE pull::DOUBLE * rest <= 3 * weight GROUP BY source
), e AS (
  SELECT w.source, w.pull, w.words, w.source_size, w.target,
         CASE WHEN w.place < v.place THEN 3.0::DOUBLE WHEN v.weight > 0 THEN w.pull::DOUBLE * v.rest / v.weight ELSE 0.0::DOUBLE END AS expected
  FROM w LEFT JOIN v ON w.source IS NOT DISTINCT FROM v.source
), p AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS chance,
         target - CAST(sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS lacks FROM e
), q AS (
  SELECT d.*, p.source_size, p.target, p.certain, p.chance, p.lacks, (d.u / (1 - d.u)) / (p.chance / (1 - p.chance)) AS odds
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND 8 + length(bin(d.size)) = p.pull
), r2 AS (
  SELECT *, sum(size) OVER (PARTITION BY source, chance > 0 ORDER BY odds, doc_id, text ROWS UNBOUNDED PRECEDING) AS total FROM q
)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN chance > 0 AND lacks > 0 AND 2 * total - size <= 2 * lacks THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r2
"""
