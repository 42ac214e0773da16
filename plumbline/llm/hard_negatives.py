"""Hard-negative mining: slots between the positives' upper limits, the best of each slot, merged from the top down.

Anchors and rows are dealt into blocks by hash, and each pair of blocks is one group whose size doesn't follow the
table's; a block pair gives exact integer products of its anchors and rows. A first pass keeps each anchor's best rows
of its own label: the positives. A positive's upper limit is the largest score that its negatives may have; the limits
of an anchor split all scores into disjoint slots. A second pass puts each row of another label into the one slot that
its score falls into and keeps the best ``k`` of each slot, in the block pair and again, before the shuffle, over all of
them. A positive's window is its own slot and all below: reading the slots in descending order, its first ``k`` are
those of the merged list from its own slot on, however many windows overlap. The lower limit only cuts that list short.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; vectors of
different lengths are multiplied over the components that both have (an empty one scores 0); components are kept within
2^28 after scaling, so that products fit 64 bits; rows that repeat a vec_id are rows of their own, as candidates and as
anchors, except that an anchor's positives don't hold its own vec_id; equal scores come by vec_id; positives with equal
scores share a slot; a positive with a score below 0 has no negatives, since its window is empty; an empty table gives
no rows; other columns are ignored, clashing names too (there are no texts here).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import materialize

SCALE, POSITIVES, NEGATIVES, LOWER, UPPER = 256, 5, 10, 30, 90
MOST = 2**28
#: Rows and anchors of a block, about; and the least number of row blocks.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_BLOCKS = 16_384, 4096, 16
#: Anchors whose scores a task holds at a time.
AT_ONCE = 64


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and x (array<int>) of the rows that take part, written once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    fine = fine.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    x = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("int"))
    return materialize(fine.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", x.alias("x")), "rows")


def _by_length(values: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of vectors."""
    ends, flat = np.asarray(values.offsets), values.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    return [(at, flat[ends[at][:, None] + np.arange(n)[None, :]]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]]


def _products(left: pa.Table, right: pa.Table) -> Iterator[tuple[range, np.ndarray]]:
    """Exact inner products of some of the left vectors with all of the right ones, a few left ones at a time."""
    whole = lambda t: t.column("x").combine_chunks()
    rows, asked = _by_length(whole(right)), whole(left)
    for i in range(0, left.num_rows, AT_ONCE):
        part = asked.slice(i, AT_ONCE)
        out = np.zeros((len(part), right.num_rows), np.int64)
        for at, a in _by_length(part):
            for to, b in rows:
                n = min(a.shape[1], b.shape[1])
                if n:
                    a_, b_ = a[:, :n], b[:, :n]
                    exact = float(np.abs(a_).max()) * float(np.abs(b_).max()) * n < 2**53  # then sums of doubles are exact, too
                    out[np.ix_(at, to)] = (a_.astype(float) @ b_.T.astype(float)).astype(np.int64) if exact else a_.astype(np.int64) @ b_.T.astype(np.int64)
        yield range(i, i + len(part)), out


def _best_same(left: pa.Table, right: pa.Table, most: int) -> Iterator[tuple]:
    ids, labels = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
    own, names, tags = (left.column(c).to_numpy() for c in ("row", "vec_id", "label"))
    for at, scores in _products(left, right):
        for i, row in zip(at, scores, strict=True):
            take = np.flatnonzero((labels == tags[i]) & (ids != names[i]))
            take = take[np.argsort(-row[take], kind="stable")[:most]]
            yield np.full(len(take), own[i]), np.zeros(len(take), np.int64), ids[take], row[take]


def _best_in_slots(left: pa.Table, right: pa.Table, most: int) -> Iterator[tuple]:
    ids, labels = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
    own, tags, least = (left.column(c).to_numpy() for c in ("row", "label", "least"))
    limits = left.column("limits").to_pylist()
    for at, scores in _products(left, right):
        for i, row in zip(at, scores, strict=True):
            tops = np.array(limits[i], np.int64)
            take = np.flatnonzero((labels != tags[i]) & (row <= tops[0]) & (row >= least[i]))
            take = take[np.argsort(-row[take], kind="stable")]
            ends = [*np.searchsorted(-row[take], -tops, side="left"), len(take)]
            for slot in range(len(tops)):
                few = take[ends[slot] : min(ends[slot] + most, ends[slot + 1])]
                yield np.full(len(few), own[i]), np.full(len(few), slot), ids[few], row[few]


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, salts: int, best: Callable, most: int) -> DataFrame:
    """anchor, slot, vec_id and score: what ``best`` leaves of every pair of blocks."""
    # Both sides come from the same rows; columns named anew keep them apart.
    left = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = rows.select(*(F.col(c).alias(c) for c in ("vec_id", "label", "x")), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("s")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = list(best(a, b.sort_by("vec_id"), most)) if a.num_rows and b.num_rows else []
        columns = [np.concatenate([p[j] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for j in range(4)]
        return pa.table([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])], names=["anchor", "slot", "vec_id", "score"])

    found = left.groupBy("qb", "s").cogroup(right.groupBy("qb", "s")).applyInArrow(pair, "anchor long, slot int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, k: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and positive its
    first k rows of another label whose score is within lower and upper percent of the positive's."""
    rows = prepared(vectors, scale)
    anchors = rows.filter(is_anchor)
    n, asked = rows.count(), anchors.count()
    blocks, salts = max(1, -(-asked // BLOCK_ANCHORS)), max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))

    # Percents of scores in hundreds and the rest, so that no product leaves 64 bits; scores below 0 have no window.
    first = _met(anchors, rows, blocks, salts, _best_same, positives).filter("score >= 0").withColumn("upper", F.expr(f"(score div 100) * {upper} + ((score % 100) * {upper}) div 100")).withColumn("lower", F.expr(f"(score div 100) * {lower} + ((score % 100) * {lower} + 99) div 100"))
    held = materialize(first.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "upper", "lower"), "positives")
    slots = held.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))  # a few limits an anchor
    asking = anchors.join(slots.withColumnRenamed("anchor", "row"), "row")
    best = _met(asking, rows, blocks, salts, _best_in_slots, k)

    # At most k rows a slot and as many slots as positives, so an anchor's merged list is short.
    merged = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id", "slot", "score"))).alias("merged"))
    joined = held.join(slots.select("anchor", "limits"), "anchor").join(merged, "anchor").withColumn("own", F.array_position("limits", F.col("upper")) - 1)
    window = F.filter(F.slice(F.filter("merged", lambda x: x["slot"] >= F.col("own")), 1, k), lambda x: x["score"] >= F.col("lower"))
    out = joined.select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("pos", "x"))
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS aid, e.r, e.vec_id, a.label = e.label AS same,
    coalesce(list_sum(list_transform(range(1, least(len(a.x), len(e.x)) + 1), lambda i: a.x[i] * e.x[i])), 0) AS s
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a CROSS JOIN e),
p AS (SELECT ar, aid, r, vec_id, s FROM s WHERE same AND vec_id <> aid QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, vec_id) <= {POSITIVES})
SELECT p.aid AS anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, CAST(p.s AS BIGINT) AS positive_score, CAST(n.s AS BIGINT) AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND {LOWER} * p.s <= 100 * n.s AND 100 * n.s <= {UPPER} * p.s
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY n.s DESC, n.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
