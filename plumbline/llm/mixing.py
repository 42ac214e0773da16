"""Mixing sources to target weights.

Every row gets a hash-random key (md5 of its id). Within its source the key's leading hex digits give a range
bucket; prefix sums of sizes are a window inside (source, bucket) plus the sums of the buckets before it, so a
source with a third of all rows is spread over all buckets. The row in which the running sum crosses the source's
budget is cut there, so that the words taken equal the rounded target; budgets above the source's size repeat it.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id is keyed as
the empty string; equal ids are ordered by size and the text's md5, and full copies of a row are interchangeable;
an empty table gives no rows; sources of size 0 have target 0. Other columns of the input pass through; columns
that clash with the five added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import n_words, table, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Hex digits of the key that make a range bucket: 16**3 buckets for each source.
BUCKET_DIGITS = 3


def source_budgets(sources: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Adds ``target`` to one row a source (``_sk``, ``source_size``): weighted water filling under caps.

    With caps in order of cap / weight, a source keeps its cap while the level left for it and all later ones is
    above that ratio; the first level that isn't is everybody's. One row a source, so the windows here are small.
    """
    by_name = Window.orderBy("_sk")
    everywhere = Window.partitionBy()
    ordered = Window.orderBy("_ratio", "_sk")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    level = (F.sum("source_size").over(everywhere) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everywhere) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_place", F.row_number().over(ordered))
        .withColumn("_first", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_place", "_level"))).over(everywhere))
        .withColumn("target", F.when(F.col("_first").isNull() | (F.col("_place") < F.col("_first._place")), F.col("_cap")).otherwise(F.least("_cap", F.col("_first._level") * F.col("_weight"))))
        .select("_sk", "source_size", "target")
    )


def mix(docs: DataFrame, size: Column, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, bucket_digits: int = BUCKET_DIGITS, tie: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken."""
    keyed = (
        docs.drop("size", "source_size", "target", "taken")
        .withColumn("size", size)
        .withColumn("_sk", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")))
        .withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("_tie", tie if tie is not None else F.md5(text_of().cast("binary")))
        .withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    )
    totals = keyed.groupBy("_sk", "_bucket").agg(F.sum("size").alias("_n"))
    targets = source_budgets(totals.groupBy("_sk").agg(F.sum("_n").alias("source_size")), weights, share, max_repeats)
    earlier = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(targets, "_sk")
    inside = Window.partitionBy("_sk", "_bucket").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_sk", "_bucket"])
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    part = budget - whole * F.col("source_size") - F.col("_offset") - F.col("_inside")
    return placed.withColumn("taken", (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))).cast("long")).drop("_sk", "_key", "_tie", "_bucket", "_inside", "_offset")


def write_out(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each whole copy taken, and one cut to the words left over."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    words = F.regexp_extract_all(text_of(), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("_rest").cast("int")), "")
    return (
        mixed.withColumn("_rest", rest)
        .withColumn("_copies", F.concat(F.array_repeat(F.lit(False), whole), F.when(F.col("_rest") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
        .withColumn("_cut", F.explode("_copies"))
        .withColumn("text", F.when(F.col("_cut"), cut).otherwise(F.col("text")))
        .drop("_rest", "_copies", "_cut", "size", "source_size", "target", "taken")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", n_words(text_of()).alias("_words"), F.md5(text_of().cast("binary")).alias("_of_text"))
    return mix(sized, F.col("_words"), tie=F.col("_of_text")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS sk, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS tie,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, sk) AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
f AS (SELECT place AS first_place, level AS first_level FROM l WHERE ratio >= level ORDER BY place LIMIT 1),
t AS (
  SELECT sk, source_size, CASE WHEN first_place IS NULL OR place < first_place THEN cap ELSE least(cap, first_level * weight) END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.sk ORDER BY k, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN t ON d.sk = t.sk)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
