"""Durable intermediates."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from plumbline.session import DROP_SHUFFLES, materialize


def shuffle_blocks(spark) -> set[str]:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in held.split() if b.startswith("shuffle_")}


def test_written_plans_leave_no_shuffle_files(spark):
    before, setting = shuffle_blocks(spark), spark.conf.get(DROP_SHUFFLES)
    rows = spark.range(10_000, numPartitions=4).withColumn("g", F.col("id") % 97)
    sums = rows.groupBy("g").agg(F.sum("id").alias("s"))
    found = materialize(rows.repartition(5, "g").join(sums.hint("merge"), "g"), "joined")
    end = time.time() + 20
    while shuffle_blocks(spark) - before and time.time() < end:  # they go in the background
        time.sleep(0.1)
    assert not shuffle_blocks(spark) - before
    assert spark.conf.get(DROP_SHUFFLES) == setting
    # The plan's frames can still be run, and the written rows are whole.
    assert found.count() == 10_000 and sums.count() == 97
    assert found.agg(F.sum("s")).head()[0] == sum(s * n for s, n in sums.join(rows.groupBy("g").count(), "g").select("s", "count").collect())
