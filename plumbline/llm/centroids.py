"""Centroid clustering: Lloyd's rounds over vectors whose columns are dealt out in blocks.

The vectors are written once as integers, a row for each vector and block of columns, in a folder for each block. In a
round, the tasks of a block hold only its slice of the centroids and give each vector's exact partial distances to all
of them; sums by vector add the blocks and take the nearest centroid, ties to the smaller number. The assignments meet
the blocks again, and each block adds up its own columns by cluster, first inside tasks, and divides them: its slice of
the next centroids. What reaches the driver is centroids, k times the columns, and nothing that grows with the rows; no
key is a cluster before its rows are summed, so a cluster with most of the vectors is spread over all tasks.

Defined cases: null vectors, those of another length than ``dims`` and those with a null or non-finite component take
no part; components are kept within 2^27 after scaling, so that distances fit 64 bits; rows that repeat a vec_id or a
vector are vectors of their own; a null vec_id stays null and is the last to start a centroid; with equal hashes the
smaller vector starts first; with fewer vectors than ``k`` there are as many centroids as vectors; a centroid without
vectors stays where it is; an empty table gives no rows; other columns are ignored, clashing names too (there are no
texts here).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import materialize, shared_dir

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Columns of a block. Each block sends k sums a vector, so few wide blocks shuffle less.
BLOCK = 32
MOST = 2**27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array<int>): floor(scale * component) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == dims) & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    return fine.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("int")).alias("x"))


def starts(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in order of the hash."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in first.select("x").collect()], np.int64)


def in_blocks(rows: DataFrame, dims: int, width: int) -> DataFrame:
    """row, vec_id, x and block, written in a folder for each block of columns."""
    spark = rows.sparkSession
    block = lambda b: F.struct(b.alias("block"), F.slice("x", b * width + 1, F.lit(width)).alias("x"))
    # Written at once, so that a row's number is the same in every later step.
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(-(-dims // width) - 1)), block)).alias("b")).select("row", "vec_id", "b.block", "b.x")
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    dealt.write.partitionBy("block").parquet(path)
    return spark.read.schema("row long, vec_id long, x array<int>, block int").parquet(path)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of a batch: number, places in the batch, and the components as a matrix."""
    which, values = batch.column("block").to_numpy(zero_copy_only=False), batch.column("x")
    for b in np.unique(which):
        at = np.flatnonzero(which == b)
        yield int(b), at, values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.int64)


def assign(blocks: DataFrame, centroids: np.ndarray, width: int, *, named: bool = False) -> DataFrame:
    """row, cluster and distance (and vec_id) of every vector: partial distances of its blocks, added up."""
    k = len(centroids)
    slices = [centroids[:, i : i + width] for i in range(0, centroids.shape[1], width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, at, x in _matrices(batch):
                d = (x**2).sum(1)[:, None] - 2 * (x @ slices[b].T) + (slices[b] ** 2).sum(1)[None, :]
                own = [batch.column(c).take(pa.array(at)) for c in ("row", "vec_id")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(d[:, j]) for j in range(k))], names=["row", "vec_id", *(f"d{j}" for j in range(k))])

    parts = blocks.mapInArrow(partial, "row long, vec_id long, " + ", ".join(f"d{j} long" for j in range(k)))
    sums = parts.groupBy("row").agg(*([F.max("vec_id").alias("vec_id")] if named else []), *(F.sum(f"d{j}").alias(f"d{j}") for j in range(k)))
    every = F.array(*(F.col(f"d{j}") for j in range(k)))
    # array_position gives the first of equal distances.
    return sums.select("row", *(["vec_id"] if named else []), (F.array_position(every, F.array_min(every)) - 1).cast("int").alias("cluster"), F.array_min(every).alias("distance"))


def update(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The next centroids: each block's column sums by cluster, divided; clusters without vectors stay."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            for b, at, x in _matrices(batch):
                held = sums.setdefault(b, np.zeros((k, x.shape[1] + 1), np.int64))
                for c in np.unique(cluster[at]):
                    own = cluster[at] == c
                    held[c, :-1] += x[own].sum(0)
                    held[c, -1] += own.sum()
        for b, held in sums.items():
            c, j = np.nonzero(np.broadcast_to(held[:, -1:] > 0, held[:, :-1].shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), b, np.int32)), pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held[c, j]), pa.array(held[c, -1])], names=["block", "cluster", "pos", "total", "n"])

    met = blocks.select("row", "x", "block").join(assigned.select("row", "cluster"), "row").select("block", "x", "cluster")
    sums = met.mapInArrow(add, "block int, cluster int, pos int, total long, n long").groupBy("block", "cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.select("cluster", (F.col("block") * width + F.col("pos")).alias("column"), F.expr("(total - pmod(total, n)) div n").alias("value")).collect():  # at most k * dims rows
        out[r["cluster"], r["column"]] = r["value"]
    return out


def cluster(vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, width: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = kept(vectors, dims, scale)
    centroids = starts(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    blocks = in_blocks(rows, dims, width)
    for _ in range(rounds):
        centroids = update(blocks, assign(blocks, centroids, width), centroids, width)
    assigned = materialize(assign(blocks, centroids, width, named=True), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    most = 2**63 - 1
    told = [(c, min(most, sums.get(c, 0)), min(most, sum(sums.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    small = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _round_sql(n: int) -> str:
    return f"""
d{n} AS MATERIALIZED (SELECT x.r, c.c, sum((x.v - c.v) * (x.v - c.v)) AS s FROM x JOIN c{n} c ON x.d = c.d GROUP BY x.r, c.c),
a{n} AS MATERIALIZED (SELECT r, c, s FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)"""


def _update_sql(n: int) -> str:
    return f"""
s{n} AS (SELECT a.c, x.d, sum(x.v) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{n} a JOIN x USING (r) GROUP BY a.c, x.d),
c{n + 1} AS MATERIALIZED (SELECT c.c, c.d, coalesce(CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT), c.v) AS v FROM c{n} c LEFT JOIN s{n} s ON s.c = c.c AND s.d = c.d)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({DIMS})) AS d, unnest(e) AS v FROM v),
b AS (SELECT e, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c FROM v QUALIFY c < {CENTROIDS}),
c0 AS MATERIALIZED (SELECT c, unnest(range({DIMS})) AS d, unnest(e) AS v FROM b),{",".join(_round_sql(n) + "," + _update_sql(n) for n in range(ROUNDS))},{_round_sql(ROUNDS)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.s AS BIGINT) AS distance, CAST(sum(a.s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.s) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN h ON h.c = a.c
"""
