"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Fitting: k-means for the coarse centroids and for each sub-space of the residuals, on at most ``MAX_FIT`` vectors,
smallest hash first (a documented bound); every vector is indexed. The number of lists grows with the square root of
the number of vectors, up to ``MAX_LISTS``.

Searching: a query visits its nearest lists, as many as hold ``TARGET`` of the true neighbours among the fitted
sample (on vectors without structure that is most of the lists; on clustered ones few). Each list is dealt out over as many salts as its size asks for, so one
list with a third of all vectors is searched by many tasks; a query goes to each salt of its lists, and a list that
many queries visit is dealt once for each block of about ``QUERY_ROWS`` of them, so that a task holds a bounded number
of both. Queries that find fewer than k this way visit all lists. In a task, tables
of distances from the query's residual to the sub-centroids give each code's approximate distance. With each code
goes its own error, so that distance less and plus error are bounds: all vectors of the task whose lower bound is
within the k-th smallest upper bound are measured exactly on the original vectors, which loses none of the visited
lists' true neighbours. The best k of each task meet in a window; ties go to the smaller vec_id.

Defined cases: rows with a null vec_id, and null, zero or otherwise unusable vectors (null, NaN or infinite components) take part neither as
queries nor as candidates, nor do vectors of another length than the most common one (the shorter of equally common
ones); rows that repeat a vec_id are candidates each for itself, except to a query with that id; rows that repeat a query's id and
vector are one query, and those with its id and another vector are queries of their own; vectors so large that their
squares would overflow are searched in a smaller unit, and their distances are told in the first one; an empty table
gives no rows; a query finds fewer than k only where there are fewer candidates; other columns are ignored, clashing
names too (there are no texts here).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import materialize

MAX_FIT = 20_000
MAX_LISTS = 4096
SUB_SPACES = 16
CODES = 64
TARGET = 0.99
#: Sampled queries by which the number of visited lists is chosen.
TRIALS = 200
#: Vectors of a list that one salt holds, about.
SALT_ROWS = 2000
#: Queries of a block, about.
QUERY_ROWS = 2000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(True)) & F.exists("v", lambda x: x != 0)
    )
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of at most k groups of the rows of x; empty groups take the rows farthest from their centroids."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        d = (c**2).sum(1)[None, :] - 2 * x @ c.T
        own = d.argmin(1)
        sizes = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        if (~full).any():
            far = np.argsort(-(d.min(1) + (x**2).sum(1)), kind="stable")[: (~full).sum()]
            c[np.flatnonzero(~full)[: len(far)]] = x[far]
    return c


class Index:
    """Coarse centroids and the sub-spaces' codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, sub_spaces: int, codes: int):
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[self.nearest(sample, 1)[:, 0]]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(sub_spaces, sample.shape[1]))
        self.books = [kmeans(residual[:, p], codes) for p in self.parts]

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        d = (self.coarse**2).sum(1)[None, :] - 2 * x @ self.coarse.T
        return np.argsort(d, axis=1, kind="stable")[:, :k]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.coarse[lists]
        return np.stack([((b**2).sum(1)[None, :] - 2 * r[:, p] @ b.T).argmin(1) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of the vectors from what their codes stand for."""
        r = x - self.coarse[lists]
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r[:, p] -= b[codes[:, k]]
        return np.sqrt((r**2).sum(1))

    def tables(self, query: np.ndarray, of: int) -> np.ndarray:
        """Squared distances from the query's residual to each code, by sub-space."""
        r = query - self.coarse[of]
        out = np.full((len(self.parts), max(map(len, self.books))), np.inf)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[k, : len(b)] = ((r[p][None, :] - b) ** 2).sum(1)
        return out


    def probes(self, sample: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> int:
        """Lists to visit so that ``target`` of the k nearest of sampled queries are in them."""
        own, q = self.nearest(sample, 1)[:, 0], sample[:trials]
        d = (sample**2).sum(1)[None, :] - 2 * q @ sample.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        if len(sample) < 2:
            return 1
        true = np.argpartition(d, min(k, len(sample) - 1) - 1, axis=1)[:, :k]
        order = self.nearest(q, len(self.coarse))
        place = np.empty_like(order)
        place[np.arange(len(q))[:, None], order] = np.arange(order.shape[1])[None, :]
        return int(np.quantile(place[np.arange(len(q))[:, None], own[true]], target, method="higher")) + 1


def distances(x: np.ndarray, q: np.ndarray, unit: float) -> np.ndarray:
    """Euclidean distances in double precision; in ``unit`` where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(1))
        far = ~np.isfinite(d)
        d[far] = np.sqrt(((x[far] * unit - q * unit) ** 2).sum(1)) / unit
    return d


def fit(vectors: DataFrame, n: int, *, unit: float = 1.0, max_fit: int = MAX_FIT, max_lists: int = MAX_LISTS, sub_spaces: int = SUB_SPACES, codes: int = CODES) -> tuple[Index, np.ndarray]:
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max_fit).select("v").toPandas()
    x = np.stack(sample["v"].to_list()) * unit
    return Index(x, max(1, min(max_lists, round(math.sqrt(n) / 2))), sub_spaces, codes), x


def search(vectors: DataFrame, is_query, *, k: int = 10, probes: int | None = None, **how) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found to each row where ``is_query`` holds."""
    fine = usable(vectors)
    n, largest = fine.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).head()
    if not n:
        return fine.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A power of two, so that nothing is rounded; 1 unless squares could overflow.
    unit = 2.0 ** -math.frexp(largest)[1] if largest > 1e100 else 1.0
    fitted, sample = fit(fine, n, unit=unit, **how)
    probes = probes or fitted.probes(sample, k)
    shared = fine.sparkSession.sparkContext.broadcast(fitted)  # bounded by MAX_LISTS and CODES

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_list()) * unit
                own = index.nearest(x, 1)[:, 0]
                codes = index.encode(x, own)
                yield pdf.assign(l=own, code=[c.tobytes() for c in codes], error=index.errors(x, own, codes))

    indexed = materialize(fine.mapInPandas(assign, "vec_id long, v array<double>, l int, code binary, error double"), "indexed")
    sizes = indexed.groupBy("l").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))  # at most MAX_LISTS rows

    def scan(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        index, none = shared.value, pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        if not len(queries) or not len(rows):
            return none
        rows = rows.sort_values("vec_id", kind="stable")
        ids, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_list())
        codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]])
        places, error, out = np.arange(codes.shape[1]), rows["error"].to_numpy() + 1e-9, []
        for q, own, v in zip(queries["vec_id"], queries["q"], queries["v"], strict=True):
            table_of = index.tables(np.asarray(v) * unit, int(key[0]))
            near = np.sqrt(table_of[places[None, :], codes].sum(1))
            others = ids != q
            upper = np.sort((near + error)[others])
            if not len(upper):
                continue
            take = np.flatnonzero(others & (near - error <= upper[min(k, len(upper)) - 1]))
            exact = distances(x[take], np.asarray(v), unit)
            best = np.lexsort((ids[take], exact))[:k]
            out.append(pd.DataFrame({"query_id": q, "q": own, "vec_id": ids[take][best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True) if out else none

    def visited(asked: DataFrame, lists: int) -> DataFrame:
        """The best k of each query (vec_id, v) in its nearest lists, written once."""

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(lists=list(index.nearest(np.stack(pdf["v"].to_list()) * unit, lists)))

        sent = materialize(asked.mapInPandas(visit, "vec_id long, v array<double>, q long, lists array<int>").select("vec_id", "v", "q", F.explode("lists").alias("l")), "asked")
        plan = sent.groupBy("l").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")).join(sizes, "l")  # at most MAX_LISTS rows
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        queries = sent.join(F.broadcast(plan), "l").withColumn("b", part("blocks")).withColumn("s", spread("salts")).select("l", "s", "b", "vec_id", "v", "q")
        rows = indexed.join(F.broadcast(plan), "l").withColumn("s", part("salts")).withColumn("b", spread("blocks")).select("l", "s", "b", "vec_id", "v", "code", "error")
        found = queries.groupBy("l", "s", "b").cogroup(rows.groupBy("l", "s", "b")).applyInPandas(scan, "query_id long, q long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
        return materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "q", "rank", "vec_id", "score"), "found")

    # The hash of its vector tells queries of one id apart.
    asked = fine.filter(is_query).withColumn("q", F.xxhash64("v")).dropDuplicates(["vec_id", "q"])
    best = visited(asked, probes)
    if probes < len(fitted.coarse):
        full = best.groupBy("query_id", "q").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "q")
        short = asked.join(full, ["vec_id", "q"], "left_anti")
        if not short.isEmpty():
            best = best.join(full.withColumnRenamed("vec_id", "query_id"), ["query_id", "q"], "left_semi").unionByName(visited(short, len(fitted.coarse)))
    return best.drop("q")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
