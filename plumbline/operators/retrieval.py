"""Lexical and dense retrieval over batches of queries, fusion and reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens


def term_frequencies(chunks: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunk_id, term, tf."""
    return chunks.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunk_id, dl: tokens with repeats; chunks without tokens count."""
    return chunks.select("chunk_id", F.coalesce(F.size(tokenize(F.col("text"))), F.lit(0)).cast("long").alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(dl: DataFrame) -> DataFrame:
    """One row: n and avgdl (1 for a corpus without tokens)."""
    return dl.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def bm25(chunks: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """query_id, chunk_id, score > 0 for all queries at once.

    Only postings of terms that some query has are kept, before anything is shuffled by chunk; the postings of a
    frequent term are dealt out by chunk, and a term's document frequency is a map-side combined count.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    postings = chunks.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    weight = document_frequencies(postings).crossJoin(F.broadcast(corpus_statistics(lengths(chunks, tokenize))))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(weight.select("term", idf.alias("idf"), "avgdl"), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = postings.join(lengths(chunks, tokenize), "chunk_id").join(terms, "term")
    return found.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).filter("score > 0")


def top_k(scored: DataFrame, k: int, order: list[Column] | None = None, out: str = "rank") -> DataFrame:
    """The best k rows of each query; ties by chunk_id. The limit works before the shuffle."""
    by = order or [F.round("score", 9).desc(), F.col("chunk_id")]
    return scored.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).filter(F.col(out) <= k)


#: Vectors of a block, about; and the least number of blocks.
BLOCK_VECTORS = 8192
LEAST_SALTS = 16


def salts_of(n: int) -> int:
    """Blocks of vectors for n vectors, so that a block is as large at any size."""
    return max(LEAST_SALTS, -(-n // BLOCK_VECTORS))


def _ranked(queries: DataFrame, vectors: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double, rank int"


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 2048, n_vectors: int | None = None) -> DataFrame:
    """query_id, chunk_id, score (cosine, > 0), rank: exact, in blocks of queries against blocks of vectors.

    Both have id and v (array<double>); a block pair is one matrix product, of which only the best k a query leave.
    One block of queries is broadcast, and vectors stream past it in batches, without a shuffle. More queries are dealt
    into blocks that meet blocks of vectors, whose number follows that of the vectors.
    n_vectors: number of vectors, at least, where it is known without working them out. Rows without an id, and vectors
    that are null, hold nulls or have another length than the query's drop out, as a cosine of 0 does.
    """
    lengths_ = [r["n"] for r in queries.select(F.size("v").alias("n")).filter("n > 0").distinct().collect()]  # as many as kinds of vectors
    if len(lengths_) != 1:
        # Vectors of different lengths have no cosine, so each length is searched by itself.
        found = [dense_top_k(vectors, queries.filter(F.size("v") == n), k, block=block, n_vectors=n_vectors) for n in lengths_]
        return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], _ranked(queries, vectors))
    whole = lambda df, key: df.filter(F.col(key).isNotNull() & (F.size("v") == lengths_[0]) & ~F.exists("v", lambda x: x.isNull()))
    vectors, queries = whole(vectors, "chunk_id"), whole(queries, "query_id")
    asked = queries.limit(block + 1).count()
    spark, told = vectors.sparkSession, _ranked(queries, vectors).removesuffix(", rank int")

    def best(ids: np.ndarray, m: np.ndarray, names: np.ndarray, a: np.ndarray) -> list[pd.DataFrame]:
        places = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        unit = lambda x: x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
        scores, out = unit(a) @ unit(m).T, []
        for query, row in zip(names, scores, strict=True):
            take = np.flatnonzero(row > 0)
            if len(take) > 4 * k:  # the order is only worked out among the best by value, ties included
                take = take[row[take] >= np.partition(row[take], len(take) - k)[len(take) - k] - 2e-9]
            take = take[np.lexsort((places[take], -row[take].round(9)))[:k]]
            out.append(pd.DataFrame({"query_id": query, "chunk_id": ids[take], "score": row[take]}))
        return out

    if asked <= block:
        held = queries.select("query_id", "v").toPandas()  # at most a block
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), np.stack(held["v"].to_list()) if len(held) else None))

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, a = shared.value
            for pdf in batches:
                for i in range(0, len(pdf) if a is not None else 0, BLOCK_VECTORS):
                    part = pdf.iloc[i : i + BLOCK_VECTORS]
                    yield pd.concat(best(part["chunk_id"].to_numpy(), np.stack(part["xv"].to_list()), names, a), ignore_index=True)

        found = vectors.select("chunk_id", F.col("v").alias("xv")).mapInPandas(stream, told)
        return top_k(found, k)
    salts = salts_of(vectors.count() if n_vectors is None else n_vectors)
    blocks = max(1, -(-queries.count() // block))
    q = queries.select("query_id", F.col("v").alias("qv"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    x = vectors.select("chunk_id", F.col("v").alias("xv"), F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        return pd.concat(best(right["chunk_id"].to_numpy(), np.stack(right["xv"].to_list()), left["query_id"].to_numpy(), np.stack(left["qv"].to_list())), ignore_index=True)

    found = q.groupBy("qb", "s").cogroup(x.groupBy("qb", "s")).applyInPandas(pair, told)
    return top_k(found, k)


#: Grams whose buckets a worker remembers at a time.
REMEMBERED_GRAMS = 500_000


def _bucket(gram: str, dim: int, kind: str) -> int:
    """A gram's bucket, and past ``dim`` that of a negative sign: the digest's first four bytes and the fifth's parity."""
    raw = gram.encode("utf-8", "surrogatepass")
    digest = hashlib.blake2b(raw, digest_size=8).digest() if kind == "blake2b" else hashlib.md5(raw).digest()
    return int.from_bytes(digest[:4], "big") % dim + dim * (digest[4] % 2)


def trigram_vectors(rows: DataFrame, key: str, dim: int = 256, kind: str = "blake2b") -> DataFrame:
    """Signed hashing of character trigrams: key, v (array<double>, unit length). A text shorter than three is
    one gram. Row by row, without a shuffle; ``kind`` md5 instead of blake2b is what SQL can work out as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = np.zeros((batch.num_rows, dim))
            for row, text in zip(out, batch.column("low").to_pylist(), strict=True):
                grams = [text[i : i + 3] for i in range(max(1, len(text) - 2))]
                if len(known) > REMEMBERED_GRAMS:
                    known.clear()
                for g in set(grams).difference(known):
                    known[g] = _bucket(g, dim, kind)
                counts = np.bincount(np.fromiter(map(known.__getitem__, grams), np.int64, len(grams)), minlength=2 * dim)
                row += counts[:dim] - counts[dim:]
            out /= np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-300)
            ends = pa.array(np.arange(0, out.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[key, "v"])

    small = rows.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return small.mapInArrow(run, f"{key} {small.schema[key].dataType.simpleString()}, v array<double>")


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, lexical_rank, dense_rank, fused_score, fused_rank."""
    both = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank")).join(dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank")), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    order = [F.round("fused_score", 9).desc(), F.col("lexical_rank").asc_nulls_last(), F.col("dense_rank")]
    return both.withColumn("fused_score", part("lexical_rank") + part("dense_rank")).withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int = 8, kind: str = "blake2b") -> DataFrame:
    """The best k of fused lexical and dense rankings, each over-fetched twice."""
    lexical = top_k(bm25(chunks, queries), 2 * k)
    dense = dense_top_k(trigram_vectors(chunks, "chunk_id", kind=kind), trigram_vectors(queries, "query_id", kind=kind), 2 * k, n_vectors=chunks.count())
    return reciprocal_rank_fusion(lexical, dense).filter(F.col("fused_rank") <= k).withColumn("fused_score", F.round("fused_score", 6))


def jaccard_rerank(candidates: DataFrame) -> DataFrame:
    """Adds rerank_score: overlap of the token sets of query_text and text."""
    q, t = F.array_distinct(tokens(F.col("query_text"))), F.array_distinct(tokens(F.col("text")))
    return candidates.withColumn("rerank_score", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(F.array_union(q, t))), F.lit(0.0)), 4))


def rerank_select(reranked: DataFrame, k: int = 4, least: float = 0.02) -> DataFrame:
    """Best k by rerank score among those whose fused score reaches ``least``; if none does, among all."""
    w = Window.partitionBy("query_id")
    passed = F.col("fused_score") >= least
    kept = reranked.withColumn("_any", F.max(passed).over(w)).filter(passed | ~F.col("_any")).drop("_any")
    return kept.withColumn("final_rank", F.row_number().over(w.orderBy(F.col("rerank_score").desc(), F.col("fused_rank")))).filter(F.col("final_rank") <= k)


def file_search(chunks: DataFrame, queries: DataFrame, tokenize: Callable[[Column], Column], *, k: int = 10, per_file: int = 3, penalty: float = 0.4) -> DataFrame:
    """File-corpus search: chunks have path and superseded; over-fetch 6 k, demote superseded, cap each file."""
    named = chunks.withColumn("text", F.concat_ws("\n", "path", "text"))
    raw = top_k(bm25(named, queries, k1=1.4, tokenize=tokenize), 6 * k, out="raw_rank")
    return capped(raw.join(chunks.select("chunk_id", "path", "superseded"), "chunk_id"), k, per_file, penalty)


def capped(raw: DataFrame, k: int, per_file: int, penalty: float) -> DataFrame:
    """The best k of ranked chunks (score, raw_rank, path, superseded): superseded ones demoted, few a file."""
    scored = raw.withColumn("score", F.when(F.col("superseded"), F.col("score") * penalty).otherwise(F.col("score")))
    order = [F.round("score", 9).desc(), F.col("raw_rank")]
    few = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))).filter(F.col("_n") <= per_file).drop("_n")
    return top_k(few, k, order)
