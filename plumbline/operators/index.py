"""A search index that is kept: segments in a folder that Spark reads and writes, searched without the texts.

A segment is what one ``save`` or ``ingest`` brought, and isn't written again:

``chunks``    all columns given; of a few chunks, only the files are read that hold them
``postings``  a row for each term and block of chunks, with all its chunks and the largest tf and least dl among them;
              in folders by the term's hash, so that a search reads the folders of its terms, and sorted by term
``terms``     term, df, rows of postings, largest tf and least dl; df is negative for what a segment takes out of older ones
``dead``      chunks of older segments that were replaced
``idents``    ident, path and chunk_id of identifiers, where files are indexed
``docs``      the files that the chunks are of, if they are given
``vectors-``  hashed vectors, made on demand

A version is a small file that names its segments and sums over them. It is put in place whole, under the next number, by
one writer only: a reader keeps the version that it has loaded, whatever is ingested, mended or compacted meanwhile, and
a writer that comes second starts over from the newer one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamWriter

from plumbline.functions.text import grader_form, identifiers, tokens
from plumbline.operators.retrieval import capped, dense_top_k, reciprocal_rank_fusion, top_k, trigram_vectors
from plumbline.session import materialize, put_new, remove, shuffles_dropped

#: Of the tables' layout; indexes of another one are not read.
VERSION = 2
_SEGMENT = "number int, folder string, n_chunks long, n_tokens long, n_postings long, n_terms long, n_dead long, n_docs long, parts int, schema string, docs_schema string"
COMMIT = f"seq long, layout int, fingerprint string, tokenizer string, with_path boolean, n_chunks long, n_tokens long, batches map<string,long>, segments array<struct<{_SEGMENT.replace(' ', ':').replace(',:', ',')}>>"

#: Chunks of a block of postings, at most, and of a folder of postings, about.
BLOCK_CHUNKS, PART_CHUNKS = 4096, 20_000
#: Terms of a batch of questions up to which only their folders are read; more are in most of them.
MOST_TERMS = 10_000
#: Files of chunks up to which only those that hold some chunks are read.
MOST_FILES = 10_000
#: Rows of postings above which a search works out bounds first; terms of a short question, on average (the bounds of
#: many terms together close few blocks); the blocks and the rarest terms whose scores it begins with.
PRUNE_ABOVE, SHORT, FIRST_BLOCKS, RAREST = 200_000, 6, 16, 3
#: Entries of postings that a batch of questions has to meet, from which questions share what they have in common; or blocks
#: are scored in tasks; chunks up to which a term is a question's own.
MOST_ENTRIES, SELDOM = 2_000_000, 100
#: Terms of all questions of a batch, up to which each task gets them.
MOST_ASKED = 50_000
#: What a bound may miss by rounding.
SLACK = 1e-8
#: Segments of a version, from which an ingest makes one of them all.
MOST_SEGMENTS = 8
#: Times that a writer starts over after another one's commit.
TRIES = 5


class IndexUnusable(ValueError):
    """There is no index in the folder, or one of another layout or other terms."""


class IndexBusy(RuntimeError):
    """Other writers were faster, each time."""


def _postings_ddl(kind: str) -> str:
    return f"term string, block long, n long, tf_max int, dl_min int, tf_sum long, ids array<{kind}>, tfs array<int>, dls array<int>"


def _schema(name: str, chunks: str) -> T.StructType | str:
    """Of a segment's table; told, not read from its files, since there may be none."""
    own = T.StructType.fromJson(json.loads(chunks))
    if name == "chunks":
        return own
    kind = own["chunk_id"].dataType.simpleString()
    return {
        "postings": f"{_postings_ddl(kind)}, part int",
        "terms": "term string, df long, n_rows long, tf_max int, dl_min int",
        "dead": f"_seg int, chunk_id {kind}",
        "idents": f"ident string, path string, chunk_id {kind}",
    }.get(name, f"chunk_id {kind}, v array<double>")


@dataclass(frozen=True)
class Segment:
    number: int
    folder: str
    n_chunks: int
    n_tokens: int
    n_postings: int
    n_terms: int
    n_dead: int
    n_docs: int
    #: Folders of postings.
    parts: int
    #: Of its chunks, as JSON; and of its docs, if it has any.
    schema: str
    docs_schema: str = ""

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name == "docs":
            return spark.read.schema(T.StructType.fromJson(json.loads(self.docs_schema))).parquet(f"{self.folder}/docs")
        return spark.read.schema(_schema(name, self.schema)).parquet(f"{self.folder}/{name}")


@dataclass
class EvidenceIndex:
    """A version as read: its segments, and the sums over them."""

    spark: SparkSession
    root: str
    seq: int
    fingerprint: str
    n_chunks: int
    n_tokens: int
    segments: list[Segment]
    #: How texts and questions become terms, and whether a chunk's path is searched, too.
    tokenize: Callable[[Column], Column] = field(default=tokens)
    with_path: bool = False
    #: The last batch of each stream that is in it.
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def folder(self) -> str:
        """The newest segment's folder."""
        return self.segments[-1].folder

    @property
    def avgdl(self) -> float:
        return self.n_tokens / self.n_chunks if self.n_tokens else 1.0

    def _union(self, name: str, narrow: Callable[[DataFrame, Segment], DataFrame] = lambda df, _: df) -> DataFrame:
        parts = [narrow(s.read(self.spark, name), s).withColumn("_seg", F.lit(s.number)) for s in self.segments]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the rows (_seg, chunk_id, ...) of chunks that a later segment replaced. Spark broadcasts the list only
        where its size allows."""
        lists = [s.read(self.spark, "dead") for s in self.segments if s.n_dead]
        return rows.join(reduce(DataFrame.unionByName, lists).select("_seg", "chunk_id"), ["_seg", "chunk_id"], "left_anti").select(*rows.columns) if lists else rows

    @property
    def chunks(self) -> DataFrame:
        return self._live(self._union("chunks")).drop("_seg")

    @property
    def postings(self) -> DataFrame:
        """term, chunk_id, tf, dl."""
        rows = self._union("postings").select("_seg", "term", _entries().alias("e")).select("_seg", "term", F.col("e.ids").alias("chunk_id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
        return self._live(rows).drop("_seg")

    @property
    def terms(self) -> DataFrame:
        """term, df over all segments."""
        return self._union("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @property
    def docs(self) -> DataFrame:
        """The files that were given with the chunks, those without any text too."""
        parts = [s.read(self.spark, "docs") for s in self.segments if s.docs_schema]
        if not parts:
            raise IndexUnusable(f"the index in {self.root} was built without files")
        return reduce(DataFrame.unionByName, parts)

    def get(self, chunk_ids: list) -> DataFrame:
        """Chunks by id."""
        kind = T.StructType.fromJson(json.loads(self.segments[0].schema))["chunk_id"].dataType
        return self.texts_of(self.spark.createDataFrame([(c,) for c in chunk_ids], T.StructType([T.StructField("chunk_id", kind)])))

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """The chunks of ids (chunk_id). Which files hold them is looked up by the ids alone; then only those are read."""
        wanted = materialize(ids.select("chunk_id").distinct(), "ids")
        parts = []
        for s in self.segments:
            held = s.read(self.spark, "chunks").select("chunk_id", F.col("_metadata.file_path").alias("_file")).join(wanted, "chunk_id", "left_semi")
            files = [r["_file"] for r in held.select("_file").distinct().limit(MOST_FILES + 1).collect()]
            some = self.spark.read.schema(_schema("chunks", s.schema)).parquet(*files) if 0 < len(files) <= MOST_FILES else s.read(self.spark, "chunks")
            parts.append((some if files else some.limit(0)).withColumn("_seg", F.lit(s.number)))
        return self._live(reduce(DataFrame.unionByName, parts).join(wanted, "chunk_id", "left_semi")).drop("_seg")

    def summary(self) -> DataFrame:
        """One row: files, files with chunks (indexed), and chunks."""
        path = F.col("path") if "path" in self.chunks.columns else F.col("chunk_id")
        return self.chunks.agg(F.countDistinct(path).alias("files"), F.countDistinct(F.when(F.col("text").rlike(r"\S"), path)).alias("indexed"), F.count("*").alias("chunks"))

    # ------------------------------------------------------------ lexical search

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
        """query_id, term, idf, df, most_tf and least_dl of the questions' terms; the postings of these terms; and what
        would help: nothing, bounds of blocks for short questions, those of terms, sets of terms that questions share, or scores of whole blocks, made in tasks."""
        asked = materialize(queries.select("query_id", F.explode(F.array_distinct(self.tokenize(F.col("text")))).alias("term")), "asked")
        wanted = materialize(asked.select("term").distinct(), "wanted")
        known = materialize(self._union("terms").join(wanted, "term"), "known")
        idf = F.log(1 + (F.lit(self.n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        summed = known.groupBy("term").agg(F.sum("df").alias("df"), F.max("tf_max").alias("most_tf"), F.min("dl_min").alias("least_dl")).filter("df > 0")
        # Written, so that Spark sees its size and broadcasts it only where that allows.
        weighed = materialize(asked.join(summed.withColumn("idf", idf), "term").select("query_id", "term", "idf", "df", "most_tf", "least_dl"), "weighed")
        rows = known.agg(F.sum("n_rows")).head()[0] or 0
        short = weighed.count() <= SHORT * asked.select("query_id").distinct().count()
        read = lambda df, s: df
        if wanted.count() <= MOST_TERMS:
            parts: dict[int, list[int]] = {}
            folders = {s.number: s.parts for s in self.segments}
            of = F.create_map(*(F.lit(x) for pair in folders.items() for x in pair))[F.col("_seg")]
            for r in known.filter("n_rows > 0").select("_seg", _part_of(of).alias("part")).distinct().collect():  # at most a row a folder
                parts.setdefault(r["_seg"], []).append(r["part"])
            read = lambda df, s: df.filter(F.col("part").isin(sorted(parts.get(s.number, []))))
        helps = None if rows <= PRUNE_ABOVE else "blocks" if short else "terms"
        if (weighed.agg(F.sum("df")).head()[0] or 0) > MOST_ENTRIES:
            n, different = _sets(weighed).agg(F.count("*"), F.countDistinct("terms")).head()
            whole = weighed.count() <= MOST_ASKED and not any(s.n_dead for s in self.segments)
            helps = "sets" if 2 * different <= n else "tasks" if whole else helps
        return weighed, self._union("postings", read), helps

    def _part(self, tf: Column, dl: Column, k1: float, b: float) -> Column:
        return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(self.avgdl)))

    def _parts(self, blocks: DataFrame, weighed: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, chunk_id and part of a score, term by term; ``weighed`` (query_id, term, idf) may name the blocks
        (_seg, block), too."""
        met = blocks.join(weighed, [c for c in ("_seg", "block", "term") if c in weighed.columns])
        rows = met.select("_seg", "query_id", "idf", _entries().alias("e")).select("_seg", "query_id", F.col("e.ids").alias("chunk_id"), self._part(F.col("e.tfs"), F.col("e.dls"), k1, b).alias("part"))
        return self._live(rows).select("query_id", "chunk_id", "part")

    def _scores(self, blocks: DataFrame, weighed: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, chunk_id, score > 0."""
        return self._parts(blocks, weighed, k1, b).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")).filter("score > 0")

    def bm25(self, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, chunk_id, score > 0 for all queries, from the postings of their terms."""
        weighed, blocks, _ = self._asked(queries)
        return self._scores(blocks, weighed.select("query_id", "term", "idf"), k1, b)

    def search(self, queries: DataFrame, k: int = 10, *, k1: float = 1.5, b: float = 0.75, out: str = "rank", prune: str | None = None) -> DataFrame:
        """The best k chunks of each query, exactly. ``prune``: none, blocks, terms, sets or tasks; by itself where there are
        many postings, sets where questions differ in rare terms only, tasks for a batch of some thousand terms in all over
        chunks none of which was replaced, else blocks for short questions and terms for longer ones."""
        weighed, blocks, helps = self._asked(queries)
        how = {"k": k, "k1": k1, "b": b}
        prune = prune or helps
        if prune == "blocks":
            return top_k(self._by_blocks(blocks, weighed.select("query_id", "term", "idf"), **how), k, out=out)
        if prune == "terms":
            return top_k(self._by_terms(blocks, weighed, **how), k, out=out)
        if prune == "tasks":
            return top_k(self._in_tasks(blocks, weighed, **how), k, out=out)
        if prune == "sets":
            return top_k(self._by_sets(blocks, weighed, **how), k, out=out)
        return top_k(self._scores(blocks, weighed.select("query_id", "term", "idf"), k1, b), k, out=out)

    def _by_blocks(self, blocks: DataFrame, weighed: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """Scores of all chunks that can be among the best k: no block is opened that can't hold one of them.

        A block's bound is the sum over the question's terms of what the largest tf and least dl in it would give. The
        blocks with the largest bounds are scored first; the k-th best score found is what the others' bounds must
        reach. A chunk is in one block only, so its score is whole there.
        """
        bound = self._part(F.col("tf_max"), F.col("dl_min"), k1, b)
        bounds = blocks.select("_seg", "term", "block", "tf_max", "dl_min").join(weighed, "term").groupBy("query_id", "_seg", "block").agg(F.sum(bound).alias("bound"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "_seg", "block"))
        bounds = materialize(bounds.withColumn("place", place), "bounds")
        opened = lambda some: self._scores(blocks, materialize(some.select("query_id", "_seg", "block").join(weighed, "query_id"), "opened"), k1, b)
        first = materialize(top_k(opened(bounds.filter(F.col("place") <= FIRST_BLOCKS)), k), "first")
        least = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.filter(F.col("place") > FIRST_BLOCKS).join(least, "query_id", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        return first.drop("rank").unionByName(opened(rest))

    def _by_terms(self, blocks: DataFrame, weighed: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """Scores of all chunks that can be among the best k: those with frequent terms alone are never gathered.

        The question's rarest terms give a first k-th best score. The terms that could not reach it together are left
        out; a chunk must have one of the others, and with them enough that the ones left out could make up the rest.
        Only for such chunks are the frequent terms added, where their postings lie.
        """
        bound = self._part(F.col("most_tf"), F.col("least_dl"), k1, b)
        own = Window.partitionBy("query_id")  # a question's terms
        terms = materialize(weighed.select("query_id", "term", "idf", bound.alias("bound"), F.row_number().over(own.orderBy("df", "term")).alias("place")), "terms")
        rough = top_k(self._scores(blocks, terms.filter(F.col("place") <= RAREST).select("query_id", "term", "idf"), k1, b), k)
        least = rough.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        below = F.sum("bound").over(own.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0))
        split = materialize(terms.join(least, "query_id", "left").withColumn("needed", F.coalesce(below >= F.col("least") - SLACK, F.lit(True))), "split")
        rest = split.filter("NOT needed").groupBy("query_id").agg(F.sum("bound").alias("rest"), F.max("least").alias("least"))
        found = self._scores(blocks, split.filter("needed").select("query_id", "term", "idf"), k1, b)
        enough = F.coalesce(F.col("score") + F.col("rest") >= F.col("least") - SLACK, F.lit(True))
        able = materialize(found.join(rest, "query_id", "left").filter(enough).select("query_id", "chunk_id", "score"), "able")
        more = self._parts(blocks, split.filter("NOT needed").select("query_id", "term", "idf"), k1, b).join(able.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
        return able.unionByName(more.withColumnRenamed("part", "score")).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))

    def _by_sets(self, blocks: DataFrame, weighed: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """Scores of all chunks that can be among the best k, where many questions have the same frequent terms.

        What a set of frequent terms gives is worked out once, for all questions that have it. Chunks that hold the same
        frequent terms to the same parts of a score rank by id for any set, so only the first k of them matter. A chunk
        without a rare term of the question is among its best only if it is among the best k of its set; those with one
        are few, and get the set's part from what the chunk holds.
        """
        often, seldom = weighed.filter(F.col("df") > SELDOM), weighed.filter(F.col("df") <= SELDOM)
        named = Window.partitionBy("terms")
        sets = materialize(_sets(weighed).withColumn("_set", F.min("query_id").over(named)), "sets")
        entries = self._live(blocks.join(often.select("term", "idf").distinct(), "term").select("_seg", "term", "idf", _entries().alias("e")).select("_seg", "term", F.col("e.ids").alias("chunk_id"), self._part(F.col("e.tfs"), F.col("e.dls"), k1, b).alias("part")))
        held = materialize(entries.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("held")), "held")
        alike = held.withColumn("_n", F.row_number().over(Window.partitionBy("held").orderBy("chunk_id"))).filter(F.col("_n") <= k)
        words = sets.filter(F.col("query_id") == F.col("_set")).select("_set", F.explode("terms").alias("term"))
        scored = alike.select("chunk_id", F.explode("held").alias("h")).select("chunk_id", "h.term", "h.part").join(words, "term").groupBy(F.col("_set").alias("query_id"), "chunk_id").agg(F.sum("part").alias("score"))
        best = materialize(top_k(scored, k).select(F.col("query_id").alias("_set"), "chunk_id", "score"), "best")

        own = materialize(self._scores(blocks, seldom.select("query_id", "term", "idf"), k1, b), "own")
        shared = F.aggregate(F.filter("held", lambda h: F.array_contains("terms", h["term"])), F.lit(0.0), lambda s, h: s + h["part"])
        whole = own.join(sets, "query_id", "left").join(held, "chunk_id", "left").select("query_id", "chunk_id", (F.col("score") + F.coalesce(shared, F.lit(0.0))).alias("score"))
        others = sets.select("query_id", "_set").join(best, "_set").select("query_id", "chunk_id", "score").join(own, ["query_id", "chunk_id"], "left_anti")
        return whole.unionByName(others)

    def _in_tasks(self, blocks: DataFrame, weighed: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """The best k chunks of each block for each query. A chunk is in one block only, so a task that has the block's
        rows of postings has all of its score: these rows are shuffled once for all queries, and no score is. For a batch
        with few terms, and without dead chunks."""
        asked = weighed.select("query_id", "term", "idf").orderBy("query_id", "term").collect()  # MOST_ASKED short rows at most
        idfs, terms = {r["term"]: r["idf"] for r in asked}, {}
        for r in asked:
            terms.setdefault(r["query_id"], []).append(r["term"])
        shared, avgdl = self.spark.sparkContext.broadcast((idfs, list(terms.items()))), self.avgdl
        names = T.StructType.fromJson(json.loads(self.segments[0].schema))["chunk_id"].dataType

        def best(table: pa.Table) -> pa.Table:
            idf_of, queries = shared.value
            table = table.combine_chunks()
            ids, tf, dl = (table.column(c).combine_chunks().flatten() for c in ("ids", "tfs", "dls"))
            tf, dl = np.asarray(tf).astype(float), np.asarray(dl).astype(float)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(table.column("ids"))))])
            rows = {t: slice(ends[i], ends[i + 1]) for i, t in enumerate(table.column("term").to_pylist())}
            idf = np.repeat([idf_of[t] for t in rows], np.diff(ends))
            part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            coded = ids.dictionary_encode()
            own, at = coded.dictionary, np.asarray(coded.indices)
            places = np.argsort(np.asarray(pc.sort_indices(own)))
            found = []
            for query, wanted in queries:
                held = [rows[t] for t in wanted if t in rows]
                if not held:
                    continue
                score = np.bincount(np.concatenate([at[s] for s in held]), np.concatenate([part[s] for s in held]), len(own))
                take = np.flatnonzero(score > 0)
                if len(take) > 4 * k:
                    take = take[score[take] >= np.partition(score[take], len(take) - k)[len(take) - k] - 2e-9]
                take = take[np.lexsort((places[take], -score[take].round(9)))[:k]]
                found.append((query, take, score[take]))
            takes = np.concatenate([t for _, t, _ in found]) if found else np.zeros(0, np.int64)
            return pa.table({
                "query_id": pa.array([q for q, t, _ in found for _ in t], told.field("query_id").type), "chunk_id": own.take(pa.array(takes)),
                "score": pa.array(np.concatenate([s for _, _, s in found]) if found else np.zeros(0)),
            })

        wanted = blocks.join(weighed.select("term").distinct(), "term", "left_semi").select("_seg", "block", "term", "ids", "tfs", "dls")
        told = to_arrow_schema(T.StructType([weighed.schema["query_id"], T.StructField("chunk_id", names), T.StructField("score", T.DoubleType())]))
        return wanted.groupBy("_seg", "block").applyInArrow(best, f"query_id {weighed.schema['query_id'].dataType.simpleString()}, chunk_id {names.simpleString()}, score double")

    def files(self, queries: DataFrame, *, k: int = 10, per_file: int = 3, penalty: float = 0.4) -> DataFrame:
        """File-corpus search over chunks with path and superseded: over-fetch 6 k, demote superseded, cap each file."""
        raw = self.search(queries, 6 * k, k1=1.4, out="raw_rank")
        return capped(raw.join(self.chunks.select("chunk_id", "path", "superseded"), "chunk_id"), k, per_file, penalty)

    # ------------------------------------------------------------ identifiers

    @property
    def identifiers(self) -> DataFrame:
        """ident, path, chunk_id."""
        return self._live(self._union("idents")).drop("_seg")

    def identifier_files(self, idents: DataFrame | None = None, most: int = 12) -> DataFrame:
        """ident, path and n_files of the identifiers (of ``idents``) that are in at most ``most`` files."""
        rows = self.identifiers if idents is None else self.identifiers.join(idents.select("ident").distinct(), "ident", "left_semi")
        pairs = rows.select("ident", "path").distinct()
        return pairs.join(pairs.groupBy("ident").agg(F.count("*").alias("n_files")).filter(F.col("n_files") <= most), "ident")

    def expand(self, queries: DataFrame, *, k: int = 10, looked_at: int = 5, most: int = 6) -> DataFrame:
        """query_id, chunk_id, path, hop (1 or 2) and rank: the first hits, then what the rarest identifiers of the first
        few bring that the question doesn't hold; at most k + 6 of both. No text is read: identifiers of hits come
        from their table, both searches from postings."""
        first = materialize(self.files(queries, k=k).select("query_id", "chunk_id", "path", "rank"), "hits")
        asked = queries.select("query_id", grader_form(F.col("text")).alias("asked"), F.col("text").alias("question"))
        seen = first.filter(F.col("rank") <= looked_at).select("query_id", "chunk_id")
        named = materialize(self.identifiers.select("chunk_id", "ident").join(seen, "chunk_id").select("query_id", "ident").distinct().join(asked, "query_id").filter(~F.contains(F.col("asked"), F.col("ident"))), "named")
        counts = self.identifier_files(named).select("ident", "n_files").distinct()
        rare = named.join(counts, "ident").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("n_files", "ident"))).filter(F.col("_n") <= most)
        words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "ident"))), lambda x: x["ident"]), " ")
        again = rare.groupBy("query_id").agg(words.alias("w"), F.first("question").alias("q")).select("query_id", F.concat_ws(" ", "w", "q").alias("text"))
        second = self.files(again, k=k).select("query_id", "chunk_id", "path", "rank").join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank"))
        return both.withColumn("rank", place).filter(F.col("rank") <= k + 6)

    def file_texts(self, paths: DataFrame) -> DataFrame:
        """path and text: the chunks of some files, joined by lines in order of chunk_id; from the folders that can hold
        them."""
        ids = materialize(self.chunks.select("chunk_id", "path").join(paths.select("path").distinct(), "path", "left_semi").select("chunk_id"), "ids")
        listed = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))  # a file's chunks
        return self.texts_of(ids).groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))

    # ------------------------------------------------------------ vectors

    def vectors(self, kind: str = "md5") -> DataFrame:
        """Hashed vectors of the chunks, made for each segment when first asked for and kept with it."""
        name = f"vectors-{kind}"
        for s in self.segments:
            try:
                s.read(self.spark, name)
            except AnalysisException:
                trigram_vectors(s.read(self.spark, "chunks").select("chunk_id", "text"), "chunk_id", kind=kind).write.mode("ignore").parquet(f"{s.folder}/{name}")
        return self._live(self._union(name)).drop("_seg")

    def hybrid(self, queries: DataFrame, k: int = 8, kind: str = "md5") -> DataFrame:
        """The best k of fused lexical and dense rankings, each over-fetched twice."""
        lexical = self.search(queries, 2 * k)
        dense = dense_top_k(self.vectors(kind), trigram_vectors(queries, "query_id", kind=kind), 2 * k, n_vectors=self.n_chunks)
        return reciprocal_rank_fusion(lexical, dense).filter(F.col("fused_rank") <= k).withColumn("fused_score", F.round("fused_score", 6))


def fingerprint_of(spark: SparkSession, path: str) -> str:
    """Of a table's files: their names and sizes. Only the listing is read."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    line = F.concat_ws(":", "name", F.col("length").cast("string"))
    # One short line a file; sums of hashes need no order and no gathering.
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("s")).head()
    return f"{row['n']}:{row['s']}"


# ---------------------------------------------------------------- segments


def _sets(weighed: DataFrame) -> DataFrame:
    """query_id and its frequent terms, in order."""
    return weighed.filter(F.col("df") > SELDOM).groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def _entries() -> Column:
    """A row of postings, chunk by chunk."""
    return F.explode(F.arrays_zip("ids", "tfs", "dls"))


def _part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("term"), parts).cast("int")


def _words(chunks: DataFrame, tokenize: Callable[[Column], Column], with_path: bool) -> DataFrame:
    """chunk_id and its words, w, repeats kept."""
    text = F.concat_ws("\n", "path", "text") if with_path else F.coalesce("text", F.lit(""))
    return chunks.select("chunk_id", tokenize(text).alias("w"))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of postings of blocks of chunks as they come: a chunk is in one block, and a block in one task, which counts
    it. Blocks are numbered by task; the stored chunks come the same way whenever a task runs again."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_CHUNKS):
            part = batch.slice(i, BLOCK_CHUNKS)
            words = part.column("w")
            dl = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int32)
            coded = words.flatten().dictionary_encode()
            key = np.asarray(coded.indices).astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl)
            count += 1
            if not len(key):
                continue
            pairs, tf = np.unique(key, return_counts=True)
            code, row = np.divmod(pairs, len(dl))
            first = np.flatnonzero(np.diff(code, prepend=-1))
            ends = pa.array([*first, len(pairs)], pa.int32())
            listed = lambda values: pa.ListArray.from_arrays(ends, values)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), (task << 32) + count)), pa.array(np.diff(np.append(first, len(pairs)))),
                    pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), pa.array(np.minimum.reduceat(dl[row], first)), pa.array(np.add.reduceat(tf, first)),
                    listed(part.column("chunk_id").take(pa.array(row))), listed(pa.array(tf.astype(np.int32))), listed(pa.array(dl[row])),
                ],
                names=["term", "block", "n", "tf_max", "dl_min", "tf_sum", "ids", "tfs", "dls"],
            )


def _postings(words: DataFrame, parts: int) -> DataFrame:
    """Rows of postings, dealt by the term's hash; a term that many chunks hold has many rows, whose folder Spark splits
    among tasks as it grows."""
    kind = words.schema["chunk_id"].dataType.simpleString()
    rows = words.mapInArrow(_in_blocks, _postings_ddl(kind)).withColumn("part", _part_of(F.lit(parts)))
    return rows.hint("rebalance", "part").sortWithinPartitions("part", "term", "block")


def _idents(chunks: DataFrame) -> DataFrame:
    found = chunks.select(F.explode(identifiers(F.coalesce("text", F.lit("")))).alias("ident"), "path", "chunk_id").distinct()
    return found.repartitionByRange("ident", "path").sortWithinPartitions("ident", "path")


def _write_segment(chunks: DataFrame, root: str, number: int, tokenize: Callable[[Column], Column], with_path: bool, old: EvidenceIndex | None = None, key: str | None = None, docs: DataFrame | None = None) -> Segment:
    """Writes a segment. With an old version, its chunks of the same documents (``key``) are put on the list of dead ones,
    and their terms are taken out of the sums."""
    spark, folder = chunks.sparkSession, f"{root}/v-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder}/chunks")
    made = Segment(number, folder, 0, 0, 0, 0, 0, 0, 1, chunks.schema.json(), "" if docs is None else docs.schema.json())
    stored = made.read(spark, "chunks")
    n = stored.count()
    made = replace(made, n_chunks=n, parts=max(1, -(-n // PART_CHUNKS)))
    if docs is not None:
        docs.write.parquet(f"{folder}/docs")
    with shuffles_dropped(spark):
        _postings(_words(stored, tokenize, with_path), made.parts).write.partitionBy("part").parquet(f"{folder}/postings")
    postings = made.read(spark, "postings")
    if with_path:
        with shuffles_dropped(spark):
            _idents(stored).write.parquet(f"{folder}/idents")
    terms = postings.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_rows"), F.max("tf_max").alias("tf_max"), F.min("dl_min").alias("dl_min"))
    n_dead = lost_tokens = 0
    if old is not None:
        gone = old._live(old._union("chunks").select("_seg", "chunk_id", key)).join(stored.select(key).distinct(), key, "left_semi").select("_seg", "chunk_id")
        gone.write.parquet(f"{folder}/dead")
        dead = made.read(spark, "dead")
        n_dead = dead.count()
        if n_dead:
            lost = materialize(_words(old.texts_of(dead), tokenize, with_path).groupBy("chunk_id").agg(F.first("w").alias("w")), "lost")
            lost_tokens = lost.agg(F.sum(F.size("w"))).head()[0] or 0
            less = lost.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df")).withColumns({"n_rows": F.lit(0).cast("long"), "tf_max": F.lit(None).cast("int"), "dl_min": F.lit(None).cast("int")})
            terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_rows").alias("n_rows"), F.max("tf_max").alias("tf_max"), F.min("dl_min").alias("dl_min"))
    with shuffles_dropped(spark):
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    total, rows = postings.agg(F.sum("tf_sum"), F.count("*")).head()
    return replace(made, n_chunks=n - n_dead, n_tokens=(total or 0) - lost_tokens, n_postings=rows, n_terms=made.read(spark, "terms").count(), n_dead=n_dead, n_docs=made.read(spark, "docs").count() if docs is not None else 0)


# ---------------------------------------------------------------- versions


def _name(tokenize: Callable[[Column], Column]) -> str:
    return getattr(tokenize, "__qualname__", repr(tokenize))


def _commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).json(f"{root}/commits").filter("seq IS NOT NULL")
    except AnalysisException:  # no folder: no version yet
        return spark.createDataFrame([], COMMIT)


def _newest(spark: SparkSession, root: str) -> int:
    return _commits(spark, root).agg(F.max("seq")).head()[0] or 0


def _commit(spark: SparkSession, root: str, seq: int, fingerprint: str, segments: list[Segment], tokenize: Callable[[Column], Column], with_path: bool, batches: dict[str, int]) -> EvidenceIndex | None:
    """The new version, or None where there is one of that number."""
    n, total = sum(s.n_chunks for s in segments), sum(s.n_tokens for s in segments)
    row = {"seq": seq, "layout": VERSION, "fingerprint": fingerprint, "tokenizer": _name(tokenize), "with_path": with_path, "n_chunks": n, "n_tokens": total, "batches": batches, "segments": [vars(s) for s in segments]}
    if not put_new(spark, f"{root}/commits/{seq:012d}.json", json.dumps(row)):
        return None
    return EvidenceIndex(spark, root, seq, fingerprint, n, total, segments, tokenize, with_path, batches)


def _tried(spark: SparkSession, root: str, make: Callable[[], EvidenceIndex | None]) -> EvidenceIndex:
    for _ in range(TRIES):
        made = make()
        if made is not None:
            return made
    raise IndexBusy(f"other writers were faster {TRIES} times in {root}")


def save(chunks: DataFrame, root: str, fingerprint: str, *, tokenize: Callable[[Column], Column] = tokens, with_path: bool = False, docs: DataFrame | None = None) -> EvidenceIndex:
    """Builds an index over chunks (chunk_id, text, and path where it is searched too) and keeps it in ``root``, as a
    version of one segment; ``docs`` (path, ...), the files, are kept beside it."""
    spark, root = chunks.sparkSession, root.rstrip("/")
    made = _write_segment(chunks, root, 1, tokenize, with_path, docs=docs)
    return _tried(spark, root, lambda: _commit(spark, root, _newest(spark, root) + 1, fingerprint, [made], tokenize, with_path, {}))


def _whole(index: EvidenceIndex) -> bool:
    """Whether all tables are there and as long as the version says. A read that fails is tried once more, so that a
    passing fault isn't taken for damage."""
    # A segment's chunks are as many as it has now and as it took from older ones.
    sizes = [(s, name, n) for s in index.segments for name, n in (("chunks", s.n_chunks + s.n_dead), ("postings", s.n_postings), ("terms", s.n_terms))]
    for last in (False, True):
        try:  # counts come from the files' footers, so this reads no rows at any size
            counts = [s.read(index.spark, name).agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, (s, name, _) in enumerate(sizes)]
            got = {r["k"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}
            return all(got[k] == n for k, (_, _, n) in enumerate(sizes))
        except AnalysisException:
            return False
        except (PySparkException, Py4JJavaError):
            if last:
                return False
    return False


def load(spark: SparkSession, root: str, *, tokenize: Callable[[Column], Column] = tokens, with_path: bool = False, seq: int | None = None) -> EvidenceIndex:
    """The newest version of ``root``, or that of a number; IndexUnusable without one of this layout and of these terms.
    Where postings or terms are missing, damaged or out of step with the chunks, they are built again from the chunks,
    as a new version: readers of the old one keep what they have."""
    root = root.rstrip("/")
    commits = _commits(spark, root)
    rows = (commits.orderBy(F.desc("seq")) if seq is None else commits.filter(F.col("seq") == seq)).limit(1).collect()
    if not rows or rows[0]["layout"] != VERSION:
        raise IndexUnusable(f"no index of version {VERSION} in {root}")
    found = rows[0]
    if (found["tokenizer"], found["with_path"]) != (_name(tokenize), with_path):
        raise IndexUnusable(f"the index in {root} has terms of {found['tokenizer']}, paths {'searched' if found['with_path'] else 'left out'}")
    segments = [Segment(**s.asDict()) for s in found["segments"]]
    index = EvidenceIndex(spark, root, found["seq"], found["fingerprint"], found["n_chunks"], found["n_tokens"], segments, tokenize, with_path, dict(found["batches"] or {}))
    return index if seq is not None or _whole(index) else compact(index)


def compact(index: EvidenceIndex) -> EvidenceIndex:
    """One segment of all chunks that are left, as a new version; IndexBusy where another writer is faster."""
    docs = index.docs if any(s.docs_schema for s in index.segments) else None
    made = _write_segment(index.chunks, index.root, index.seq + 1, index.tokenize, index.with_path, docs=docs)
    new = _commit(index.spark, index.root, index.seq + 1, index.fingerprint, [made], index.tokenize, index.with_path, index.batches)
    if new is None:
        raise IndexBusy(f"another writer was faster in {index.root}")
    return new


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Takes away all but the newest ``keep`` versions and the segments that only they name; gives the numbers kept.
    Readers of older versions must be done."""
    root = root.rstrip("/")
    rows = _commits(spark, root).select("seq", F.transform("segments", lambda s: s["folder"]).alias("folders")).orderBy(F.desc("seq")).collect()  # a short row a version
    kept = {f for r in rows[:keep] for f in r["folders"]}
    for r in rows[keep:]:
        remove(spark, f"{root}/commits/{r['seq']:012d}.json")
    for folder in {f for r in rows[keep:] for f in r["folders"]} - kept:
        remove(spark, folder)
    return sorted(r["seq"] for r in rows[:keep])


def load_or_build(spark: SparkSession, root: str, fingerprint: str, chunks: Callable[[EvidenceIndex | None], DataFrame | tuple[DataFrame, DataFrame]], *, tokenize: Callable[[Column], Column] = tokens, with_path: bool = False) -> EvidenceIndex:
    """The index of ``root`` if its fingerprint is this one; else a new one over ``chunks(old)``, which gets the old
    index, or None, so that what is dear to make (transcripts) can be taken from it, and gives chunks, or chunks and
    docs."""
    try:
        old = load(spark, root, tokenize=tokenize, with_path=with_path)
    except IndexUnusable:
        old = None
    if old is not None and old.fingerprint == fingerprint:
        return old
    made = chunks(old)
    rows, docs = made if isinstance(made, tuple) else (made, None)
    return save(rows, root, fingerprint, tokenize=tokenize, with_path=with_path, docs=docs)


def ingest(spark: SparkSession, root: str, new: DataFrame, *, key: str = "document_id", tokenize: Callable[[Column], Column] = tokens, with_path: bool = False, batch: tuple[str, int] | None = None) -> EvidenceIndex:
    """Adds chunks (chunk_id, ``key``, text, ...) to the index of ``root`` as a segment; documents that are there already
    are replaced, chunks and postings alike. What is written and read grows with the new chunks and those that they
    replace (of older segments, the ids and keys are read); older segments' files stay as they are. Documents without
    chunks change nothing. A ``batch`` (stream and number) that is in already isn't taken twice."""
    root = root.rstrip("/")

    def once() -> EvidenceIndex | None:
        try:
            old = load(spark, root, tokenize=tokenize, with_path=with_path)
        except IndexUnusable:
            if _newest(spark, root):
                raise
            old = None
        if old is not None and batch is not None and old.batches.get(batch[0], -1) >= batch[1]:
            return old
        if old is not None and new.isEmpty():
            return old
        seq = (old.seq if old else 0) + 1
        before = [] if old is None else old.segments
        rows = new if not before else new.select(*T.StructType.fromJson(json.loads(before[0].schema)).names)
        made = _write_segment(rows, root, seq, tokenize, with_path, old, key)
        batches = {**(old.batches if old else {}), **({batch[0]: batch[1]} if batch else {})}
        done = _commit(spark, root, seq, f"{old.fingerprint if old else ''}+{uuid.uuid4().hex[:8]}"[-200:], [*before, made], tokenize, with_path, batches)
        return compact(done) if done is not None and len(done.segments) > MOST_SEGMENTS else done

    return _tried(spark, root, once)


def follow(stream: DataFrame, root: str, name: str, *, key: str = "document_id", tokenize: Callable[[Column], Column] = tokens, with_path: bool = False) -> DataStreamWriter:
    """A writer that ingests each batch of a stream of chunks once: the version that holds a batch names its number, so
    that a batch which is sent again after a failure changes nothing. The caller sets the checkpoint and the trigger."""

    def write(batch: DataFrame, number: int) -> None:
        ingest(batch.sparkSession, root, batch, key=key, tokenize=tokenize, with_path=with_path, batch=(name, number))

    return stream.writeStream.foreachBatch(write)


def dead_share(index: EvidenceIndex) -> float:
    """Share of the chunks on record that were replaced, by which a caller may choose to compact."""
    dead = sum(s.n_dead for s in index.segments)
    return dead / max(1, index.n_chunks + dead)
