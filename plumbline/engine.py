"""Engines: whole plans from documents and questions to answers, each a few staged batches over tables.

``Engine`` answers from chunked documents with claims and citations, ``ContractEngine`` from a folder of files with one
value and its exact files. Questions and replies are tables; a batch of any size is one plan, and no model is called:
``prompts`` gives what to ask, ``answer`` takes what came back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.paths import walk_key
from plumbline.functions.text import citation_label, file_tokens
from plumbline.operators import answering, chunking, corpus, index, retrieval, verification
from plumbline.session import materialize
from plumbline.sources import folder as source


@dataclass(frozen=True)
class Settings:
    """How documents are cut, searched and judged."""

    chunk_tokens: int = 180
    overlap_tokens: int = 30
    top_k: int = 8
    reranked: int = 4
    least_fused: float = 0.02
    most_unsupported: float = 0.20
    prompt: str = answering.DEFAULT_PROMPT
    #: Files: excerpts of the first search, lines of a piece.
    file_top_k: int = 10
    piece_tokens: int = 170


class Engine:
    """Documents with headings, kept in an index under ``root``, and answers made of claims."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root, settings or Settings()
        answering.prompt_of(self.settings.prompt)

    @property
    def index(self) -> index.EvidenceIndex:
        """The newest version; EmptyCorpus without one."""
        try:
            return index.load(self.spark, self.root)
        except index.IndexUnusable as e:
            raise answering.EmptyCorpus("nothing has been ingested") from e

    def chunks_of(self, docs: DataFrame) -> DataFrame:
        """chunk_id, document_id, title, section, position and text of documents (document_id, text, and title if any)."""
        named = docs.withColumn("title", F.lit("")) if "title" not in docs.columns else docs
        sections = chunking.split_sections(named.select(F.col("document_id").alias("doc_id"), "text"))
        cut = chunking.chunk_documents(sections, self.settings.chunk_tokens, self.settings.overlap_tokens)
        titles = named.groupBy("document_id").agg(F.max("title").alias("title"))
        return cut.withColumnRenamed("doc_id", "document_id").join(titles, "document_id").select("chunk_id", "document_id", "title", "section", "position", "text")

    def ingest(self, docs: DataFrame, *, batch: tuple[str, int] | None = None) -> index.EvidenceIndex:
        """Adds documents as a segment; those that are there already are replaced."""
        return index.ingest(self.spark, self.root, materialize(self.chunks_of(docs), "chunks"), batch=batch)

    def info(self) -> DataFrame:
        """One row: documents, chunks, segments, and the prompt versions."""
        kept = self.index
        told = kept.chunks.agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"))
        return told.withColumns({"segments": F.lit(len(kept.segments)), "prompts": F.array(*map(F.lit, sorted(answering.PROMPTS)))})

    def search(self, questions: DataFrame) -> DataFrame:
        """query_id, rank, chunk_id, label, document_id, text: lexical and dense rankings fused, reranked and cut."""
        kept, s = self.index, self.settings
        fused = materialize(kept.hybrid(questions, s.top_k), "fused")
        texts = kept.texts_of(fused).select("chunk_id", "document_id", "title", "section", "text")
        met = fused.join(texts, "chunk_id").join(questions.select("query_id", F.col("text").alias("query_text")), "query_id")
        best = retrieval.rerank_select(retrieval.jaccard_rerank(met), s.reranked, s.least_fused)
        return best.select("query_id", F.col("final_rank").alias("rank"), "chunk_id", citation_label(F.col("title"), F.col("section"), F.col("document_id").cast("string")).alias("label"), "document_id", "text", "rerank_score")

    def prompts(self, questions: DataFrame, version: str | None = None) -> DataFrame:
        """query_id, system and user of every question that has something to be asked with."""
        prompt = answering.prompt_of(version or self.settings.prompt)
        asked = questions.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
        if prompt.requires_context:
            asked = asked.join(answering.format_context(self.search(questions)), "query_id")
        context = F.col("context") if prompt.requires_context else F.lit("")
        return asked.select("query_id", F.lit(prompt.system).alias("system"), answering.user_turn(prompt, F.col("text"), context).alias("user"))

    def conflicts(self, hits: DataFrame) -> DataFrame:
        """Numbers on which a question's hits disagree."""
        texts = hits.select("query_id", F.col("rank").cast("long").alias("place"), F.col("document_id").cast("string").alias("source"), "text")
        mentions = verification.number_mentions(texts)
        return verification.find_conflicts(mentions.withColumn("ord", F.struct("place", "pos")))

    def answer(self, questions: DataFrame, replies: DataFrame, version: str | None = None) -> DataFrame:
        """query_id, outcome, answer, shares, warning, cited chunks and number of conflicts for every question."""
        version = version or self.settings.prompt
        kept, retrieves = self.index, answering.prompt_of(version).requires_context
        none = self.spark.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, rank int, chunk_id string, label string, document_id string, text string")
        hits = materialize(self.search(questions), "hits") if retrieves else none
        # Claims are held against the chunks that they name, wherever those were found.
        parsed = replies.select(F.explode(F.from_json(answering.json_object(F.col("raw")), answering.CLAIMS_REPLY)["claims"]).alias("c")).select(F.explode("c.cited_chunk_ids").alias("chunk_id"))
        cited = materialize(kept.texts_of(parsed).select("chunk_id", "text"), "cited")
        told = answering.service_outcomes(questions, hits, replies, cited, version=version, most_unsupported=self.settings.most_unsupported, empty=kept.n_chunks == 0)
        counts = self.conflicts(hits).groupBy("query_id").agg(F.count("*").alias("n_conflicts"))
        return told.join(counts, "query_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))


class ContractEngine:
    """A folder of files, indexed under ``root``, and answers of one value with the files that it stands in."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root, settings or Settings()

    @property
    def kept(self) -> index.EvidenceIndex:
        try:
            return index.load(self.spark, self.root, tokenize=file_tokens, with_path=True)
        except index.IndexUnusable as e:
            raise answering.EmptyCorpus("no folder has been indexed") from e

    def index(self, folder: str, transcripts: DataFrame | None = None) -> DataFrame:
        """Indexes a folder, unless the index is of these files already, and gives its summary (files, indexed, chunks).

        transcripts: path and text of images, for those that were read; what an older index has of an image is taken
        from there. Files without text stay in ``docs``, with the reason.
        """
        told = "" if transcripts is None else str(transcripts.agg(F.count("*"), F.sum(F.xxhash64("path", "text").cast("decimal(38,0)"))).head()[:])
        kept = index.load_or_build(self.spark, self.root, f"{source.fingerprint(folder)}{told}", lambda old: self._tables(folder, transcripts, old), tokenize=file_tokens, with_path=True)
        return kept.docs.agg(F.count("*").alias("files"), F.count_if("indexed").alias("indexed")).withColumn("chunks", F.lit(kept.n_chunks))

    def _tables(self, folder: str, transcripts: DataFrame | None, old: index.EvidenceIndex | None) -> tuple[DataFrame, DataFrame]:
        """The folder's chunks and docs."""
        parsed = materialize(source.scan(self.spark, folder), "parsed")
        images = parsed.filter("kind = 'image'").select("path")
        told = images.join(transcripts.select("path", "text"), "path", "left") if transcripts is not None else images.withColumn("text", F.lit(None).cast("string"))
        if old is not None:
            earlier = old.file_texts(old.docs.filter("kind = 'image' AND indexed").select("path"))
            told = corpus.reuse_transcripts(told, earlier).drop("reused")
        read = materialize(told.filter(F.col("text").rlike(r"\S")).groupBy("path").agg(F.max("text").alias("text")), "read")

        seen = parsed.join(read.select("path", F.lit(True).alias("_read")), "path", "left").withColumn("indexed", (F.size("segments") > 0) | F.col("_read").isNotNull())
        reason = F.when(~F.col("indexed"), F.col("skipped"))
        docs = seen.select("path", "kind", "indexed", "withdrawn", reason.alias("reason"))
        docs = materialize(corpus.mark_superseded(corpus.with_revisions(docs)).select("path", "kind", "family", F.transform("revision", lambda x: x.cast("string")).alias("revision"), "withdrawn", "superseded_by", "superseded", "indexed", "reason"), "docs")

        segments = parsed.select("path", F.posexplode("segments").alias("segment", "s")).select("path", "segment", "s.locator", "s.text")
        segments = segments.unionByName(read.select("path", F.lit(0).alias("segment"), F.lit("image transcription").alias("locator"), "text"))
        pieces = chunking.chunk_lines(segments, self.settings.piece_tokens).join(docs.select("path", "superseded"), "path")
        # Ids sort as the folder is walked, so that ties go to what comes first.
        name = F.concat_ws("\u0001", walk_key(F.col("path")), F.format_string("%06d.%06d", "segment", "piece_no"))
        return pieces.select(name.alias("chunk_id"), "path", "locator", "text", "superseded"), docs

    def hits(self, questions: DataFrame, kept: index.EvidenceIndex | None = None) -> DataFrame:
        """query_id, rank, hop, chunk_id, path, locator and text of both hops; only hits' texts are read."""
        kept = kept or self.kept
        found = materialize(kept.expand(questions, k=self.settings.file_top_k), "found")
        texts = kept.texts_of(found)
        locator = F.col("locator") if "locator" in texts.columns else F.lit("")
        return found.join(texts.select("chunk_id", locator.alias("locator"), "text"), "chunk_id").select("query_id", "rank", "hop", "chunk_id", "path", "locator", "text")

    def prompts(self, questions: DataFrame) -> DataFrame:
        """query_id and prompt of the questions that have a hit; the others aren't worth asking."""
        kept = self.kept
        return answering.file_prompts(questions, self.hits(questions, kept), kept.docs)

    def answer(self, questions: DataFrame, replies: DataFrame, out: str | None = None) -> DataFrame:
        """query_id, answer, citations, confidence and reason for every question, written to ``out`` as well if given.

        replies: query_id and raw, the model's text; a question without a usable one is refused, as is one without hits.
        """
        kept = self.kept
        hits = materialize(self.hits(questions, kept), "hits")
        files = kept.docs.filter("indexed").select("path", "superseded")
        texts = kept.file_texts(hits.select("path"))
        told = materialize(answering.file_outcomes(questions, hits, replies, files, kept.identifier_files().select("ident", "path"), texts), "outcomes")
        if out is not None:
            answering.write_outputs(told, out)
        return told
