"""Every registered query over the driver's tables. Their SQL is in ``oracles``."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import ContractEngine
from plumbline.functions import paths as P
from plumbline.functions import text as X
from plumbline.operators import answering, chunking, corpus, evaluation, grounding, index, retrieval, verification
from plumbline.plans.oracles import ORACLES
from plumbline.session import materialize, shared_dir

__all__ = ["ORACLES", "QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: one each."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def few_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of dense searches: ids divisible by 50."""
    return questions(spark, sf_dir).filter(F.col("query_id") % 50 == 0)


def _md5(c) -> F.Column:
    return F.md5(c.cast("binary"))


# ---------------------------------------------------------------- text


@query
def tokenize_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(t)).cast("long").alias("n_tokens"), F.size(F.array_distinct(X.tokens(t))).cast("long").alias("n_distinct"), _md5(F.array_join(X.tokens(t), " ")).alias("tokens_md5"))


@query
def content_terms(spark, sf_dir):
    terms = F.array_sort(X.content_terms(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), _md5(F.array_join(terms, " ")).alias("terms_md5"))


@query
def sentence_split(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), _md5(F.array_join(s, "|")).alias("sentences_md5"))


@query
def contract_tokenize(spark, sf_dir):
    t = X.file_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), _md5(F.array_join(t, " ")).alias("tokens_md5"))


@query
def plural_stem(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).groupBy(X.stem(F.col("token")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query
def grader_normalize(spark, sf_dir):
    g = X.grader_form(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(g).cast("long").alias("n_chars_graded"), _md5(g).alias("graded_md5"))


@query
def normalized_contains(spark, sf_dir):
    """Whether a page's html holds its own host's name, whatever the separators."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.holds(F.col("html"), host).alias("holds_host"), X.holds(F.col("url"), F.regexp_replace(host, r"\.", "-")).alias("holds_in_url"))


@query
def identifier_extract(spark, sf_dir):
    ids = F.array_sort(X.identifiers(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids).cast("long").alias("n_identifiers"), _md5(F.array_join(ids, ",")).alias("identifiers_md5"))


@query
def strip_unit(spark, sf_dir):
    units = F.element_at(F.array(*map(F.lit, ["", " V", "%", " ms", " seconds", "kHz", " GB", " boxes", "-B2", " degrees C"])), (F.col("p_partkey") % 10 + 1).cast("int"))
    raw = F.concat(F.col("p_size").cast("string"), units)
    return table(spark, sf_dir, "part").select("p_partkey", X.strip_unit(raw).alias("bare"))


@query
def clean_answer(spark, sf_dir):
    n = F.col("p_partkey") % 4
    raw = F.when(F.col("p_partkey") % 12 == 5, F.concat(F.lit("\n\t"), "p_size", F.lit(" V\n"))).when(n == 0, F.concat(F.lit('"Answer: '), "p_size", F.lit(' V". '))).when(n == 1, F.concat(F.lit("value = '"), "p_name", F.lit("'"))).when(n == 2, F.concat("p_brand", F.lit(".;\nmore"))).otherwise(F.concat(F.lit(" `"), "p_size", F.lit("%`")))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_answer(raw).alias("answer"))


@query
def citation_labels(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", X.citation_label(F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.col("role")), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(F.lit("")), F.col("conv_id").cast("string")).alias("label"))


@query
def reply_parse(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 7 == 0, F.lit("not json")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.reply(raw, "k long")["k"].alias("k"), X.reply(raw, "k long").isNull().alias("unparseable"))


# ---------------------------------------------------------------- files


def _files(spark, sf_dir) -> DataFrame:
    """Paths with revisions, made from the pages' ids and hosts."""
    p = F.col("page_id")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    tail = F.when(p % 7 == 0, F.lit("_WITHDRAWN")).otherwise(F.lit(""))
    rev = F.when(p % 17 == 0, F.concat(F.lit("_r20250101"), F.lpad(p.cast("string"), 8, "0"))).when(p % 3 == 0, F.concat(F.lit("_rev_"), F.element_at(F.array(*map(F.lit, "abcde")), (p % 5 + 1).cast("int")))).otherwise(F.concat(F.lit("_r"), (p % 5).cast("string")))
    suffix = F.element_at(F.array(*map(F.lit, [".pdf", ".docx", ".txt"])), (p % 3 + 1).cast("int"))
    path = F.concat(host, F.lit("/spec_"), (p % 40).cast("string"), F.when(p % 11 == 0, F.lit("")).otherwise(rev), tail, suffix)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), (p % 13 != 0).alias("indexed"))


@query
def family_revision(spark, sf_dir):
    files = corpus.with_revisions(_files(spark, sf_dir))
    return files.select("page_id", "path", "family", F.array_join(F.transform("revision", lambda x: x.cast("string")), ".").alias("revision"), "withdrawn")


@query
def superseded(spark, sf_dir):
    files = _files(spark, sf_dir).groupBy("path").agg(F.max("indexed").alias("indexed"))
    return corpus.mark_superseded(corpus.with_revisions(files)).select("path", "indexed", "superseded_by", "superseded")


@query
def walk_order(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", P.walk_key(path).alias("walk_key"), P.walked(path).alias("walked"))


@query
def folder_fingerprints(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.length("html").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    return corpus.folder_fingerprints(pages)


@query
def corpus_fingerprint(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.length("html").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    return corpus.corpus_fingerprint(pages)


@query
def detect_kind(spark, sf_dir):
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", P.kind_of(bare, F.encode("html", "UTF-8")).alias("kind"))


@query
def withdrawn_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.looks_withdrawn(F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("Do not use! ")).otherwise(F.lit("")), "text")).alias("withdrawn"))


@query
def row_segments(spark, sf_dir):
    out = None
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")):
        rows = table(spark, sf_dir, name)
        money = [c for c in rows.columns if c in ("p_retailprice", "c_acctbal", "s_acctbal")]
        rows = rows.withColumns({c: F.col(c).cast("decimal(18,2)") for c in money})
        part = corpus.row_segments(rows, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("row_key"), "segment")
        out = part if out is None else out.unionByName(part)
    return out


@query
def identifier_files_cap12(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    files = orders.select(F.concat(F.lit("cust/"), (F.col("o_custkey") % 500).cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"), F.lit(" CLK-"), (F.col("o_custkey") % 300).cast("string"), F.lit("-Q "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" KEY-"), (F.col("o_orderkey") % 50).cast("string")).alias("text"))
    return corpus.identifier_files(files).select("ident", F.array_join("files", ",").alias("files"), "n_files")


@query
def resolve_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    n = F.col("page_id") % 5
    raw = F.when(F.col("page_id") % 15 == 10, F.replace("p", F.lit("/"), F.lit("%2F"))).when(n == 0, F.concat(F.lit("/app/corpus/"), "p")).when(n == 1, F.upper("p")).when(n == 2, F.concat(F.lit("`"), "p", F.lit("`"))).when(n == 3, F.regexp_extract("p", "([^/]*)$", 1)).otherwise(F.concat(F.lit("missing/"), "p", F.lit(".x")))
    return verification.resolve_paths(pages.select(F.col("page_id").alias("query_id"), raw.alias("raw")), pages.select(F.col("p").alias("path")).distinct())


@query
def transcript_reuse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return corpus.reuse_transcripts(pages, pages.filter(F.col("path").cast("long") % 2 == 0).withColumn("text", F.when(F.col("path").cast("long") % 4 == 0, F.concat(F.lit("seen before: "), "text")).otherwise(F.lit(" "))))


# ---------------------------------------------------------------- chunks


def _markdown(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\n(The?|In|Of|[DEL][ae]s?) ", "\n\n## $1 heading\n").alias("text"))


@query
def section_split(spark, sf_dir):
    return chunking.split_sections(_markdown(spark, sf_dir)).select("doc_id", "section_no", "heading", F.length("body").cast("long").alias("n_chars"), _md5(F.col("body")).alias("body_md5"))


@query
def paragraph_chunks(spark, sf_dir):
    return chunking.chunk_documents(chunking.split_sections(_markdown(spark, sf_dir)))


@query
def line_chunks(spark, sf_dir):
    return chunking.chunk_lines(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("locator")))


# ---------------------------------------------------------------- index and retrieval


@query
def term_freq(spark, sf_dir):
    return retrieval.term_frequencies(chunks_of(spark, sf_dir))


@query
def doc_freq(spark, sf_dir):
    return retrieval.document_frequencies(retrieval.term_frequencies(chunks_of(spark, sf_dir)))


@query
def corpus_stats(spark, sf_dir):
    stats = retrieval.corpus_statistics(retrieval.lengths(chunks_of(spark, sf_dir)))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def kept_index(spark: SparkSession, sf_dir: str, kind: str = "plain") -> index.EvidenceIndex:
    """The documents' index, in the shared folder: built once, used again while the table's files are the same."""
    at = f"{sf_dir}/documents.parquet"
    root = f"{shared_dir(spark)}/kept-{kind}-{hashlib.md5(at.encode()).hexdigest()[:12]}"
    if kind == "plain":
        return index.load_or_build(spark, root, index.fingerprint_of(spark, at), lambda _: chunks_of(spark, sf_dir))
    named = lambda _: chunks_of(spark, sf_dir).select("chunk_id", "text", F.col("source").alias("path"), F.col("source").isin("src0", "src3", "src7").alias("superseded"))
    return index.load_or_build(spark, root, index.fingerprint_of(spark, at), named, tokenize=X.file_tokens, with_path=True)


@query
def bm25_batch(spark, sf_dir):
    found = kept_index(spark, sf_dir).search(questions(spark, sf_dir), 10)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def contract_search(spark, sf_dir):
    found = kept_index(spark, sf_dir, "files").files(questions(spark, sf_dir))
    return found.select("query_id", "rank", "chunk_id", "path", F.round("score", 6).alias("score"))


@query
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    found = retrieval.dense_top_k(v, v.filter(F.col("chunk_id") % 50 == 0).withColumnRenamed("chunk_id", "query_id"), 10)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def hash_embed_md5(spark, sf_dir):
    v = retrieval.trigram_vectors(questions(spark, sf_dir), "query_id", kind="md5")
    return v.select("query_id", F.posexplode("v").alias("bucket", "value")).filter("value != 0").select("query_id", "bucket", F.round("value", 6).alias("value"))


@query
def hybrid_search(spark, sf_dir):
    found = kept_index(spark, sf_dir).hybrid(few_questions(spark, sf_dir))
    return found.select("query_id", "fused_rank", "chunk_id", "lexical_rank", "dense_rank", "fused_score")


@query
def rerank_select(spark, sf_dir):
    chunks, asked = chunks_of(spark, sf_dir), few_questions(spark, sf_dir)
    found = kept_index(spark, sf_dir).hybrid(asked).join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.withColumnRenamed("text", "query_text"), "query_id")
    return retrieval.rerank_select(retrieval.jaccard_rerank(found)).select("query_id", "final_rank", "chunk_id", "rerank_score")


@query
def index_roundtrip(spark, sf_dir):
    """The whole index (chunks, postings with lengths, terms, manifest) built anew, read back and counted."""
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(chunks_of(spark, sf_dir), root, index.fingerprint_of(spark, f"{sf_dir}/documents.parquet"))
    return index.load(spark, root).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def index_summary(spark, sf_dir):
    return kept_index(spark, sf_dir, "files").summary()


@query
def ingest_replaces(spark, sf_dir):
    """Documents ingested, and every seventh once more with another text: postings of the replaced texts are gone."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text")
    index.ingest(spark, root, docs)
    again = docs.filter(F.col("document_id") % 7 == 0).withColumn("text", F.concat(F.lit("replaced "), F.regexp_replace("text", "[aeiou]", "")))
    found = index.ingest(spark, root, again)
    return found.terms.select("term", "df")


# ---------------------------------------------------------------- verification and evaluation


def _claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sentences of assistant turns as claims that cite the turn before, themselves, an unknown id or nothing."""
    t = table(spark, sf_dir, "conversations")
    key = lambda turn: F.concat_ws("::", F.col("conv_id").cast("string"), turn.cast("string"))
    chunks = t.groupBy("conv_id", "turn").agg(F.max("text").alias("text")).select(key(F.col("turn")).alias("chunk_id"), "text")
    said = t.filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    rows = said.select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("pos", "text"))
    n = (F.col("conv_id") + F.col("turn") + F.col("pos")) % 4
    cited = F.when(n == 0, F.array(key(F.col("turn") - 1), key(F.col("turn")))).when(n == 1, F.array(key(F.col("turn")))).when(n == 2, F.array(F.lit("none"))).otherwise(F.array(key(F.col("turn") - 1), F.lit("none")))
    cited = F.when(F.col("pos") % 9 == 8, F.array().cast("array<string>")).otherwise(cited)
    return rows.select(F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("pos").cast("string")).alias("claim_id"), F.col("conv_id").alias("query_id"), F.concat_ws("::", F.format_string("%08d", "turn"), F.format_string("%08d", "pos")).alias("claim_pos"), "text", cited.alias("cited")), chunks


@query
def claim_coverage(spark, sf_dir):
    covered = verification.claim_status(verification.claim_coverage(*_claims(spark, sf_dir)))
    return covered.select("claim_id", "n_cited", "n_resolved", "coverage_score", "supported", "best_chunk_id", "status")


@query
def supporting_quote(spark, sf_dir):
    quoted = verification.supporting_quote(verification.claim_coverage(*_claims(spark, sf_dir)))
    return quoted.filter("best_chunk_id IS NOT NULL").select("claim_id", "best_chunk_id", "quote")


@query
def answer_gate(spark, sf_dir):
    gated = verification.answer_gate(verification.claim_status(verification.claim_coverage(*_claims(spark, sf_dir))))
    return gated.select("query_id", "n_claims", "unsupported_ratio", "abstained", "faithfulness", "grounded_ratio", _md5(F.col("answer")).alias("answer_md5"))


def _mentions(spark, sf_dir) -> DataFrame:
    """Rendered parts, eight to a question, as retrieved texts of different sources."""
    parts = corpus.row_segments(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand"), "part")
    texts = parts.select(F.expr("p_partkey div 8").alias("query_id"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("source"), F.col("segment").alias("text"))
    found = verification.number_mentions(texts)
    return found.select("query_id", (F.col("place") * 1000 + F.col("pos")).alias("ord"), "source", "value", "ctx")


@query
def number_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select("query_id", "ord", "source", "value", F.array_join("ctx", " ").alias("ctx"))


@query
def conflicts(spark, sf_dir):
    return verification.find_conflicts(_mentions(spark, sf_dir)).select("query_id", "source_a", "value_a", "source_b", "value_b", "claim_text")


def _stock(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts by brand and stock lists that know them by part number only, as files; and every fiftieth part's name."""
    numbered = lambda p: F.concat(F.lit(p), F.col("p_partkey").cast("string"))
    parts = table(spark, sf_dir, "part").withColumns({"pn": numbered("PN-"), "slot": numbered("slot")})
    brand = F.concat(F.lit("parts/"), F.lower("p_brand"), F.lit("_r"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit(".csv"))
    named = parts.select((F.col("p_partkey") * 2).alias("chunk_id"), F.concat_ws(" ", "p_name", "p_type", "slot", "pn").alias("text"), brand.alias("path"))
    held = parts.select((F.col("p_partkey") * 2 + 1).alias("chunk_id"), F.concat_ws(" ", "pn", F.lit("retail price"), F.col("p_retailprice").cast("decimal(20,2)").cast("string")).alias("text"), F.concat(F.lit("stock/"), (F.col("p_partkey") % 97).cast("string"), F.lit(".txt")).alias("path"))
    chunks = named.unionByName(held).withColumn("superseded", F.contains(F.col("path"), F.lit("_r1.")))
    asked = parts.filter(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what is the retail price of "), F.col("p_name"), F.lit(" in "), F.col("slot")).alias("text"))
    return chunks, asked, parts


def _stock_index(spark, sf_dir) -> tuple[index.EvidenceIndex, DataFrame, DataFrame]:
    """The stock files' kept index, the questions and the parts."""
    chunks, asked, parts = _stock(spark, sf_dir)
    at = f"{sf_dir}/part.parquet"
    root = f"{shared_dir(spark)}/kept-stock-{hashlib.md5(at.encode()).hexdigest()[:12]}"
    docs = chunks.groupBy("path").agg(F.max("superseded").alias("superseded")).withColumn("indexed", F.lit(True))
    return index.load_or_build(spark, root, index.fingerprint_of(spark, at), lambda _: (chunks, docs), tokenize=X.file_tokens, with_path=True), asked, parts


@query
def identifier_expand(spark, sf_dir):
    kept, asked, _ = _stock_index(spark, sf_dir)
    return kept.expand(asked)


def _stock_answers(parts: DataFrame) -> tuple[F.Column, F.Column]:
    """Answers and sources of replies: the right price, a wrong one or none; the stock list and the brand's file."""
    price = F.col("p_retailprice").cast("decimal(20,2)").cast("string")
    answer = F.when(F.col("p_partkey") % 150 == 0, F.lit("0.01")).when(F.col("p_partkey") % 200 == 0, F.lit("")).otherwise(price)
    stock = F.concat(F.lit("/app/corpus/stock/"), (F.col("p_partkey") % 97).cast("string"), F.lit(".txt"))
    return answer, F.array(stock, F.concat(F.lit("parts/"), "p_brand", F.lit("_r"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit(".csv")))


@query
def verify_and_cite(spark, sf_dir):
    """Replies with the right price, a wrong one or none, citing the stock list and the brand's file."""
    kept, asked, parts = _stock_index(spark, sf_dir)
    found = materialize(kept.expand(asked), "found")
    hits = materialize(found.join(kept.texts_of(found).select("chunk_id", "text"), "chunk_id").select("query_id", "rank", "path", "text"), "hits")
    answer, sources = _stock_answers(parts)
    replies = parts.filter(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("query_id"), answer.alias("answer"), sources.alias("sources"))
    told = grounding.verify_and_cite(replies, asked, hits, kept.docs.select("path", "superseded"), kept.identifier_files().select("ident", "path"), kept.file_texts(hits))
    return told.withColumn("citations", F.array_join("citations", ","))


@query
def contract_answers(spark, sf_dir):
    """From questions and raw replies to outputs, by the engine over the kept stock files: replies with thoughts, without
    an object, that decline, with the right price, a wrong one or none."""
    kept, asked, parts = _stock_index(spark, sf_dir)
    answer, sources = _stock_answers(parts)
    k = F.col("p_partkey")
    told = F.to_json(F.struct(F.lit("r").alias("reasoning"), (k % 450 != 0).alias("answerable"), answer.alias("answer"), sources.alias("sources")))
    raw = F.when(k % 350 == 0, F.lit("I can't say.")).otherwise(F.concat(F.lit("<think>{}</think>\n```json\n"), told, F.lit("\n```")))
    replies = parts.filter(k % 50 == 0).select(k.alias("query_id"), raw.alias("raw"))
    return ContractEngine(spark, kept.root).answer(asked, replies).withColumn("citations", F.array_join("citations", ","))


def _cases(spark, sf_dir) -> DataFrame:
    """Labelled documents as cases: good ones expect their text's terms, others an abstention; the answer is the text
    without every so many of its words."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    some = F.filter(F.split("text", r"\s+"), lambda w, i: (i + F.col("doc_id")) % 3 != 0)
    few = F.filter(F.split("text", r"\s+"), lambda w, i: (i + F.col("doc_id")) % 3 == 0)
    return docs.join(labels, "doc_id").select(
        "doc_id", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("prompt_version"),
        F.col("text").alias("expected_answer"), F.array_join(F.when(F.col("doc_id") % 2 == 0, some).otherwise(few), " ").alias("answer"),
        (F.col("quality") == 0).alias("expects_abstain"), ((F.col("doc_id") % 5 == 0) | (F.col("toxic") == 1)).alias("abstained"),
        (F.col("doc_id") % 10 / 10).alias("faithfulness"), (F.col("doc_id") % 4 / 4).alias("grounded_ratio"), (F.col("n_chars") % 100).cast("double").alias("latency_ms"), F.col("n_chars").alias("tokens"),
    )


@query
def score_cases(spark, sf_dir):
    return evaluation.score_cases(_cases(spark, sf_dir)).select("doc_id", "prompt_version", "correct")


@query
def ablation_report(spark, sf_dir):
    return evaluation.ablation_report(evaluation.score_cases(_cases(spark, sf_dir)))


@query
def grading_points(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    answers = p.select("p_partkey", F.when(key % 3 == 0, F.lower("p_brand")).otherwise(F.regexp_replace("p_brand", "#", " - ")).alias("answer"), F.regexp_replace("p_brand", "#", "").alias("expected"), F.array(F.lit("a"), F.when(key % 2 == 0, F.lit("b")).otherwise(F.lit("a"))).alias("citations"), F.when(key % 4 < 2, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("expected_citations"))
    return evaluation.grade(answers).select("p_partkey", "points")


@query
def percentile_nearest_rank(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("key"), "value")
    return evaluation.nearest_rank(events, [0.5, 0.95, 0.99]).select(F.col("key").alias("event_type"), "share", "value")


@query
def cost_accounting(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    n = t.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", F.size(X.tokens(F.col("text")))).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("role") != "user", F.size(X.tokens(F.col("text")))).otherwise(0)).alias("completion_tokens"))
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return n.select("conv_id", "prompt_tokens", "completion_tokens", total.alias("total_tokens"), F.round(evaluation.cost_usd(total.cast("double")), 9).alias("cost_usd"))


@query
def outcome_counters(spark, sf_dir):
    claims = verification.claim_status(verification.claim_coverage(*_claims(spark, sf_dir)))
    return claims.groupBy("status").agg(F.count("*").alias("n_claims"))


@query
def service_context(spark, sf_dir):
    kept = kept_index(spark, sf_dir)
    found = materialize(kept.search(questions(spark, sf_dir), 3), "found")
    hits = found.join(kept.texts_of(found).select("chunk_id", "text", F.col("source").alias("label")), "chunk_id")
    return answering.format_context(hits).select("query_id", F.length("context").cast("long").alias("n_chars"), _md5(F.col("context")).alias("context_md5"))


@query
def file_prompts(spark, sf_dir):
    kept, asked = kept_index(spark, sf_dir, "files"), questions(spark, sf_dir)
    found = materialize(kept.files(asked).select("query_id", "rank", "chunk_id", "path"), "found")
    hits = found.join(kept.texts_of(found).select("chunk_id", "text"), "chunk_id").withColumn("locator", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("doc "), F.col("chunk_id").cast("string"))))
    files = kept.chunks.select("path", "superseded").distinct().withColumn("superseded_by", F.when(F.col("path") == "src3", F.lit("src4")))
    return answering.file_prompts(asked, hits, files).select("query_id", F.length("prompt").cast("long").alias("n_chars"), _md5(F.col("prompt")).alias("prompt_md5"))


@query
def reply_extract(spark, sf_dir):
    """Replies with thoughts, chatter, fences, broken objects before the right one, or none."""
    n, e = F.col("event_id"), F.col("props")
    raw = F.when(n % 5 == 0, F.concat(F.lit("<think>{\"k\": 0}</think>\nSure: "), e, F.lit(" done"))).when(n % 5 == 1, F.concat(F.lit("see {x} first\n```json\n"), e, F.lit("\n``` and {\"k\": 1}"))).when(n % 5 == 2, F.concat(F.lit("{broken "), e)).when(n % 5 == 3, F.lit("no object")).otherwise(e)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(answering.json_object(raw), "$.k").cast("long").alias("k"))


def _answers(spark, sf_dir) -> DataFrame:
    """A question a conversation, with a reply that holds the assistant's claims, declines, isn't JSON, or comes though
    nothing was retrieved."""
    claims, chunks = _claims(spark, sf_dir)
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    listed = claims.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_pos", "text", "cited"))), lambda x: F.struct(x["text"].alias("text"), x["cited"].alias("cited_chunk_ids"))).alias("claims"))
    q = F.col("query_id")
    whole = asked.join(listed, "query_id", "left").withColumn("json", F.to_json(F.struct(F.coalesce("claims", F.array().cast("array<struct<text:string,cited_chunk_ids:array<string>>>")).alias("claims"), (q % 7 == 2).alias("abstained"), F.when(q % 14 == 2, "not in the text").alias("abstain_reason"))))
    raw = F.when(q % 11 == 3, F.lit("I can't say.")).when(q % 5 == 1, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).otherwise(F.col("json"))
    return answering.service_outcomes(asked, asked.filter(q % 13 != 5), whole.select("query_id", raw.alias("raw")), chunks)


@query
def answer_outcomes(spark, sf_dir):
    found = _answers(spark, sf_dir)
    reason = F.when(F.col("outcome") == answering.DECLINED, F.col("warning"))
    return found.select("query_id", "outcome", "n_claims", "unsupported_ratio", "faithfulness", "grounded_ratio", _md5(F.col("answer")).alias("answer_md5"), reason.alias("said"))


@query
def outcome_counts(spark, sf_dir):
    return answering.outcome_counts(_answers(spark, sf_dir))


@query
def bench_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("value").alias("latency_ms"), (F.col("event_id") % 20 != 0).alias("ok"), (F.col("event_id") % 300).alias("tokens"))
    return evaluation.bench_summary(events, 50.0)


@query
def report_lines(spark, sf_dir):
    return evaluation.report_lines(evaluation.ablation_report(evaluation.score_cases(_cases(spark, sf_dir))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with reranking over the documents."""
    return QUERIES["rerank_select"](spark, sf_dir)
