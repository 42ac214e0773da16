"""File mode beyond one search: a second hop over identifiers, and the grounding of answers in exact files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import clean_answer, file_terms, file_tokens, grader_form, holds, identifiers
from plumbline.operators.retrieval import file_search
from plumbline.operators.verification import resolve_paths
from plumbline.session import materialize


#: Values that are looked for one by one, at most; characters by which more are found; links that are tried first.
ONE_BY_ONE, HEAD, FIRST_LINKS = 4, 32, 8

# Why an answer is or isn't given.
NO_ANSWER, NOT_FOUND, ECHO, GROUNDED = "empty answer", "answer not found in any retrieved file", "answer only echoes the question", "grounded"


def expand_with_identifiers(chunks: DataFrame, queries: DataFrame, ident_files: DataFrame, *, k: int = 10, looked_at: int = 5, most: int = 6, tokenize: Callable[[Column], Column] = file_tokens) -> DataFrame:
    """query_id, chunk_id, path, hop (1 or 2) and rank: the first hits, then what the rarest identifiers of the first
    few bring that the question doesn't hold; at most k + 6 of both.

    ident_files: ident, n_files, of identifiers that link few files. The choice is made for each query inside the plan.
    """
    first = materialize(file_search(chunks, queries, tokenize, k=k).select("query_id", "chunk_id", "path", "rank"), "hits")  # read three times
    asked = queries.select("query_id", grader_form(F.col("text")).alias("asked"), F.col("text").alias("question"))
    seen = first.filter(F.col("rank") <= looked_at).join(chunks.select("chunk_id", "text"), "chunk_id")
    named = seen.select("query_id", F.explode(identifiers(F.col("text"))).alias("ident")).distinct().join(asked, "query_id").filter(~F.contains(F.col("asked"), F.col("ident")))
    rare = named.join(ident_files.select("ident", "n_files"), "ident").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("n_files", "ident"))).filter(F.col("_n") <= most)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "ident"))), lambda x: x["ident"]), " ")
    again = rare.groupBy("query_id").agg(words.alias("w"), F.first("question").alias("q")).select("query_id", F.concat_ws(" ", "w", "q").alias("text"))
    second = file_search(chunks, again, tokenize, k=k).select("query_id", "chunk_id", "path", "rank").join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "rank"))
    return both.withColumn("rank", place).filter(F.col("rank") <= k + 6)


def held_values(text: str, values: list[str]) -> list[str]:
    """Those of the values that the text holds: many of them in one pass over the text for each length."""
    if len(values) <= ONE_BY_ONE:
        return [v for v in values if v in text]
    found, by_length = set(), {}
    for v in values:
        by_length.setdefault(min(len(v), HEAD), {}).setdefault(v[:HEAD], set()).add(v)
    for n, heads in by_length.items():
        for i in range(len(text) - n + 1):
            if left := heads.get(text[i : i + n]):
                got = {v for v in left if text.startswith(v, i)}
                left -= got
                found |= got
    return [v for v in values if v in found]


def values_in_files(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of wanted (path, graded) whose value is in the grader form of the file's text (path, text). A file is gone
    over once, whatever many questions ask of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "text", "values"))
            pairs = [(path, v) for path, text, values in zip(*columns, strict=True) for v in held_values(text, values)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)], names=["path", "graded"])

    asked = wanted.filter("graded <> ''").groupBy("path").agg(F.collect_set("graded").alias("values"))
    return texts.select("path", grader_form(F.col("text")).alias("text")).filter("text IS NOT NULL").join(asked, "path").select("path", "text", "values").mapInArrow(run, "path string, graded string")


def linked(cited: DataFrame, value: DataFrame, asked: DataFrame, ident_files: DataFrame) -> DataFrame:
    """query_id and path of cited files (query_id, path) that share an identifier, which the question (query_id, asked)
    doesn't hold, with one of the question's files of the value (query_id, path). Identifiers that two files share are
    listed once for all questions; the first few of them decide, and the others where the question holds all these."""
    met = cited.select("query_id", "path").join(value.select("query_id", F.col("path").alias("by")), "query_id")
    idents = materialize(ident_files.select("path", "ident").join(met.select("path").union(met.select("by")).distinct(), "path", "left_semi"), "idents")
    both = materialize(idents.withColumnRenamed("path", "by").join(idents, "ident").join(met.select("by", "path").distinct(), ["by", "path"]).select("by", "path", "ident"), "both")
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("by", "path").orderBy("ident"))).filter(F.col("_n") <= FIRST_LINKS)
    tried = met.join(first.groupBy("by", "path").agg(F.collect_list("ident").alias("idents")), ["by", "path"]).join(asked, "query_id")
    tried = materialize(tried.withColumn("_linked", F.exists("idents", lambda x: ~F.contains(F.col("asked"), x))), "tried")
    rest = tried.filter(~F.col("_linked") & (F.size("idents") == FIRST_LINKS)).join(both, ["by", "path"]).filter(~F.contains(F.col("asked"), F.col("ident")))
    return tried.filter("_linked").select("query_id", "path").union(rest.select("query_id", "path")).distinct()


def verify_and_cite(replies: DataFrame, questions: DataFrame, hits: DataFrame, files: DataFrame, ident_files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """query_id, answer, citations, confidence and reason for each reply (query_id, answer, sources array<string>).

    questions: query_id, text. hits: query_id, rank, path, text of the excerpts shown. files: path, text, superseded,
    all of them indexed. ident_files: ident, path (a row for each file). texts: path and text of the files that hits
    are of; then files need no text, and no other file's is read.
    """
    asked = replies.select("query_id", clean_answer(F.coalesce("answer", F.lit(""))).alias("answer"), "sources").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    asked = asked.withColumn("terms", file_terms(F.col("question"))).withColumn("need", F.when(F.size("terms") <= 3, 1).otherwise(2))
    valued = asked.filter("answer <> ''").select("query_id", "answer", "terms", "need")

    def supported(texts: DataFrame) -> DataFrame:
        fits = holds(F.col("text"), F.col("answer")) & (F.size(F.array_intersect("terms", file_terms(F.col("text")))) >= F.col("need"))
        return texts.join(valued, "query_id").filter(fits).groupBy("query_id", "path").agg(F.min("rank").alias("rank"))

    shown = supported(hits.select("query_id", "path", "rank", "text")).withColumn("shown", F.lit(True))
    shown = materialize(shown, "shown")
    retrieved = hits.groupBy("query_id", "path").agg(F.min("rank").alias("rank")).join(shown.select("query_id").distinct(), "query_id", "left_anti")
    retrieved = materialize(retrieved.join(valued, "query_id").withColumn("graded", grader_form(F.col("answer"))), "retrieved")
    texts = materialize((files if texts is None else texts).select("path", "text").join(retrieved.select("path").distinct(), "path", "left_semi"), "texts")
    # A file's terms and values are worked out once, for all questions.
    terms = retrieved.select("query_id", "path", F.explode("terms").alias("term")).distinct()
    stated = texts.select("path", F.explode(file_tokens(F.col("text"))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi").distinct()
    enough = terms.join(stated, ["path", "term"]).groupBy("query_id", "path").agg(F.count("*").alias("n"))
    inside = values_in_files(retrieved.select("path", "graded"), texts)
    whole = retrieved.join(inside, ["path", "graded"]).join(enough, ["query_id", "path"], "left").filter(F.coalesce("n", F.lit(0)) >= F.col("need"))
    whole = whole.groupBy("query_id", "path").agg(F.min("rank").alias("rank")).withColumn("shown", F.lit(False))
    support = materialize(shown.unionByName(whole), "support")

    written = asked.select("query_id", F.posexplode("sources").alias("pos", "raw"))
    cited = resolve_paths(written, files).filter(F.col("path").isNotNull()).groupBy("query_id", "path").agg(F.min("pos").alias("pos"))
    status = files.select("path", "superseded")
    w = Window.partitionBy("query_id")
    # Cited files that hold the value; without any the first that holds it; current ones before superseded ones.
    held = support.join(cited, ["query_id", "path"], "left").join(status, "path")
    held = held.withColumn("_any", F.max(F.col("pos").isNotNull()).over(w)).withColumn("_first", F.min("rank").over(w))
    value = held.filter(F.when(F.col("_any"), F.col("pos").isNotNull()).otherwise(F.col("rank") == F.col("_first")))
    value = value.withColumn("_one", F.row_number().over(w.orderBy("rank", "path"))).filter(F.col("_any") | (F.col("_one") == 1))
    value = value.withColumn("_current", F.max(~F.col("superseded")).over(w)).filter(~F.col("_current") | ~F.col("superseded"))
    value = materialize(value.select("query_id", "path", F.coalesce("pos", F.lit(0)).alias("pos"), "superseded", "shown"), "value")

    others = materialize(cited.join(value.select("query_id", "path"), ["query_id", "path"], "left_anti").join(status, "path").filter(~F.col("superseded")), "others")
    keys = linked(others, value, asked.select("query_id", grader_form(F.col("question")).alias("asked")), ident_files)
    links = others.join(keys, ["query_id", "path"], "left_semi").select("query_id", "path", "pos", "superseded").distinct()
    parts = value.withColumn("part", F.lit(0)).unionByName(links.withColumn("part", F.lit(1)).withColumn("shown", F.lit(None).cast("boolean")))
    grounds = parts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "path"))), lambda x: x["path"]).alias("citations"), F.max("superseded").alias("old"), F.max("shown").alias("shown"))

    out = asked.join(grounds, "query_id", "left")
    reason = (
        F.when(F.col("answer") == "", NO_ANSWER)
        .when(F.col("citations").isNull(), NOT_FOUND)
        .when(~F.col("shown") & holds(F.col("question"), F.col("answer")), ECHO)
        .otherwise(GROUNDED)
    )
    fine = F.col("reason") == GROUNDED
    score = F.when(F.col("shown"), 0.9).otherwise(0.7) - F.when(F.col("old"), 0.2).otherwise(0.0)
    return out.withColumn("reason", reason).select("query_id", F.when(fine, F.col("answer")).otherwise("").alias("answer"), F.when(fine, F.col("citations")).otherwise(F.array().cast("array<string>")).alias("citations"), F.when(fine, F.round(score, 3)).otherwise(0.0).alias("confidence"), "reason")
