"""From retrieved chunks and model replies to answers: contexts, prompts, reply parsing, gates, outputs.

Replies are a table (query_id, raw): the model's text for each question. Nothing here calls a model.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import reply
from plumbline.operators import grounding, verification
from plumbline.session import materialize

#: What a reply holds: claims with the chunks they cite, and, over files, one value with its sources.
CLAIMS_REPLY = "claims array<struct<text:string,cited_chunk_ids:array<string>>>, abstained boolean, abstain_reason string"
FILE_REPLY = "reasoning string, answerable boolean, answer string, sources array<string>"

# Why a question isn't answered.
NO_RESULTS, UNPARSEABLE, DECLINED, UNSUPPORTED, ANSWERED = "no_retrieval_results", "unparseable_generation", "model_abstained", "unsupported_ratio_exceeded", "answered"


class EmptyCorpus(ValueError):
    """Nothing has been ingested that a question could be asked of."""


@dataclass(frozen=True)
class Prompt:
    """A way of asking: its name, what the model is told, and what it gets and has to give."""

    version: str
    summary: str
    system: str
    requires_context: bool
    requires_citations: bool


PROMPTS = {
    p.version: p
    for p in (
        Prompt("no-retrieval", "The question alone.", "Answer briefly in JSON with claims, abstained and abstain_reason.", False, False),
        Prompt("naive", "Chunks are given, citations aren't asked for.", "Answer from the chunks, in JSON with claims, abstained and abstain_reason.", True, False),
        Prompt("cited", "Every claim names the chunks that it rests on.", "Answer from the chunks only. Each claim lists the ids of the chunks that state it. Abstain where they don't.", True, True),
    )
}
DEFAULT_PROMPT = "cited"


def prompt_of(version: str | None = None) -> Prompt:
    """The prompt of a version, or the default one; KeyError for an unknown version."""
    if (version or DEFAULT_PROMPT) not in PROMPTS:
        raise KeyError(f"no prompt {version!r}; there are {', '.join(sorted(PROMPTS))}")
    return PROMPTS[version or DEFAULT_PROMPT]


def user_turn(prompt: Prompt, question: Column, context: Column) -> Column:
    if prompt.requires_context:
        return F.concat(F.lit("Chunks, each with its id:\n\n"), context, F.lit("\n\nQuestion: "), question)
    return F.concat(F.lit("Question: "), question)


def format_context(hits: DataFrame) -> DataFrame:
    """query_id and context: ``[id] (label)`` and the text of each hit (query_id, rank, chunk_id, label, text), in order
    of rank. A question's hits are a handful."""
    block = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] ("), F.coalesce("label", F.lit("")), F.lit(")\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"))


def file_prompts(questions: DataFrame, hits: DataFrame, files: DataFrame) -> DataFrame:
    """query_id and prompt: excerpts by file, the file of the best hit first, each file marked current or superseded.

    hits: query_id, rank, path, locator, text; files: path, superseded, superseded_by.
    """
    status = F.when(F.col("superseded"), F.concat(F.lit("superseded"), F.coalesce(F.concat(F.lit(" by "), "superseded_by"), F.lit("")))).otherwise(F.lit("current"))
    where = F.when(F.coalesce("locator", F.lit("")) != "", F.concat(F.lit(" ("), "locator", F.lit(")"))).otherwise(F.lit(""))
    part = F.concat(F.lit("--"), where, F.lit("\n"), "text")
    by_file = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    headed = by_file.join(files.select("path", status.alias("status")), "path", "left")
    head = F.concat(F.lit("[FILE "), "path", F.lit(" | "), F.coalesce("status", F.lit("current")), F.lit("]"))
    block = F.concat_ws("\n", head, F.array_join(F.transform("parts", lambda x: x["part"]), "\n"))
    joined = headed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", block.alias("block")))).alias("blocks"))
    told = F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n")
    return joined.join(questions.select("query_id", F.col("text").alias("question")), "query_id").select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nExcerpts:\n\n"), told).alias("prompt"))


# How a model's thoughts and its fences are written.
_THOUGHT = re.compile(r"<think>.*?</think>", re.DOTALL)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def first_object(text: str | None) -> str | None:
    """The first JSON object in a model's text, past its thoughts and inside its first fence, as JSON."""
    bare = _THOUGHT.sub("", text or "").strip()
    if fenced := _FENCE.search(bare):
        bare = fenced[1].strip()
    decoder, at = json.JSONDecoder(), bare.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(bare, at)[0], ensure_ascii=False)
        except (json.JSONDecodeError, RecursionError):
            at = bare.find("{", at + 1)
    return None


def _objects(raw: pd.Series) -> pd.Series:
    return raw.map(first_object)


def json_object(raw: Column) -> Column:
    """``first_object`` of a column, in Arrow batches."""
    return F.pandas_udf(_objects, "string")(raw)


def service_outcomes(questions: DataFrame, hits: DataFrame, replies: DataFrame, chunks: DataFrame, *, version: str | None = None, most_unsupported: float = 0.20, empty: bool | None = None) -> DataFrame:
    """query_id, outcome, answer, n_claims, unsupported_ratio, faithfulness, grounded_ratio and warning.

    A question without hits, with a reply that is no JSON object, that declines, or whose claims fail too often, has
    no answer and says why. hits: query_id (at least a row for each question with results); chunks: chunk_id, text, of which those that
    claims name will do if ``empty`` says whether there are any at all.
    """
    prompt = prompt_of(version)
    if prompt.requires_context and (chunks.isEmpty() if empty is None else empty):
        raise EmptyCorpus("no chunks to ask questions of")
    parsed = questions.select("query_id").distinct().join(replies.select("query_id", reply(F.col("raw"), CLAIMS_REPLY).alias("r")), "query_id", "left")
    if prompt.requires_context:
        parsed = parsed.join(hits.select("query_id").distinct().withColumn("_found", F.lit(True)), "query_id", "left")
    else:
        parsed = parsed.withColumn("_found", F.lit(True))
    early = F.when(F.col("_found").isNull(), NO_RESULTS).when(F.col("r").isNull(), UNPARSEABLE).when(F.coalesce("r.abstained", F.lit(False)), DECLINED)
    parsed = materialize(parsed.withColumn("early", early), "parsed")
    open_ = parsed.filter("early IS NULL")
    rows = open_.select("query_id", F.posexplode("r.claims").alias("claim_pos", "c")).select(
        F.concat_ws("::", F.col("query_id").cast("string"), F.col("claim_pos").cast("string")).alias("claim_id"), "query_id", "claim_pos",
        F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.cited_chunk_ids", F.array().cast("array<string>")).alias("cited"),
    )
    stated = verification.claim_status(verification.claim_coverage(rows, chunks), F.lit(prompt.requires_context))
    gated = verification.answer_gate(stated, most_unsupported, open_)
    told = parsed.select("query_id", "early", F.col("r.abstain_reason").alias("said")).join(gated, "query_id", "left")
    outcome = F.coalesce("early", F.when(F.col("abstained"), UNSUPPORTED).otherwise(ANSWERED))
    warning = F.when(F.col("outcome") == NO_RESULTS, "nothing was retrieved").when(F.col("outcome") == UNPARSEABLE, "the reply is no JSON object").when(F.col("outcome") == DECLINED, F.coalesce(F.nullif("said", F.lit("")), F.lit("the model declined"))).when(
        F.col("outcome") == UNSUPPORTED, F.concat(F.round(100 * F.col("unsupported_ratio")).cast("long").cast("string"), F.lit(" % of the claims failed"))
    )
    return told.withColumn("outcome", outcome).select(
        "query_id", "outcome", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "unsupported_ratio", "faithfulness", "grounded_ratio", warning.alias("warning"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counters: questions by outcome, and abstentions by reason."""
    by = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    return by.select(F.lit("queries").alias("counter"), F.when(F.col("outcome") == ANSWERED, ANSWERED).otherwise("abstained").alias("label"), "n").groupBy("counter", "label").agg(F.sum("n").alias("n")).unionByName(
        by.filter(F.col("outcome") != ANSWERED).select(F.lit("abstentions").alias("counter"), F.col("outcome").alias("label"), "n")
    )


def to_output(found: DataFrame) -> DataFrame:
    """All or nothing: without an answer or a citation everything is empty; confidence is cut to 0..1 and rounded."""
    whole = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce(F.size("citations"), F.lit(0)) > 0)
    return found.withColumns({
        "answer": F.when(whole, F.col("answer")).otherwise(""), "citations": F.when(whole, F.col("citations")).otherwise(F.array().cast("array<string>")),
        "confidence": F.when(whole, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")), 3)).otherwise(0.0),
    })


def file_outcomes(questions: DataFrame, hits: DataFrame, replies: DataFrame, files: DataFrame, ident_files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """query_id, answer, citations, confidence and reason for every question: without hits, without a usable reply, or
    with one that says it can't be answered, an empty refusal; else what holds in the files it cites."""
    parsed = replies.select("query_id", F.from_json(json_object(F.col("raw")), FILE_REPLY).alias("r"))
    asked = questions.select("query_id").distinct().join(hits.select("query_id").distinct().withColumn("_found", F.lit(True)), "query_id", "left").join(parsed, "query_id", "left")
    blank = F.coalesce(F.regexp_replace("r.answer", r"\s", ""), F.lit("")) == ""
    early = F.when(F.col("_found").isNull(), "nothing retrieved").when(F.col("r").isNull(), "no usable reply").when(~F.coalesce("r.answerable", F.lit(False)) | blank, "not answerable")
    asked = materialize(asked.withColumn("early", early), "asked")
    usable = asked.filter("early IS NULL").select("query_id", F.col("r.answer").alias("answer"), F.coalesce("r.sources", F.array().cast("array<string>")).alias("sources"))
    verified = to_output(grounding.verify_and_cite(usable, questions, hits, files, ident_files, texts))
    refused = asked.filter("early IS NOT NULL").select("query_id", F.lit("").alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit(0.0).alias("confidence"), F.col("early").alias("reason"))
    return verified.unionByName(refused)


def output_name(query_id: Column) -> Column:
    """A question's file name: its id without characters that paths can't hold."""
    safe = F.regexp_replace(query_id.cast("string"), "[^A-Za-z0-9._-]", "_")
    return F.concat(F.when(F.coalesce(safe, F.lit("")) == "", "query").otherwise(safe), F.lit("_output"))


def write_outputs(outputs: DataFrame, folder: str) -> None:
    """One JSON file a question, below ``name=<id>_output``; written by Spark's commit, so never half of one. Questions
    that are answered again are replaced, others' answers stay. Of ids of one batch that look the same in a path, the
    one that needs no change, else the first, keeps the name, and the others' get their hash."""
    raw = F.coalesce(F.col("query_id").cast("string"), F.lit(""))
    named = outputs.withColumns({"_id": raw, "name": output_name(F.col("query_id"))})
    changed = F.concat("_id", F.lit("_output")) != F.col("name")
    first = F.dense_rank().over(Window.partitionBy("name").orderBy(changed, "_id")) == 1
    told = F.when(first, F.col("name")).otherwise(F.concat(F.regexp_replace("name", "_output$", ""), F.lit("-"), F.substring(F.md5(F.col("_id").cast("binary")), 1, 8), F.lit("_output")))
    named = named.withColumn("_told", told).select(F.col("_told").alias("name"), "answer", "citations", "confidence")
    named.repartition("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").json(folder)
