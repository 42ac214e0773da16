"""Claim coverage, claim status, the abstention gate and numeric conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import content_terms, sentences


def claim_coverage(claims: DataFrame, chunks: DataFrame, threshold: float = 0.55) -> DataFrame:
    """For claims (claim_id, text, cited array<string>): the best cited chunk's share of the claim's terms.

    Adds n_cited, n_resolved, coverage_score, supported, best_chunk_id and best_text; ties go to the first cited.
    """
    cited = claims.select("claim_id", content_terms(F.col("text")).alias("terms"), F.posexplode("cited").alias("pos", "chunk_id"))
    met = cited.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    hits = F.size(F.array_intersect("terms", content_terms(F.col("chunk_text"))))
    share = F.coalesce(F.try_divide(hits, F.size("terms")), F.lit(0.0))
    best = met.withColumn("share", share).groupBy("claim_id").agg(
        F.count("*").alias("n_resolved"),
        F.max(F.struct(F.col("share"), (-F.col("pos")).alias("first"), "chunk_id", "chunk_text", F.size("terms").alias("n"))).alias("best"),
    )
    none = F.col("best").isNull() | (F.col("best.n") == 0)
    return claims.join(best, "claim_id", "left").select(
        *claims.columns,
        F.size("cited").cast("long").alias("n_cited"),
        F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"),
        F.when(none, F.lit(0.0)).otherwise(F.round("best.share", 4)).alias("coverage_score"),
        F.when(none, F.lit(False)).otherwise(F.col("best.share") >= threshold).alias("supported"),
        F.when(~none, F.col("best.chunk_id")).alias("best_chunk_id"),
        F.when(~none, F.col("best.chunk_text")).alias("best_text"),
    )


def supporting_quote(covered: DataFrame) -> DataFrame:
    """Adds quote: the best chunk's first sentence with most of the claim's terms; without one its first 200 characters."""
    terms = content_terms(F.col("text"))
    scored = F.transform(sentences(F.col("best_text")), lambda s, i: F.struct(F.size(F.array_intersect(terms, content_terms(s))).alias("n"), (-i).alias("first"), s.alias("s")))
    return covered.withColumn("quote", F.when(F.col("best_text").isNotNull(), F.coalesce(F.array_max(scored)["s"], F.substring("best_text", 1, 200))))


def claim_status(covered: DataFrame, requires_context: Column | None = None) -> DataFrame:
    """Adds status: ungrounded without context, uncited without ids, else supported or unsupported."""
    context = F.lit(True) if requires_context is None else requires_context
    status = F.when(~context, "ungrounded").when(F.col("n_cited") == 0, "uncited").when((F.col("n_resolved") > 0) & F.col("supported"), "supported").otherwise("unsupported")
    return covered.withColumn("status", status)


def answer_gate(claims: DataFrame, most_unsupported: float = 0.20, queries: DataFrame | None = None) -> DataFrame:
    """One row a query (query_id, claim_pos, text, status): shares, whether it abstains, and the answer. ``queries``
    (query_id) that have no claim get a row too, and abstain."""
    trusted = F.col("status").isin("supported", "ungrounded")
    ratio = F.count_if(F.col("status").isin("unsupported", "uncited")) / F.count("*")
    told = F.array_sort(F.collect_list(F.when(trusted, F.struct("claim_pos", "text"))))
    gated = (
        claims.groupBy("query_id")
        .agg(F.count("*").alias("n_claims"), F.round(ratio, 4).alias("unsupported_ratio"), (ratio > most_unsupported).alias("abstained"), F.round(1 - ratio, 4).alias("faithfulness"), F.round(F.count_if(F.col("status") == "supported") / F.count("*"), 4).alias("grounded_ratio"), told.alias("_told"))
        .withColumn("answer", F.when(F.col("abstained"), F.lit("")).otherwise(F.array_join(F.transform("_told", lambda x: x["text"]), " ")))
        .drop("_told")
    )
    if queries is None:
        return gated
    # Without claims nothing is unsupported, but nothing can be told either.
    none = {"n_claims": 0, "unsupported_ratio": 1.0, "abstained": True, "faithfulness": 1.0, "grounded_ratio": 0.0, "answer": ""}
    return queries.select("query_id").distinct().join(gated, "query_id", "left").fillna(none)


def number_mentions(texts: DataFrame) -> DataFrame:
    """Adds value and ctx for each one to four digit number: the distinct longer words within six places of it."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    plain = texts.withColumn("_w", F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", ""))))
    placed = plain.select(*texts.columns, "_w", F.posexplode("_w").alias("pos", "value")).filter(F.col("value").rlike("^[0-9]{1,4}$"))
    left = F.slice("_w", F.greatest(F.lit(1), F.col("pos") - 5), F.least(F.lit(6), F.col("pos")))
    near = F.filter(F.concat(left, F.slice("_w", F.col("pos") + 2, F.lit(6))), lambda w: F.length(w) > 2)
    return placed.withColumn("ctx", F.array_distinct(near)).drop("_w")


def meeting_mentions(mentions: DataFrame, least_shared: int = 2) -> DataFrame:
    """Mentions of one query that may share ``least_shared`` words of their contexts, side by side.

    Mentions with the same source, value and context are one, the first. A context's words are put in order of how many
    contexts of the query hold them; two contexts that share as many words as are asked for share one that isn't among
    the last of either, so mentions meet on the others only. A word that is in every context brings nothing together.
    What mentions are spread out to is many times what Spark guesses from the size of their table, so both joins say that
    they are merged: by that guess it would send all of it through the driver.
    """
    words = F.array_sort(F.array_distinct("ctx"))
    alike = mentions.groupBy("query_id", "source", "value", words.alias("ctx")).agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    named = alike.select("query_id", "ord", "source", "value", "n", F.explode("ctx").alias("word"))
    held = named.groupBy("query_id", "word").agg(F.count("*").alias("held"))
    ranked = named.join(held.hint("merge"), ["query_id", "word"]).groupBy("query_id", "ord", "source", "value", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "word"))), lambda x: x["word"]).alias("words"))
    first_words = F.explode(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.size("words") - (least_shared - 1))))
    side = lambda p: ranked.select("query_id", first_words.alias("word"), *(F.col(c).alias(f"{c}_{p}") for c in ("ord", "source", "value", "n", "words")))
    return side("a").join(side("b").hint("merge"), ["query_id", "word"]).filter((F.col("ord_a") < F.col("ord_b")) & (F.col("source_a") != F.col("source_b")) & (F.col("value_a") != F.col("value_b")))


def find_conflicts(mentions: DataFrame, least_shared: int = 2) -> DataFrame:
    """Pairs of mentions of one query whose sources and values differ and whose contexts share enough words.

    mentions: query_id, ord (the mention's place), source, value, ctx; n_mentions is how many are alike on both sides
    together. The first pair of each unordered couple of source and value stays.
    """
    # A pair that meets on several words counts where it shares the first.
    shared = meeting_mentions(mentions, least_shared).withColumn("shared", F.array_intersect("words_a", "words_b")).filter((F.size("shared") >= least_shared) & (F.get("shared", F.lit(0)) == F.col("word")))
    pairs = shared.select("query_id", "ord_a", "ord_b", "source_a", "value_a", "source_b", "value_b", F.array_join(F.array_sort("shared"), " / ").alias("claim_text"), F.size("shared").alias("n_shared"), (F.col("n_a") + F.col("n_b")).alias("n_mentions"))
    a, b = F.concat_ws(":", "source_a", "value_a"), F.concat_ws(":", "source_b", "value_b")
    first = Window.partitionBy("query_id", F.least(a, b), F.greatest(a, b)).orderBy("ord_a", "ord_b")
    return pairs.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def resolve_paths(cited: DataFrame, files: DataFrame) -> DataFrame:
    """Real paths for written ones (query_id, raw): exact, else without case, else by a unique name. Percent escapes are
    decoded first (a plus is no space); a path with broken ones stays as it is."""
    plain = F.coalesce(F.try_url_decode(F.replace("raw", F.lit("+"), F.lit("%2B"))), F.col("raw"))
    bare = F.regexp_replace(F.replace(F.regexp_replace(F.trim(plain), "^[`'\" ]+|[`'\" ]+$", ""), F.lit("\\"), F.lit("/")), r"^(?:/?app/)?(?:corpus/)?(?:\./)?", "")
    asked = cited.withColumn("_c", F.regexp_replace(bare, "^/+", ""))
    name = lambda c: F.lower(F.regexp_extract(c, r"([^/]*)$", 1))
    exact = files.select(F.col("path").alias("_c"), F.col("path").alias("_exact")).distinct()
    lowered = files.groupBy(F.lower("path").alias("_low")).agg(F.max("path").alias("_lowered"))
    unique = files.groupBy(name(F.col("path")).alias("_name")).agg(F.min("path").alias("_named"), F.count("*").alias("_k")).filter("_k = 1").drop("_k")
    found = asked.withColumn("_low", F.lower("_c")).withColumn("_name", name(F.col("_c"))).join(exact, "_c", "left").join(lowered, "_low", "left").join(unique, "_name", "left")
    return found.select(*cited.columns, F.coalesce("_exact", "_lowered", "_named").alias("path"))
