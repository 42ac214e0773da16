"""Evaluation: case scores, ablation reports, grading, percentiles, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import content_terms, grader_form


def score_cases(cases: DataFrame, recall: float = 0.6) -> DataFrame:
    """Adds correct for cases (answer, expected_answer, expects_abstain, abstained)."""
    expected = content_terms(F.coalesce(F.col("expected_answer"), F.lit("")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(expected, content_terms(F.coalesce(F.col("answer"), F.lit(""))))), F.size(expected)), F.lit(0.0))
    return cases.withColumn("correct", F.when(F.col("expects_abstain"), F.col("abstained")).when(F.col("abstained"), F.lit(False)).otherwise(share >= recall))


def ablation_report(outcomes: DataFrame) -> DataFrame:
    """One row a prompt version: accuracy, answered-only means, abstention recall and precision, latency, tokens."""
    rate = lambda a, b, default, digits=4: F.round(F.coalesce(F.try_divide(a, b), F.lit(default)), digits)
    ab, ex = F.col("abstained"), F.col("expects_abstain")
    answered = lambda c: F.avg(F.when(~ab, F.col(c)))
    return outcomes.groupBy("prompt_version").agg(
        F.count("*").alias("n_cases"),
        rate(F.count_if("correct"), F.count("*"), 0.0).alias("accuracy"),
        F.round(F.coalesce(answered("faithfulness"), F.lit(1.0)), 4).alias("mean_faithfulness"),
        F.round(F.coalesce(answered("grounded_ratio"), F.lit(0.0)), 4).alias("mean_grounded_ratio"),
        rate(F.count_if(ab & ex), F.count_if(ex), 1.0).alias("abstention_recall"),
        rate(F.count_if(ab & ex), F.count_if(ab), 1.0).alias("abstention_precision"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"),
        F.sum("tokens").alias("total_tokens"),
    )


def grade(answers: DataFrame, points: int = 20) -> DataFrame:
    """Adds points: all if the graded forms and the citation sets are equal, else none."""
    same = (grader_form(F.col("answer")) == grader_form(F.col("expected"))) & (F.array_sort(F.array_distinct("citations")) == F.array_sort(F.array_distinct("expected_citations")))
    return answers.withColumn("points", F.when(same, points).otherwise(0).cast("long"))


def nearest_rank(values: DataFrame, shares: list[float], cells: int = 4096) -> DataFrame:
    """key, share and the value at place round(share * (n - 1)), half to even, of each key's sorted values (key, value).

    Values fall into ``cells`` even cells of their key's range; counts of cells tell in which one a place lies, so
    only that cell's distinct values are sorted and no key is gathered in one task.
    """
    ranges = values.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(cells - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells))).otherwise(F.lit(0))
    counted = values.groupBy("key", "value").agg(F.count("*").alias("c")).join(ranges, "key").withColumn("cell", place)
    totals = counted.groupBy("key", "cell").agg(F.sum("c").alias("k"))
    before = totals.withColumn("before", F.sum("k").over(Window.partitionBy("key").orderBy("cell")) - F.col("k"))
    asked = ranges.select("key", "n", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.expr("bround(share * (n - 1))").cast("long"))
    spot = asked.join(before, "key").filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("k"))).select("key", "share", "at", "cell", "before")
    inside = counted.join(spot, ["key", "cell"]).withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy("key", "share", "cell").orderBy("value")))
    return inside.filter((F.col("at") < F.col("end")) & (F.col("at") >= F.col("end") - F.col("c"))).select("key", "share", "value")


def cost_usd(tokens: Column, per_hour: float = 1.99, per_second: float = 900.0) -> Column:
    """What generating the tokens costs at an hourly rate and a throughput; 0 where there is no throughput."""
    return tokens / per_second * (per_hour / 3600.0) if per_second > 0 else F.lit(0.0)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """number (from 1) and line of a question file, without blank lines; such a file is small and read as one text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).select((F.col("n") + 1).alias("number"), "line").filter(F.col("line").rlike(r"\S"))


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Cases (id, query, expected_answer, expects_abstain) of a JSONL file; ValueError with the line's number for a line
    that is no case, and for a file without any."""
    parsed = _lines(spark, path).withColumn("c", F.from_json("line", "id string, query string, expected_answer string, expects_abstain boolean"))
    bad = parsed.filter(F.col("c").isNull() | F.col("c.id").isNull() | F.col("c.query").isNull()).agg(F.min("number")).head()[0]
    if bad is not None:
        raise ValueError(f"{path}:{bad} is not a usable case")
    if parsed.isEmpty():
        raise ValueError(f"{path} holds no cases")
    return parsed.select("c.id", "c.query", "c.expected_answer", F.coalesce("c.expects_abstain", F.lit(False)).alias("expects_abstain"))


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """question, answer and citations of a JSON array, an object with ``questions``, or JSON lines; either name of each."""
    row = "question string, query string, answer string, expected_answer string, citations array<string>, expected_citations array<string>"
    rows = "array<struct<question:string,query:string,answer:string,expected_answer:string,citations:array<string>,expected_citations:array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("v"))
    listed = whole.filter(F.startswith("v", F.lit("["))).select(F.explode(F.from_json("v", rows)).alias("r"))
    inside = whole.filter(F.startswith("v", F.lit("{")) & F.get_json_object("v", "$.questions").isNotNull())
    inside = inside.select(F.explode(F.from_json(F.get_json_object("v", "$.questions"), rows)).alias("r"))
    single = whole.filter(~F.startswith("v", F.lit("[")) & F.get_json_object("v", "$.questions").isNull()).select(F.explode(F.split("v", r"\r?\n")).alias("line")).filter(F.col("line").rlike(r"\S")).select(F.from_json("line", row).alias("r"))
    none = F.array().cast("array<string>")
    return listed.unionByName(inside).unionByName(single).select(
        F.coalesce(F.nullif("r.question", F.lit("")), "r.query", F.lit("")).alias("question"), F.coalesce("r.answer", "r.expected_answer", F.lit("")).alias("answer"), F.coalesce("r.citations", "r.expected_citations", none).alias("citations")
    )


def bench_summary(requests: DataFrame, wall_seconds: float) -> DataFrame:
    """One row over requests (latency_ms, ok, tokens): nearest-rank percentiles and mean of what went well, throughput,
    tokens a second, error rate and the cost of a thousand questions."""
    fine = requests.filter("ok")
    p = nearest_rank(fine.select(F.lit("all").alias("key"), F.col("latency_ms").alias("value")), [0.5, 0.95, 0.99])
    ranks = p.agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 2).alias(f"p{round(100 * s)}_ms") for s in (0.5, 0.95, 0.99)])
    n, tokens = F.count_if("ok"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0))
    row = requests.agg(
        F.count("*").alias("requests"), F.round(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), 2).alias("mean_ms"), F.round(n / F.lit(wall_seconds), 3).alias("throughput_req_s"), tokens.alias("total_tokens"),
        F.round(tokens / F.lit(wall_seconds), 2).alias("tokens_per_s"), F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("error_rate"),
        F.round(1000 * cost_usd(F.lit(1.0), per_second=1.0) * F.lit(wall_seconds) / F.greatest(n, F.lit(1)), 4).alias("cost_per_1k_queries_usd"),
    )
    return row.join(F.broadcast(ranks))  # one row each


def report_lines(report: DataFrame) -> DataFrame:
    """prompt_version and its row of the ablation table in markdown."""
    percent = lambda c: F.concat(F.round(100 * F.col(c), 1).cast("string"), F.lit("%"))
    cells = ["prompt_version", F.col("n_cases").cast("string"), *map(percent, ("accuracy", "mean_faithfulness", "mean_grounded_ratio", "abstention_recall", "abstention_precision")), F.concat(F.round("mean_latency_ms", 1).cast("string"), F.lit(" ms")), F.format_number("total_tokens", 0)]
    return report.select("prompt_version", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def render_markdown(report: DataFrame) -> str:
    """The table of a report, which has one row a prompt version."""
    names = ["prompt version", "cases", "accuracy", "faithfulness", "grounded", "abstain recall", "abstain precision", "mean latency", "tokens"]
    rows = [r["line"] for r in report_lines(report).orderBy("prompt_version").collect()]
    return "\n".join(["| " + " | ".join(names) + " |", "|---|" + "---:|" * 8, *rows]) + "\n"


def run_suite(cases: DataFrame, versions: list[str], hits: DataFrame, replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outcomes of all cases (query_id, text, expected_answer, expects_abstain) under each prompt version, scored.

    hits: query_id; replies: prompt_version, query_id, raw, latency_ms, tokens; chunks: chunk_id, text. A version
    without context is asked without hits. The result is what ``ablation_report`` takes.
    """
    from plumbline.operators import answering

    out = None
    for version in versions:  # a handful of ways to ask, each one plan
        own = replies.filter(F.col("prompt_version") == version)
        told = answering.service_outcomes(cases, hits, own, chunks, version=version)
        joined = cases.join(told, "query_id").join(own.select("query_id", "latency_ms", "tokens"), "query_id", "left").withColumns({
            "prompt_version": F.lit(version), "abstained": F.col("outcome") != answering.ANSWERED, "faithfulness": F.coalesce("faithfulness", F.lit(1.0)), "grounded_ratio": F.coalesce("grounded_ratio", F.lit(0.0)),
            "latency_ms": F.coalesce("latency_ms", F.lit(0.0)), "tokens": F.coalesce("tokens", F.lit(0)),
        })
        out = joined if out is None else out.unionByName(joined)
    return score_cases(out)
