"""Secret scans: rule spans, and runs that look random to two character models. Built-in expressions only.

The models are first-order Markov chains over the characters of runs (letters, digits, ``+ / _ -`` and closing ``=``),
with both ends as characters of their own. The one of random strings learns from the values that rules find, the one
of ordinary identifiers from all runs that no rule span touches and that aren't such a value elsewhere. Every document
is read for both and every distinct run counts once, so that copies don't weigh. A run's score is the sum, over its
characters, of the logarithm of what the random model gives by what the ordinary one does; it is a secret where its
probability of being one, with the labelled runs' shares as odds before, is at least ``PRECISION``. Such runs are added
where they don't touch a rule span.

What reaches the driver is two tables of pairs of characters, of one size for any input; a run's pairs are counted in
tasks first.

Defined cases: a null or empty text has no spans; rules and models read very long texts whole, and a run without a break
takes time in proportion to its length; of one kind's matches the leftmost counts and those that fail are gone; equal
starts come in the order of the kinds; rows are judged one by one, so repeated ids and rows don't matter (repeated runs
count once); an empty table gives no rows; without a labelled run of either sort only the rules count; other columns
pass through, clashing names are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, text_of
from plumbline.session import materialize

# The rules, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex"]
LEAST_VALUE = 8
#: Runs of 16 and 32 characters or more: a rule's match takes its whole run, so shorter ones can be left out at once.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"

MARKOV = "markov"
RUN = "[A-Za-z0-9+/_-]{12,}={0,2}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SIZE = len(SYMBOLS) + 1  # 0 stands for both ends
PRECISION = 0.99
#: Added to each count of a pair.
SMOOTH = 0.5
#: Matches that are placed one after the other before they are joined to the ones before.
STRETCH = 256

_ITEM = "struct<start:int,end:int,text:string>"
_SPAN = "struct<kind:string,start:int,end:int,score:double>"


@dataclass(frozen=True)
class Models:
    """Log ratios of pairs of characters, row by row, and the least sum of a secret (None: there is none)."""

    ratios: list[float]
    least: float | None


def located(df: DataFrame, name: str, pattern: str, needed: Column) -> DataFrame:
    """Turns ``name``, the texts of all matches in ``_text``, into structs of start, end (code points) and text: what
    stands between them tells where they are. Rows that don't need it, and those without a match, get an empty list."""
    gaps = F.split("_text", pattern, -1)
    pairs = F.arrays_zip(F.col(name).alias("m"), F.slice(gaps, F.lit(1), F.size(name)).alias("g"))
    # In a column of its own, so that it isn't worked out again for each use.
    df = df.withColumn("_pairs", F.when(needed & (F.size(name) > 0), pairs))
    return df.withColumn(name, F.when(F.col("_pairs").isNotNull(), _running(F.col("_pairs"))).otherwise(F.array().cast(f"array<{_ITEM}>"))).drop("_pairs")


def _running(pairs: Column) -> Column:
    """Places from gaps and matches, in stretches, so that long lists aren't copied for each match."""

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["g"])
        end = start + F.length(pair["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("text")))).alias("out"))

    def joined(state: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), (x["end"] + state["at"]).alias("end"), x["text"].alias("text")))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["out"], moved).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ITEM}>").alias("out"))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STRETCH).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * STRETCH + 1, F.lit(STRETCH)), none, step))
    return F.aggregate(stretches, none, joined)["out"]


def value_of(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 1)


def ruled(docs: DataFrame) -> DataFrame:
    """Adds _text, _assign, _access and _hex (the rules' matches), and _spans, all of these."""
    df = docs.withColumn("_text", text_of())
    # What a match can't do without is looked for first, which is cheap.
    signs = {"_assign": ["=", ":"], "_access": ["AKIA"], "_hex": [""]}
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX)):
        possible = F.lit(False)
        for sign in signs[name]:
            possible = possible | F.contains("_text", F.lit(sign))
        df = located(df.withColumn(name, F.when(possible, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))), name, pattern, F.lit(True))
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(value_of(x["text"])) >= LEAST_VALUE))
    return df.withColumn("_spans", F.concat("_assign", "_access", "_hex"))


def with_runs(rules: DataFrame) -> DataFrame:
    """Adds _runs: the texts of all runs."""
    return rules.withColumn("_runs", F.regexp_extract_all("_text", F.lit(RUN), F.lit(0)))


def _free(placed: Column, spans: Column) -> Column:
    """Those that touch no span."""
    return F.filter(placed, lambda r: ~F.exists(spans, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))


def _symbols(run: Column) -> Column:
    """Numbers of a run's characters, with 0 at both ends."""
    inner = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(SYMBOLS)))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def labelled(docs: DataFrame) -> DataFrame:
    """run and secret (1 or 0) of all distinct runs: values of rules, and runs that no rule span touches."""
    rules = with_runs(ruled(docs.select("text"))).withColumn("_apart", F.size("_spans") == 0)
    rules = located(rules.withColumn("_near", F.col("_runs")), "_near", RUN, ~F.col("_apart"))
    values = F.concat(F.transform("_assign", lambda x: F.regexp_extract(value_of(x["text"]), RUN, 0)), F.transform("_access", lambda x: x["text"]), F.transform("_hex", lambda x: x["text"]))
    runs = F.when(F.col("_apart"), F.col("_runs")).otherwise(F.transform(_free(F.col("_near"), F.col("_spans")), lambda x: x["text"]))
    tag = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("run"), F.lit(n).alias("secret")))
    every = rules.select(F.explode(F.concat(tag(values, 1), tag(runs, 0))).alias("r")).select("r.run", "r.secret").filter("run <> ''")
    return every.groupBy("run").agg(F.max("secret").alias("secret"))


def fit(docs: DataFrame) -> Models:
    runs = materialize(labelled(docs), "runs")
    n = {r["secret"]: r["n"] for r in runs.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Models([0.0] * SIZE * SIZE, None)
    chars = runs.select("secret", _symbols(F.col("run")).alias("s"))
    pairs = chars.select("secret", F.explode(F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: a * SIZE + b)).alias("pair"))
    counts = [[SMOOTH] * SIZE * SIZE for _ in range(2)]
    for r in pairs.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect():  # at most twice SIZE * SIZE rows
        counts[r["secret"]][r["pair"]] += r["n"]
    row = lambda c: [sum(c[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)]
    ordinary, random, a, b = counts[0], counts[1], row(counts[0]), row(counts[1])
    ratios = [round(math.log(random[i] / b[i // SIZE]) - math.log(ordinary[i] / a[i // SIZE]), 6) for i in range(SIZE * SIZE)]
    return Models(ratios, math.log(n[0] / n[1]) + math.log(PRECISION / (1 - PRECISION)))


def score(run: Column, models: Models) -> Column:
    """How much likelier a run's characters are under the random model, as a logarithm."""
    # One literal text, turned into an array once when the plan is made.
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in models.ratios)), ",").cast("array<double>")

    def add(state: Column, x: Column) -> Column:
        return F.struct(x.alias("last"), (state["sum"] + F.get(ratios, state["last"] * SIZE + x)).alias("sum"))

    inner = F.slice(_symbols(run), F.lit(2), F.length(run) + 1)
    return F.aggregate(inner, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), add)["sum"]


def find(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """Adds rule_spans and spans: arrays of struct<kind, start, end, score> by start and kind; a rule's score is null."""
    models = models or fit(docs)
    kept = docs.drop("rule_spans", "spans")
    # The given columns go along in one, so that none clashes with what is worked out here.
    out = ruled(kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("_row"), "text"))
    numbered = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(None).cast("double").alias("score")))
    named = F.array(*map(F.lit, [*KINDS, MARKOV]))
    told = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(F.get(named, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))).cast(f"array<{_SPAN}>")
    out = out.withColumn("_base", F.concat(numbered("_assign", 0), numbered("_access", 1), numbered("_hex", 2)))
    if models.least is None:
        out = out.withColumn("_all", F.col("_base"))
    else:
        # Runs are scored where they stand; only texts with a likely one are gone through for its place.
        out = with_runs(out).withColumn("_scores", F.transform("_runs", lambda r: score(r, models)))
        out = located(out, "_runs", RUN, F.exists("_scores", lambda x: x >= models.least))
        likely = F.filter(F.zip_with("_runs", "_scores", lambda r, x: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("k"), r["end"].alias("end"), x.alias("score"))), lambda x: x["start"].isNotNull() & (x["score"] >= models.least))
        out = out.withColumn("_likely", likely).withColumn("_all", F.concat("_base", _free(F.col("_likely"), F.col("_spans"))))
    return out.select("_row.*", told(F.col("_base")).alias("rule_spans"), told(F.col("_all")).alias("spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("rule_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("rule_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def secret_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op13, which SQL can find as well."""
    return op13_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN_SQL = "(" + "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind_sql(kind: str, k: int, pattern: str, fits: str) -> str:
    return f"""
{kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS gap FROM d),
{kind} AS (SELECT doc_id, list_transform(list_transform(list_filter(range(len(m)), lambda i: {fits}), lambda i: {{
  's': CAST(coalesce(list_sum(list_transform(gap[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT), 'm': m[i + 1]}}),
  lambda y: {{'s': y.s, 'k': {k}, 'e': y.s + length(y.m)}}) AS x FROM {kind}_m)"""


PLACES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{_kind_sql("assign", 0, _ASSIGN_SQL, f"length(regexp_extract(m[i + 1], '{_ASSIGN_SQL}', 2)) >= {LEAST_VALUE}")},{_kind_sql("access", 1, "AKIA[A-Z0-9]+", "length(m[i + 1]) >= 16")},
{_kind_sql("hex", 2, "[0-9a-f]+", "length(m[i + 1]) >= 32").strip()}
SELECT doc_id, len(assign.x) AS n_assign, len(access.x) AS n_access, len(hex.x) AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_sort(list_concat(assign.x, access.x, hex.x)), lambda y: ['assign', 'access', 'hex'][y.k + 1] || ':' || y.s || ':' || y.e), ','), '')) AS base_sha256
FROM assign JOIN access USING (doc_id) JOIN hex USING (doc_id)
"""
