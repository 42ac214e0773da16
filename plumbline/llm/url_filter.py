"""URL filter: longest matching rule, else gradient-boosted trees on lexical features. Built-in expressions and
Spark's own tree learner only.

Rules label part of the urls; the trees learn those labels from lexical features alone and judge the urls that no
rule fits. They learn from all labelled urls but the fifth that is held out, in about ``BINS`` bins a feature, whose
cuts come from quantiles over all of these rows; a url is blocked from the least score on at which the held-out ones are blocked
with ``PRECISION``. The statistics of host suffixes (one and two labels) and of first path segments cover all urls:
how common a key is, and the share blocked among its labelled urls. That share is taken out of fold: for a labelled
url it leaves out the labels of the url's own fold, the held-out fold being one of them, so no label is in its own
features. Keys with less than 1 in ``FREQUENT`` of the urls share one entry, so there are at most ``FREQUENT`` + 1 of
each kind.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
trees like any other; with no labelled url, or labels of one kind only, all urls without a rule get that kind (allow
if there is none); of rules equally long the first by name wins; a very long url is read whole; rows are judged one
by one, so repeated ids and rows don't matter; an empty table gives no rows; other columns pass through, clashing
names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, table
from plumbline.session import materialize

#: Host and path prefix, and the verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BINS = 256
#: Splits that the learner tries for a feature of few rows, and one.
LEAST_SPLITS = 32
#: Training rows of a task, about.
TASK_ROWS = 50_000
FREQUENT = 1000
FOLDS = 5
#: The entry of all keys that are too rare for one of their own; no key holds a space.
RARE = " "
PRECISION = 0.95
STEPS = [k / 20 for k in range(10, 20)]
TREES = 12
DEPTH = 4

FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digits", "f_entropy",
    "f_params", "f_hyphens", "f_dots", "f_fragment", "f_https", "f_upper", "f_longest", "f_suffix_share", "f_suffix_blocked",
    "f_domain_share", "f_domain_blocked", "f_segment_share", "f_segment_blocked", "f_both_blocked",
]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    after = F.when(F.contains(F.col("url"), F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    return (
        pages.withColumn("_after", F.coalesce(after, F.lit("")))
        .withColumn("_host", F.regexp_extract("_after", r"\A([^/?#]*)", 1))
        .withColumn("_rest", F.expr("substring(_after, length(_host) + 1)"))
        .withColumn("path", F.regexp_extract("_rest", r"\A([^?#]*)", 1))
        .withColumn("host", ascii_lower(F.col("_host")))
        .drop("_after", "_host", "_rest")
    )


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and _ruled (its verdict): the longest that fits host and path."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in reversed(ordered):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("_ruled", verdict)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


#: What the statistics are kept for.
KEYS = {
    "suffix": lambda: F.regexp_extract("host", r"([^.]*)\z", 1),
    "domain": lambda: F.regexp_extract("host", r"([^.]*\.?[^.]*)\z", 1),
    "segment": lambda: F.regexp_extract("path", r"\A/([^/]*)", 1),
    "both": lambda: F.concat(F.regexp_extract("host", r"([^.]*)\z", 1), F.regexp_extract("path", r"\A(/[^/]*)", 1)),
}


def fold() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit(1)), F.lit(FOLDS)).cast("int")


def with_features(pages: DataFrame, statistics: dict[str, dict[str, tuple[float, list[float]]]], place: Column) -> DataFrame:
    """Adds FEATURES; ``place`` is the fold that a url's shares leave out, FOLDS for none."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.array_sort(F.filter(F.split(F.lower(url), ""), lambda c: c != ""))
    n = F.length(url)
    # Entropy from run ends in the sorted characters: a run that ends at i and began after j has i - j of them.
    runs = lambda s: F.filter(F.transform(s, lambda c, i: F.when(F.coalesce(F.get(s, i + 1) != c, F.lit(True)), i + 1)), lambda e: e.isNotNull())
    terms = lambda e: F.transform(e, lambda x, k: (x - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * F.log2(x))
    spread = F.element_at(F.transform(F.transform(F.transform(F.array(chars), runs), terms), total), 1)

    def stats(kind: str) -> Column:
        rows = [x for k, (share, blocked) in sorted(statistics[kind].items()) for x in (F.lit(k), F.array(F.lit(share), *map(F.lit, blocked)))]
        if not rows:
            return F.array(*[F.lit(0.0)] * (FOLDS + 2))
        return F.transform(F.array(F.create_map(*rows)), lambda m: F.coalesce(F.try_element_at(m, KEYS[kind]()), F.try_element_at(m, F.lit(RARE))))[0]

    d = lambda c: c.cast("double")
    return (
        pages.withColumns({f"_{kind}": stats(kind) for kind in KEYS})
        .withColumns({
            "f_length": d(n), "f_host_length": d(F.length("host")), "f_path_length": d(F.length("path")),
            "f_depth": d(F.regexp_count("path", F.lit("/[^/]"))), "f_labels": d(F.size(F.split("host", r"\."))),
            "f_digit_ratio": _ratio(F.regexp_count(url, F.lit("[0-9]")), n), "f_host_digits": d(F.regexp_count("host", F.lit("[0-9]"))),
            "f_entropy": F.when(n > 0, F.log2(d(n)) - spread / n).otherwise(F.lit(0.0)),
            "f_params": d(F.when(F.contains(url, F.lit("?")), F.regexp_count(url, F.lit("[?&]"))).otherwise(F.lit(0))),
            "f_hyphens": d(F.regexp_count(url, F.lit("-"))), "f_dots": d(F.regexp_count(url, F.lit(r"\."))),
            "f_fragment": d(F.contains(url, F.lit("#")).cast("int")), "f_https": d(F.startswith(url, F.lit("https:")).cast("int")),
            "f_upper": _ratio(F.regexp_count(url, F.lit("[A-Z]")), n),
            "f_longest": d(F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x)))),
            **{f"f_{kind}_share": F.get(f"_{kind}", 0) for kind in ("suffix", "domain", "segment")},
            **{f"f_{kind}_blocked": F.get(f"_{kind}", place + 1) for kind in KEYS},
        })
        .drop(*[f"_{kind}" for kind in KEYS])
    )


def statistics_of(ruled: DataFrame, total: int) -> dict[str, dict[str, tuple[float, list[float]]]]:
    """By kind and key: the share of all urls, and the smoothed share blocked among the labelled ones, without each
    fold and over all. Frequent keys by themselves, all others as one: at most FREQUENT + 1 rows a kind come back."""
    out = {}
    for kind, key in KEYS.items():
        counts = ruled.groupBy(key().alias("s")).agg(
            F.count("*").alias("n"), *[F.count_if((F.col("_ruled") == "block") & (F.col("_fold") == k)).alias(f"b{k}") for k in range(FOLDS)],
            *[F.count_if(F.col("_ruled").isNotNull() & (F.col("_fold") == k)).alias(f"r{k}") for k in range(FOLDS)],
        )
        name = F.when(F.col("n") * FREQUENT >= total, F.col("s")).otherwise(F.lit(RARE))
        rows = counts.groupBy(name.alias("s")).agg(*[F.sum(c).alias(c) for c in counts.columns[1:]]).collect()
        out[kind] = {}
        for r in rows:
            b, n = [r[f"b{k}"] for k in range(FOLDS)], [r[f"r{k}"] for k in range(FOLDS)]
            shares = [(sum(b) - x + 1) / (sum(n) - y + 2) for x, y in zip([*b, 0], [*n, 0], strict=True)]
            out[kind][r["s"]] = (r["n"] / total, shares)
        out[kind].setdefault(RARE, (0.0, [0.5] * (FOLDS + 1)))
    return out


def cuts_of(rows: DataFrame) -> Bucketizer:
    """Puts FEATURES into bins: cuts lie half way between quantiles over all rows, least and largest value among them."""
    shares = F.array(*[F.lit(k / BINS) for k in range(BINS + 1)])
    found = rows.agg(*[F.percentile_approx(c, shares).alias(c) for c in FEATURES]).head()
    values = [sorted(set(found[c])) for c in FEATURES]
    # Of one value alone, it is the cut itself, since there must be one. A cut belongs to the bin below it.
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] or v for v in values]
    splits = [[-math.inf, *sorted({math.nextafter(x, math.inf) for x in c}), math.inf] for c in cuts]
    return Bucketizer(splitsArray=splits, inputCols=FEATURES, outputCols=[f"_b{k}" for k in range(len(FEATURES))])


def _binned(df: DataFrame, cuts: Bucketizer) -> DataFrame:
    """Adds features, the bins as a vector."""
    names = cuts.getOutputCols()
    # Sums, since the bins' own columns are marked as categories without an order.
    numbers = cuts.transform(df).withColumns({c: F.col(c) + F.lit(0.0) for c in names})
    return VectorAssembler(inputCols=names, outputCol="features").transform(numbers).drop(*names)


def _scored(df: DataFrame, model, cuts: Bucketizer) -> DataFrame:
    model = model.setPredictionCol("_p").setRawPredictionCol("_raw").setProbabilityCol("_prob")
    return model.transform(_binned(df, cuts)).withColumn("score", F.get(vector_to_array("_prob"), 1))


def train(ruled: DataFrame, statistics: dict):
    """The fitted trees, the cuts of their features, the score from which they block, and the held-out precision and
    recall there; or the only label there is."""
    labelled = with_features(ruled.filter(F.col("_ruled").isNotNull()).select("url", "host", "path", "_ruled", "_fold"), statistics, F.col("_fold"))
    labelled = labelled.select((F.col("_ruled") == "block").cast("double").alias("label"), (F.col("_fold") == 0).alias("_out"), F.xxhash64("url").alias("_place"), *FEATURES)
    # Written once: they are what the learner goes over again and again.
    labelled = materialize(labelled, "labelled")
    kinds = {(r["label"], r["_out"]): r["count"] for r in labelled.groupBy("label", "_out").count().collect()}
    learned = sum(n for (_, out), n in kinds.items() if not out)
    if len({label for label, out in kinds if not out}) < 2:
        return "block" if kinds and 0.0 not in {label for label, _ in kinds} else "allow"
    rows = labelled.filter(~F.col("_out"))
    cuts = cuts_of(rows)
    rows = _binned(rows.coalesce(-(-learned // TASK_ROWS)).sortWithinPartitions("_place"), cuts).select("label", "features").cache()
    # The learner looks for splits in all rows, not in some, where there are no more than the square of maxBins.
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=max(LEAST_SPLITS, math.isqrt(learned) + 1))
    model = trees.fit(rows)
    rows.unpersist()
    out = _scored(labelled.filter("_out"), model, cuts)
    hit = lambda t: F.struct(F.count_if(F.col("score") >= t).alias("n"), F.count_if((F.col("score") >= t) & (F.col("label") == 1)).alias("hit"))
    tally = out.agg(*[hit(t).alias(f"t{k}") for k, t in enumerate(STEPS)], F.count_if(F.col("label") == 1).alias("all")).head()
    found = [(t, tally[k]["hit"] / tally[k]["n"], tally[k]["hit"] / max(1, tally["all"])) for k, t in enumerate(STEPS) if tally[k]["n"] and tally[k]["hit"] >= PRECISION * tally[k]["n"]]
    return model, cuts, *(found[0] if found else (1.0, 0.0, 0.0))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    """Adds host, path, rule, verdict and score (the trees' probability of block)."""
    ruled = with_rule(with_parts(pages.drop("host", "path", "rule", "verdict", "score", "features", *FEATURES)), rules).withColumn("_fold", fold())
    statistics = statistics_of(ruled, ruled.count())
    fitted = train(ruled, statistics)
    if isinstance(fitted, str):
        return ruled.withColumn("score", F.lit(1.0 if fitted == "block" else 0.0)).withColumn("verdict", F.coalesce("_ruled", F.lit(fitted))).drop("_ruled", "_fold")
    model, cuts, least, *_ = fitted
    return (
        _scored(with_features(ruled, statistics, F.lit(FOLDS)), model, cuts)
        .withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= least, F.lit("block")).otherwise(F.lit("allow"))))
        .drop("_ruled", "_fold", "features", "_p", "_raw", "_prob", *FEATURES)
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' part of op10, which SQL can judge as well."""
    return with_rule(with_parts(table(spark, sf_dir, "pages").select("page_id", "url")), RULES).select("page_id", "host", "path", "rule", F.col("_ruled").alias("ruled"))


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
RULES_SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} END AS ruled
FROM c
"""
