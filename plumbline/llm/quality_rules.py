"""Quality rules: base counts, and divergence from language references. Built-in expressions only.

A row is judged by itself, except for the references, which are means over all documents of a language that pass the
base, at most one short row for each of the languages in ``COMMON_WORDS`` plus one for all others together. Counts and
histograms are written once, in one pass over the texts; references and verdicts are read from them.

The verdict: a document's character classes and its language's common words are histograms; the Jensen-Shannon
distance (base 2, square root of the divergence) to the language's reference must stay under a threshold. A
histogram counts only from a least number of words on, below which chance alone moves it. A language's class reference
leans on that of all languages by the weight of ``PRIOR`` documents, so that a rare language has a steady one.

Defined cases: a null text has no words and fails the base; a null or unknown language is judged by the pooled
reference; with no reference at all (an empty table, or none long enough) only the base decides; a very long text is
counted whole, in one row; rows are judged one by one, so repeated ids and rows count as often as they stand and get
the same verdict; equal distances tie without effect; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, table, text_of
from plumbline.session import materialize

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?()[]\"'-_/"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Words from which on a histogram is compared.
MIN_FOR_CLASSES = 50
MIN_FOR_WORDS = 80
#: Documents of all languages that stand in a language's class reference beside its own.
PRIOR = 30
#: White space among characters.
BLANKS = " \t\n\x0b\x0c\r"
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.28

#: Frequent function words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "was", "with"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est"],
}
POOLED = "*"


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` that are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep those with an equal neighbour, and
    add up what each kept window covers before the next one starts."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda p: p.isNotNull()))

    # One-element arrays bind a value once, so that the sort isn't repeated for each use.
    found = F.flatten(F.transform(F.array(ordered), places))
    width = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)), F.lit(0), lambda a, x: a + x)
    covered = F.element_at(F.transform(F.array(found), width), 1)
    return F.when(n > F.size(F.array_distinct(windows)), covered).otherwise(F.lit(0))


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the histograms _lang, _classes
    and _common (counts)."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    refs = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    at = lambda i, j: F.get("_hashes", i + j)
    seen = ["_upper", "_lower", "_digit", "_punct", "_space", "n_symbols"]
    return (
        # Most characters are small letters: the other classes are counted in what is left without them.
        docs.withColumn("_rest", F.regexp_replace(text, r"\p{Ll}+", ""))
        .withColumn("_words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_space", _count(F.col("_rest"), BLANKS))
        .withColumn("word_chars", (F.length(text) - F.col("_space")).cast("long"))
        .withColumn("n_symbols", _count(F.col("_rest"), SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", F.slice(F.transform("_hashes", lambda h, i: F.xxhash64(h, *[at(i, j) for j in range(1, WINDOW)])), F.lit(1), F.greatest(F.lit(0), F.size("_hashes") - (WINDOW - 1))))
        .withColumn("n_repeat_words", _covered(F.col("_windows")).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("_lang", F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(POOLED)))
        .withColumn("_upper", out(F.col("_rest"), r"\p{Lu}+"))
        .withColumn("_lower", F.length(text) - F.length("_rest"))
        .withColumn("_digit", out(F.col("_rest"), r"\p{Nd}+"))
        .withColumn("_punct", _count(F.col("_rest"), PUNCTUATION))
        .withColumn("_classes", F.array(*[F.col(c).cast("double") for c in seen], (F.length(text) - sum((F.col(c) for c in seen[1:]), F.col(seen[0]))).cast("double")))
        # Small words without closing punctuation; a language's common ones are counted by taking each away.
        .withColumn("_plain", F.split(F.lower(F.concat(text, F.lit(" "))), r"[.,;:!?]*[\x20\x09-\x0D]+"))
        .withColumn("_refs", F.coalesce(F.try_element_at(refs, F.col("_lang")), F.array().cast("array<string>")))
        .withColumn("_hits", F.transform("_refs", lambda r: (F.size("_plain") - F.size(F.array_remove("_plain", r))).cast("double")))
        .withColumn("_common", F.concat("_hits", F.array(F.col("n_words") - F.aggregate("_hits", F.lit(0.0), lambda a, x: a + x))))
        .drop("_rest", "_words", "_lines", "_hashes", "_windows", "_plain", "_refs", "_hits", *seen[:-1])
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def references(measured: DataFrame) -> dict[str, tuple[list[float] | None, list[float] | None]]:
    """By language, and pooled: the mean shares of classes and of common words among documents that pass the base. A
    row for each language comes back."""
    width = 7
    words = max(map(len, COMMON_WORDS.values())) + 1
    shares = (
        measured.filter((F.col("n_words") >= MIN_FOR_CLASSES) & ~F.col("base_failed"))
        .withColumn("_c", _shares(F.col("_classes")))
        .withColumn("_w", F.when(F.col("n_words") >= MIN_FOR_WORDS, _shares(F.col("_common"))))
    )
    rows = shares.groupBy("_lang").agg(
        F.count("*").alias("n"), F.count("_w").alias("m"),
        F.array(*[F.sum(F.get("_c", i)) for i in range(width)]).alias("c"), F.array(*[F.sum(F.get("_w", i)) for i in range(words)]).alias("w"),
    ).collect()
    if not rows:
        return {POOLED: (None, None)}
    n = sum(r["n"] for r in rows)
    pooled = [sum(r["c"][i] for r in sorted(rows, key=lambda r: r["_lang"])) / n for i in range(width)]
    leaning = lambda r: [(x + PRIOR * p) / (r["n"] + PRIOR) for x, p in zip(r["c"], pooled, strict=True)]
    refs = {r["_lang"]: (leaning(r), [(x or 0.0) / r["m"] for x in r["w"]] if r["m"] and r["_lang"] != POOLED else None) for r in rows}
    return refs | {POOLED: (pooled, None)}


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2: 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def _literal(refs: dict, k: int) -> Column:
    rows = [x for lang, pair in sorted(refs.items()) if pair[k] for x in (F.lit(lang), F.array(*map(F.lit, pair[k])))]
    return F.try_element_at(F.create_map(*rows), F.col("_lang")) if rows else F.lit(None).cast("array<double>")


def judge(docs: DataFrame, *, text: bool = True) -> DataFrame:
    """Adds the base counts, class_distance, word_distance (null where not compared) and kept. Without ``text`` that
    column is left out, and not written."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")
    measured = measure(docs)
    measured = materialize(measured if text else measured.drop("text"), "measured")
    refs = references(measured)
    # A language without a reference of its own falls back to the pooled one.
    lang = F.when(F.col("_lang").isin(*refs), F.col("_lang")).otherwise(F.lit(POOLED))
    return (
        measured.withColumn("_lang", lang)
        .withColumn("class_distance", F.when(F.col("n_words") >= MIN_FOR_CLASSES, js_distance(_shares(F.col("_classes")), _literal(refs, 0))))
        .withColumn("word_distance", F.when(F.col("n_words") >= MIN_FOR_WORDS, js_distance(_shares(F.col("_common")), _literal(refs, 1))))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE))
        .drop("_lang", "_classes", "_common")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps."""
    return judge(docs).filter("kept").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8, which SQL can count as well."""
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


COUNTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5]) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""
