"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no content, for service mode and for file-corpus mode.
STOPWORDS = (
    "a an the is are was were be been being of in on at to for and or but if then this that these those it its as by "
    "with from into up down not no do does did can may must will shall has have had"
).split()
FILE_STOPWORDS = (
    "a an the is are was were be been of in on at to for and or but if then this that these those it its as by with from "
    "into not no do does did can may must will shall has have had what which who whom whose when where why how"
).split()

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(])"
# Units that may follow a lone number.
UNIT = (
    r"(?i)^([+-]?[0-9]+(?:[.,][0-9]+)*)\s*(?:°\s*[cf]?|%|degrees?(?:\s*(?:c|f|celsius|fahrenheit))?|celsius|fahrenheit|milliseconds?|seconds?|secs?|ms|s|"
    r"volts?|v|watts?|w|amps?|a|[kmg]?hz|[kmgt]b|c|f)$"
)
# What separates the parts of an identifier, and quotes around an answer.
SPACES = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"\s" + SPACES
SEPARATORS = r"[\s\-._·‐-―" + SPACES + "]+"
QUOTES = "`'\"“”‘’ "


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(text: Column, stop: list[str] = STOPWORDS) -> Column:
    """Distinct tokens of two letters or more that aren't function words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(stop)))


def n_pieces(text: Column) -> Column:
    """White-space separated pieces: the chunkers' token count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def sentences(text: Column) -> Column:
    """Text split after a sentence's end that a capital or parenthesis follows; blank ones dropped."""
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def stem(token: Column) -> Column:
    """Drops one plural s of a purely alphabetic token longer than three letters, unless it ends in ss."""
    return F.when(token.rlike("^[a-z]{3,}s$") & ~F.endswith(token, F.lit("ss")), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def file_tokens(text: Column) -> Column:
    """Identifier-aware tokens: stemmed parts, and the joined form where any part isn't a number."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[-_.][a-z0-9]+)*"), F.lit(0))

    def parts(word: Column) -> Column:
        split = F.split(word, "[-_.]")
        joined = F.when((F.size(split) > 1) & F.exists(split, lambda p: ~p.rlike("^[0-9]+$")), F.array(F.array_join(split, ""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(split, stem), joined)

    return F.flatten(F.transform(words, parts))


def file_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(file_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(FILE_STOPWORDS)))


def grader_form(text: Column) -> Column:
    """Upper case without separators: how answers and identifiers are compared."""
    return F.upper(F.regexp_replace(text, SEPARATORS, ""))


def holds(text: Column, value: Column) -> Column:
    """Whether the grader form of a non-empty value occurs in that of the text."""
    return (grader_form(value) != "") & F.contains(grader_form(text), grader_form(value))


def identifiers(text: Column, least: int = 4, most: int = 20_000) -> Column:
    """Distinct grader forms of tokens that mix letters and digits."""
    mixed = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), F.lit(0)), lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]"))
    return F.slice(F.array_distinct(F.filter(F.transform(mixed, grader_form), lambda t: F.length(t) >= least)), 1, most)


def strip_unit(answer: Column) -> Column:
    """The number of a lone number with a unit; anything else trimmed."""
    bare = strip(answer)
    return F.coalesce(F.nullif(F.regexp_extract(bare, UNIT, 1), F.lit("")), bare)


def clean_answer(raw: Column) -> Column:
    """First line without wrapping quotes, closing punctuation, a leading label, or a unit. Quotes and punctuation
    nest, and white space goes only with one of them: what is taken off an end is a run of both."""
    line = strip(F.regexp_extract(strip(raw), r"^([^\n\r]*)", 1))
    bare = F.regexp_replace(line, f"^[{QUOTES}]+|[{QUOTES}.;,]+$", "")
    return strip_unit(F.regexp_replace(bare, r"(?i)^(?:answer|value)\s*[:=]\s*", ""))


def citation_label(title: Column, section: Column, document_id: Column) -> Column:
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(title, F.lit(" §"), section)).otherwise(title)
    return F.coalesce(F.nullif(F.when(F.coalesce(title, F.lit("")) != "", named), F.lit("")), document_id)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths, or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def reply(raw: Column, schema: str) -> Column:
    """A model's JSON reply, with or without a fence; null where it isn't an object."""
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    return F.when(bare.rlike(r"(?s)^\{.*\}$"), F.from_json(bare, schema))
