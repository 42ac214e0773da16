from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths as P
from plumbline.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).head()["x"]


def test_tokens_follow_the_pattern_on_random_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ9 .-_éß\n ") for _ in range(60)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", X.tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r["x"] == re.findall("[a-z0-9]+", texts[r["i"]].lower())


@pytest.mark.parametrize(("raw", "bare"), [("94 °C", "94"), ("1.5 GB", "1.5"), ("50%", "50"), ("4.3.2", "4.3.2"), ("Q3 FY27", "Q3 FY27"), (" 12 boxes ", "12 boxes"), ("REV-C2", "REV-C2")])
def test_strip_unit(spark, raw, bare):
    assert one(spark, X.strip_unit(F.col("t")), t=raw) == bare


@pytest.mark.parametrize(("raw", "bare"), [('"Answer: 94 C".', "94"), ("`blue`.\nwhy", "blue"), ("value = x y;", "x y"), ("", ""), ("\n94 V", "94"), ("\t 'a b'. \r\n", "a b"), ("\u00a07 ms\n", "7"), ("  \n ", "")])
def test_clean_answer(spark, raw, bare):
    assert one(spark, X.clean_answer(F.col("t")), t=raw) == bare


@pytest.mark.parametrize(("raw", "want"), [("One. Two.\n", ["One.", "Two."]), ("\t\nA b? (C) d.", ["A b?", "(C) d."]), (" \n", []), ("v. small", ["v. small"])])
def test_sentences_lose_white_space_of_every_kind(spark, raw, want):
    assert one(spark, X.sentences(F.col("t")), t=raw) == want


def test_file_tokens_join_identifiers_but_not_numbers(spark):
    assert one(spark, X.file_tokens(F.col("t")), t="TQ-40 v4.3.2 fans glass") == ["tq", "40", "tq40", "v4", "3", "2", "v432", "fan", "glass"]


def test_grader_form_and_holds(spark):
    assert one(spark, X.grader_form(F.col("t")), t="Orr– 1847 b.c_straße") == "ORR1847BCSTRASSE"
    assert one(spark, X.holds(F.col("t"), F.lit("orr 1847")), t="see ORR-1847.") is True
    assert one(spark, X.holds(F.col("t"), F.lit(" - ")), t="see ORR-1847.") is False


def test_identifiers_mix_letters_and_digits(spark):
    assert sorted(one(spark, X.identifiers(F.col("t")), t="ORR-1847 2024 word E7731 A1 orr-1847")) == ["E7731", "ORR1847"]


def test_cosine_of_odd_vectors_is_zero(spark):
    for a, b, want in (([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0)):
        assert one(spark, X.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(("path", "family", "revision"), [("s/tq_r1_WITHDRAWN.pdf", "s/tq", [0, 1]), ("s/tq_rev_b2.docx", "s/tq", [2, 2]), ("plain.txt", "plain", [0]), ("a/b/x v1.md", "a/b/x", [0, 1]), ("x_r20250101123000.pdf", "x", [0, 20250101123000])])
def test_family_and_revision(spark, path, family, revision):
    fam, rev = P.family_and_revision(F.col("t"))
    got = one(spark, F.struct(fam.alias("f"), rev.alias("r")), t=path)
    assert got["f"] == family
    assert got["r"] == revision


def test_name_withdrawn_is_unanchored_unless_strict(spark):
    assert one(spark, P.name_withdrawn(F.col("t")), t="threshold.csv") is True
    assert one(spark, P.name_withdrawn(F.col("t"), strict=True), t="threshold.csv") is False
    assert one(spark, P.name_withdrawn(F.col("t"), strict=True), t="x_old.csv") is True


def test_walk_order_puts_files_before_folders(spark):
    paths = ["b/a.txt", "a.txt", "z.txt", "b/c/d.txt", "a/x.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(P.walk_key(F.col("p"))).collect()
    assert [r["p"] for r in rows] == ["a.txt", "z.txt", "a/x.txt", "b/a.txt", "b/c/d.txt"]
