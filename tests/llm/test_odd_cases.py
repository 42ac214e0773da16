"""Nulls, ids of 64 bits, very long texts, repeated rows, ties, empty tables and clashing names, for every operator."""

from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import ann, licenses, lm_scoring, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, url_filter
from plumbline.llm.common import n_words, text_of

BIG = 2**60 + 1
LONG = "9" * 300_000 + " " + "word other " * 20_000 + "x" * 300_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (None, None, None, None, None), (BIG, "one two three four", "en", "s", 18), (BIG, "one two three four", "en", "s", 18), (3, "", "xx", None, 0),
    (4, LONG, "en", "s", len(LONG)), (5, "one two three four", None, "t", 18), (6, "mail a@b.org now", "de", "t", 16),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


OPERATORS = {
    "licenses": lambda d: licenses.scan(clashing(d, "labels", "score", "n_words")),
    "mixing": lambda d: mixing.mix(clashing(d, "size", "taken"), n_words(text_of())),
    "near_dedup": lambda d: near_dedup.link_components(clashing(d, "component_id", "_fp")),
    "quality_classifier": lambda d: quality_classifier.classify(clashing(d, "score"), d.sparkSession.createDataFrame([(BIG, 1), (4, 0), (5, 1), (None, 1)], "doc_id long, quality int")),
    "pii": lambda d: pii.find(clashing(d, "spans", "rule_spans")),
    "lm_scoring": lambda d: lm_scoring.score(clashing(d, "score", "h")),
    "quality_rules": lambda d: quality_rules.judge(clashing(d, "kept", "n_words")),
    "pieces": lambda d: pieces.encode_checked(clashing(d, "ids", "n_ids")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_keeps_its_id_and_equal_rows_get_equal_results(spark, docs, name):
    rows = OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twins = [tuple(r) for r in rows if r["doc_id"] == BIG]
    assert len(twins) == 2 and (name == "mixing" or twins[0] == twins[1])
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_results_on_very_long_texts(docs):
    one = lambda df: df.filter("doc_id = 4").head()
    assert one(licenses.scan(docs))["n_words"] == 40_002
    assert one(pieces.encode_checked(docs))["round_trip"] is True
    assert one(quality_rules.judge(docs))["n_repeat_words"] == 40_000
    assert one(near_dedup.link_components(docs, k=3, threshold=Fraction(85, 100)))["n_shingles"] == 4
    assert one(lm_scoring.score(docs, attended=False))["n_tokens"] == 40_003


def test_vectors_with_odd_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0]), (BIG, [1.0, 0.0]), (BIG, [1.0, 0.0]), (100, [1.0, 0.1]), (7, None), (8, [0.0, 0.0]), (9, [2.0, 0.0])]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "score", "rank")
    got = ann.search(frame, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(100, 1, BIG), (100, 2, BIG), (100, 3, 9)]


def test_urls_with_odd_ids_and_one_kind_of_label(spark):
    rows = [(None, None), (BIG, "http://a.org/x"), (BIG, "http://a.org/x"), (3, "http://b.net/" + "y" * 200_000)]
    frame = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "score", "verdict")
    got = url_filter.judge(frame).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows) and {r["verdict"] for r in got} == {"allow"}


def test_each_stage_of_the_pipeline_on_odd_rows_and_on_none(spark, docs, tmp_path):
    words = lambda k: " ".join(f"w{k}x{j} the of and" for j in range(40))
    rows = [*ROWS, *[(k, words(k), "en", "s", 1) for k in range(10, 40)], (50, words(10) + " end", "en", "s", 1), (BIG + 2, words(99) + " write to q@z.org", "en", None, 1)]
    every = clashing(spark.createDataFrame(rows, DOCS), "kept", "spans", "ids", "size")
    for start in (every, every.limit(0)):
        now, counts = start, []
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            counts.append(now.count())
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert now.columns == corpus_pipeline.COLUMNS
                now = corpus_pipeline.materialize(now, "stage")
        if start is every:
            assert counts[:2] == [32, 31]  # junk goes, then one near copy
            assert BIG + 2 in {r["doc_id"] for r in now.collect()} and all(r["round_trip"] for r in now.collect())
        else:
            assert counts == [0] * 5
