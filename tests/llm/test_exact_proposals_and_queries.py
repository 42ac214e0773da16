"""License templates over all starts, and nearest neighbours of repeated and huge queries, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import ann, licenses


def starts_of(words: list[str], index: list[dict]) -> Counter:
    """(label, start, share) over every start that a template could have."""
    at = lambda i: words[i] if 0 <= i < len(words) else None
    out = Counter()
    for t in index:
        for s in range(0 if t["base"] else -100, len(words)):
            if all(at(s + place + j) == w for key, place in t["keys"] for j, w in enumerate(key)):
                share = sum(at(s + i) == w for w, i in t["rare"]) / len(t["rare"])
                if share >= (1.0 if t["base"] else licenses.MIN_SHARE):
                    out[t["label"], s, round(share, 9)] += 1
    return out


def texts() -> list[str]:
    rng = random.Random(3)
    every = [t for t, _ in licenses.TEMPLATES.values()]
    vocab = sorted({w for t in every for w in t.split()}) + ["alpha", "beta"]
    out = []
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(1, 3)):
            copy = rng.choice(every).split()
            for _ in range(rng.randint(0, 4)):  # edits that may hit mandatory words
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            words += copy[rng.choice([0, 0, 3]) :] + [rng.choice(vocab) for _ in range(rng.randint(0, 6))]
        out.append(" ".join(words))
    return [*out, "", "cc by cc by cc by", "general public license " * 50]


def test_templates_are_found_at_every_start(spark):
    docs = texts()
    df = Counter(w for t in docs for w in set(t.split()))
    index = licenses.build_index(df, len(docs), licenses.TEMPLATES, licenses.PHRASES)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = 0
    for r in licenses.scan(frame).collect():
        got = Counter((m["label"], m["start"], round(m["share"], 9)) for m in r["matches"])
        assert got == starts_of(docs[r["doc_id"]].split(), index), docs[r["doc_id"]]
        found += sum(got.values())
    assert found > 200


def test_words_elsewhere_do_not_hide_an_edited_copy(spark):
    opening = licenses.TEMPLATES["mit"][0]
    edited = " ".join("x" if w in ("a", "and", "any") else w for w in opening.split())
    docs = [edited, f"a and any {edited}", *[f"{opening} {k}" for k in range(5)]]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert all("mit" in r["labels"].split(",") for r in rows)


def nearest(rows: list[tuple[int, list[float]]], query: tuple[int, list[float]], k: int) -> list[tuple[int, float]]:
    """Distances without overflow, by long doubles."""
    q = np.array(query[1], np.longdouble)
    found = sorted((float(np.sqrt(((np.array(v, np.longdouble) - q) ** 2).sum())), i) for i, v in rows if i != query[0])
    return [(i, d) for d, i in found[:k]]


def test_repeated_queries_find_ten_neighbours_once(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(120)]
    rows += [rows[0], rows[0], rows[7], (100, rng.normal(size=6).tolist())]  # a query three times, a candidate twice, an id with two vectors
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    by = Counter(r["query_id"] for r in got)
    assert by == {0: 10, 50: 10, 100: 20}
    for q in (0, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = nearest(rows, next(r for r in rows if r[0] == q), 10)
        assert [r[1] for r in own] == [i for i, _ in want] and np.allclose([r[2] for r in own], [d for _, d in want])


def test_huge_vectors_keep_their_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.uniform(1, 10, 4) * 1e199).tolist()) for k in range(60)] + [(60 + k, rng.normal(size=4).tolist()) for k in range(20)] + [(90, [1.7e308, 0.0, 0.0, 0.0]), (91, [-1.7e308, 0.0, 0.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0, k=5).collect()
    for q in (0, 30):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = nearest(rows, next(r for r in rows if r[0] == q), 5)
        assert [r[1] for r in own] == [i for i, _ in want] and np.allclose([r[2] / 1e199 for r in own], [d / 1e199 for _, d in want])
    assert Counter(r["query_id"] for r in got) == {0: 5, 30: 5, 60: 5, 90: 5}
