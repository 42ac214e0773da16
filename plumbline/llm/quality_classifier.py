"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, a linear hinge-loss model is fitted on
them by dual coordinate descent.

Indicators: hashed byte n-grams of order 1 to 4 (case kept, so that shouting and markup show), and word bigrams of
one word twice by how common they are in the text. Learning uses labelled rows only where crc32 of the id as text is
not 2 modulo 4, and at most ``MAX_COUNTED`` of them for the ratios and ``MAX_TRAIN`` for the margin, smallest hash
first (documented bounds, which also bound what is broadcast and collected). A fifth of the latter calibrates the
margin to a probability. Neither labels nor lang, source or id enter a score; every row is scored on its whole text.

Defined cases: a null or empty text has no indicators and is scored by the bias alone; a very long text is hashed
whole, in one array; equal hashes of labelled rows are ordered by id; labels that are null, other
than 0 and 1, or contradict each other for one id are left out; with labels of one kind only all scores are that
kind's share; a null id counts as the empty string; rows are scored one by one, so repeated ids and rows don't
matter; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import add_columns, table

BITS = 18
ORDERS = (1, 2, 3, 4)
MAX_COUNTED = 20_000
MAX_TRAIN = 6_000
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12
THRESHOLD = 0.7
#: Indicators of adjacent repeats: at least this share of the words.
REPEATS = (0.001, 0.01, 0.05, 0.2, 0.5)


class Indicators:
    """Distinct hashed n-grams of a text; reuses one stamp array instead of sorting."""

    def __init__(self):
        self.stamp = np.zeros(2**BITS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return np.zeros(0, np.int64)
        b = np.frombuffer(raw, np.uint8).astype(np.uint64)
        parts = []
        for n in ORDERS:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, n, np.uint64)
                for j in range(n):
                    h = h * np.uint64(257) + b[j : len(b) - n + 1 + j] + np.uint64(1)
                parts.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        words = raw.split()
        twice = sum(map(eq, words, words[1:]))
        parts.append(np.array([k for k, share in enumerate(REPEATS) if twice >= share * len(words) and twice], np.uint64))
        h = np.concatenate(parts).astype(np.int64)
        order = np.arange(len(h), dtype=np.int32)
        self.stamp[h] = order
        return h[self.stamp[h] == order]


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def training_labels(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, y and h of at most ``most`` usable labels, smallest hash first."""
    clear = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 2)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_z")).filter("y = _z")
    return clear.select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most)


def log_count_ratios(sample: DataFrame) -> np.ndarray:
    """Smoothed log ratio of the classes' n-gram shares; one row a bucket comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, counts = Indicators(), np.zeros((2, 2**BITS))
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                counts[y, of(text)] += 1
        used = np.flatnonzero(counts.sum(0))
        yield pd.DataFrame({"k": used, "n0": counts[0, used], "n1": counts[1, used]})

    rows = sample.select("text", "y").mapInPandas(run, "k long, n0 double, n1 double").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    p = np.full((2, 2**BITS), SMOOTHING)
    p[0, rows["k"]] += rows["n0"].to_numpy()
    p[1, rows["k"]] += rows["n1"].to_numpy()
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def scaled(index: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    v = ratios[index]
    return v / max(np.sqrt((v**2).sum()), 1e-12)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (in scaled space) and bias of the hinge-loss model; y in -1, 1."""
    w, bias, alpha, rng = np.zeros(len(ratios)), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    values = [scaled(x, ratios) for x in rows]
    norms = np.array([(v**2).sum() + 1 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), penalty)
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins and 0/1 labels, by Newton steps."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


class Model:
    """``weight`` scores an indicator, ``square`` its part of the squared norm."""

    def __init__(self, ratios: np.ndarray, w: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.square = (w * ratios), ratios**2
        self.bias, self.a, self.b = bias, a, b

    def margin(self, x: np.ndarray) -> float:
        return self.weight[x].sum() / max(np.sqrt(self.square[x].sum()), 1e-12) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, *, max_counted: int = MAX_COUNTED, max_train: int = MAX_TRAIN) -> Model | float:
    """The fitted model, or the share of label 1 where there is only one kind."""
    chosen = training_labels(labels, max_counted)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_counted short rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Indicators()
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "doc_id": pdf["doc_id"], "y": pdf["y"], "x": [of(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    last = chosen.orderBy("h", "doc_id").limit(max_train).agg(F.max("h")).head()[0]
    if last is None:
        return 0.5
    rows = sample.filter(F.col("h") <= last).select("h", "doc_id", "text", "y").mapInPandas(run, "h long, doc_id long, y int, x binary").toPandas().sort_values(["h", "doc_id", "x"])
    y = rows["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    ratios = log_count_ratios(sample)
    x = [np.frombuffer(b, np.int32).astype(np.int64) for b in rows["x"]]
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    own = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([x[i] for i in own], 2 * y[own] - 1, ratios)
    model = Model(ratios, w, bias, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else own
    model.a, model.b = calibration(np.array([model.margin(x[i]) for i in test]), y[test])
    return model


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    model = fit(docs, labels, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def worker():
        known, of = shared.value, Indicators()
        return lambda part: [[known if isinstance(known, float) else known.score(of(t)) for t in part.column("text").to_pylist()]]

    scored = add_columns(docs.select("doc_id", "text", (remainder() == 2).alias("held_out")), {"score": (T.DoubleType(), pa.float64())}, worker)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
