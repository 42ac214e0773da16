"""Gradient-boosted trees: logistic loss, histogram splits, complete trees of a given depth.

A tree's level is chosen from sums of gradients by feature, node and bin over all rows. Rows may be an array, or a table
whose tasks send their sums: no row leaves them, and a task's sums have a fixed size. Gradients are whole steps of
2**-STEPS, so that sums are exact and don't depend on how rows are laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STEPS = 20


def each_task(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of an array of fixed size that ``work`` makes of bins, labels and weights; rows: x binary (a byte a feature),
    y boolean, n long. Each task adds up its own before it sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in batches:
            if part.num_rows:
                b = np.frombuffer(b"".join(part.column("x").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                found = work(b, part.column("y").to_numpy(zero_copy_only=False).astype(bool), part.column("n").to_numpy().astype(float))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int64()))], names=["m", "shape"])

    return sum(np.frombuffer(r["m"]).reshape(r["shape"]) for r in rows.select("x", "y", "n").mapInArrow(run, "m binary, shape array<long>").collect())


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, cuts: list[np.ndarray] | None = None):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.cuts = trees, depth, rate, bins, ridge, cuts
        self.start, self.forest = 0.0, []

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value, up to the first cut that it doesn't exceed."""
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    @staticmethod
    def _node(b: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for pick in splits:
            node = node * 2 + (b[rows, pick[node, 0]] > pick[node, 1])
        return node

    def sums(self, b: np.ndarray, y: np.ndarray, n: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
        """Sums of gradients and of curvatures, by feature, node below ``splits``, and bin."""
        p, node, width = self.predict_binned(b), self._node(b, splits), 2 ** len(splits)
        g, h = (np.rint(v * 2.0**STEPS) / 2.0**STEPS * n for v in (y - p, p * (1 - p)))
        key, size = node * (self.bins + 1), width * (self.bins + 1)
        both = [[np.bincount(key + b[:, j], v, size).reshape(width, -1) for j in range(b.shape[1])] for v in (g, h)]
        return np.array(both)

    def grow(self, share: float, gather: Callable[[list[np.ndarray]], np.ndarray]) -> BoostedTrees:
        """``share`` of label 1; ``gather`` gives ``sums`` over all rows."""
        p = np.clip(share, 1e-3, 1 - 1e-3)
        self.start, self.forest = float(np.log(p / (1 - p))), []
        for _ in range(self.trees):
            splits: list[np.ndarray] = []
            for level in range(self.depth):
                width = 2**level
                best, pick, nodes = np.full(width, 1e-9), np.tile([0, self.bins], (width, 1)), np.arange(width)
                below, curved = gather(splits).cumsum(-1)
                for j, (gs, hs) in enumerate(zip(below, curved, strict=True)):
                    left, right = gs[:, :-1] ** 2 / (hs[:, :-1] + self.ridge), (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + self.ridge)
                    gain = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    at = gain.argmax(1)
                    top = gain[nodes, at]
                    won = top > best + 1e-9
                    best[won], pick[won] = top[won], np.stack([np.full(width, j), at], 1)[won]
                splits.append(pick)
            g, h = (np.stack([x[pick[:, 0], nodes, pick[:, 1]], x[0, :, -1] - x[pick[:, 0], nodes, pick[:, 1]]], 1).ravel() for x in (below, curved))
            self.forest.append((splits, self.rate * g / (h + self.ridge)))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.asarray(x, float)
        if self.cuts is None:
            self.cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins)[1:-1], method="lower")) for j in range(x.shape[1])]
        b, n = self.binned(x), np.ones(len(x))
        return self.grow(y.mean(), lambda splits: self.sums(b, y, n, splits))

    def fit_table(self, rows: DataFrame, share: float) -> BoostedTrees:
        """From all rows of a table (x, y, n), as ``each_task`` reads them."""
        return self.grow(share, lambda splits: each_task(rows, lambda b, y, n: self.sums(b, y, n, splits)))

    def predict_binned(self, b: np.ndarray) -> np.ndarray:
        f = np.full(len(b), self.start)
        for splits, leaf in self.forest:
            f += leaf[self._node(b, splits)]
        return 1 / (1 + np.exp(-f))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_binned(self.binned(np.asarray(x, float))) if len(x) else np.zeros(0)
