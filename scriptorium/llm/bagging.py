"""Bagged decision trees for small dense feature tables, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np

MAX_BINS = 48


class Tree:
    """A binary classification tree by Gini impurity over quantile cuts; nodes lie in flat arrays."""

    def __init__(self, depth: int = 6, least: int = 5, features: np.ndarray | None = None) -> None:
        self.depth, self.least, self.features = depth, least, features
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y, self.depth)
        self.arrays = tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.value))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        for column, value in ((self.feature, -1), (self.cut, 0.0), (self.left, node), (self.right, node), (self.value, float(y.mean()) if len(y) else 0.5)):
            column.append(value)
        split = self._best(x, y) if depth and 0 < y.sum() < len(y) else None
        if split is not None:
            feature, cut = split
            low = x[:, feature] <= cut
            self.feature[node], self.cut[node] = feature, cut
            self.left[node] = self._grow(x[low], y[low], depth - 1)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1)
        return node

    def _best(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        n, ones, best, found = len(y), y.sum(), 2 * y.mean() * (1 - y.mean()) - 1e-9, None
        for feature in range(x.shape[1]) if self.features is None else self.features.tolist():
            values = np.unique(x[:, feature])
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            cuts = np.unique(np.quantile(middles, np.linspace(0, 1, MAX_BINS), method="nearest")) if len(middles) > MAX_BINS else middles
            side = np.searchsorted(cuts, x[:, feature], "left")
            count = np.bincount(side, minlength=len(cuts) + 1).cumsum()[:-1]
            hits = np.bincount(side, y, len(cuts) + 1).cumsum()[:-1]
            ok = (count >= self.least) & (n - count >= self.least)
            if not ok.any():
                continue
            count, hits, cuts = count[ok], hits[ok], cuts[ok]
            p, q = hits / count, (ones - hits) / (n - count)
            impurity = (count * 2 * p * (1 - p) + (n - count) * 2 * q * (1 - q)) / n
            k = int(impurity.argmin())
            if impurity[k] < best:
                best, found = impurity[k], (feature, float(cuts[k]))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = self.arrays
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at]


class BaggedTrees:
    """Trees on bootstrap samples and on a share of the features each; the probability is their mean.

    No feature is then left unlearnt because another one tells the classes of the sample apart by itself.
    """

    def __init__(self, trees: int = 25, depth: int = 6, seed: int = 11, share: float = 1.0) -> None:
        self.n, self.depth, self.seed, self.share = trees, depth, seed, share
        self.trees: list[Tree] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BaggedTrees:
        random = np.random.default_rng(self.seed)
        for _ in range(self.n):
            pick = random.integers(0, len(y), len(y))
            features = np.sort(random.permutation(x.shape[1])[: max(1, round(self.share * x.shape[1]))])
            self.trees.append(Tree(self.depth, features=features).fit(x[pick], y[pick].astype(float)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.mean([t.predict(x) for t in self.trees], axis=0)
