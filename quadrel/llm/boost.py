"""Small boosted trees: fitted with numpy on bounded rows, applied as a DataFrame expression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (value,) or (feature, cut, tree up to the cut, tree above it)


class Boosted:
    """Logistic loss, second-order leaf values, exact splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> None:
        self.rate, self.ridge, self.trees = rate, ridge, []
        raw = np.zeros(len(x))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(x, y - p, p * (1 - p), depth)
            self.trees.append(tree)
            raw += _apply(tree, x)

    def _leaf(self, slope: np.ndarray, bend: np.ndarray) -> Tree:
        return (float(self.rate * slope.sum() / (bend.sum() + self.ridge)),)

    def _grow(self, x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int) -> Tree:
        best, total = (1e-3, None, None), slope.sum() ** 2 / (bend.sum() + self.ridge)
        for f in range(x.shape[1]) if depth and len(x) > 8 else ():
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], slope[order].cumsum()[:-1], bend[order].cumsum()[:-1]
            gain = g**2 / (h + self.ridge) + (slope.sum() - g) ** 2 / (bend.sum() - h + self.ridge) - total
            gain[v[1:] <= v[:-1]] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] is None:
            return self._leaf(slope, bend)
        low = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[low], slope[low], bend[low], depth - 1), self._grow(x[~low], slope[~low], bend[~low], depth - 1))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[str]) -> Column:
        """The raw score from columns of these names."""
        return reduce(lambda a, b: a + b, (_column(t, features) for t in self.trees))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _column(tree: Tree, features: list[str]) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(F.col(features[tree[0]]) <= tree[1], _column(tree[2], features)).otherwise(_column(tree[3], features))


def precise_threshold(raw: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on at least this share is positive; if there is none, the first above all scores."""
    order = np.argsort(-raw, kind="stable")
    share = y[order].cumsum() / np.arange(1, len(y) + 1)
    last = np.r_[raw[order][1:] < raw[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(raw[order][good[-1]]) if len(good) else float(np.nextafter(raw.max(), np.inf)) if len(y) else 0.0
