"""A small gradient-boosted tree learner whose model is a DataFrame expression.

Training runs on the driver over a bounded table; scoring is a sum of nested CASE expressions, so it stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf has a value only; elsewhere rows with feature <= cut go left."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    start: float
    trees: tuple[Node, ...]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        return self.start + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, values: dict[str, Column]) -> Column:
        """The same log-odds as an expression over the feature columns."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(float(node.value))
            return F.when(values[self.features[node.feature]] <= F.lit(float(node.cut)), walk(node.left)).otherwise(walk(node.right))

        return sum((walk(t) for t in self.trees), F.lit(float(self.start)))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.left, x), _apply(node.right, x))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: int) -> Node:
    """Newton tree on the logistic loss, split where the gain of the gradient sums is largest."""
    total_g, total_h, ridge = grad.sum(), hess.sum(), 1.0
    leaf = Node(rate * total_g / (total_h + ridge))
    best, found = 1e-6, None
    for f in range(x.shape[1] if depth else 0):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if not len(at):
            continue
        gain = g[at] ** 2 / (h[at] + ridge) + (total_g - g[at]) ** 2 / (total_h - h[at] + ridge) - total_g**2 / (total_h + ridge)
        if gain.max() > best:
            best, k = gain.max(), at[gain.argmax()]
            found = f, (v[k] + v[k + 1]) / 2
    if found is None:
        return leaf
    f, cut = found
    go = x[:, f] <= cut
    return Node(0.0, f, float(cut), _grow(x[go], grad[go], hess[go], depth - 1, rate, least), _grow(x[~go], grad[~go], hess[~go], depth - 1, rate, least))


def fit(features: tuple[str, ...], x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, least: int = 20, precision: float = 0.99) -> Boosted:
    """Fit on the even rows; the threshold is the lowest that reaches ``precision`` on the odd rows."""
    train, held = np.arange(len(x)) % 2 == 0, np.arange(len(x)) % 2 == 1
    share = np.clip(y[train].mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    s, grown = np.full(train.sum(), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        grown.append(_grow(x[train], y[train] - p, p * (1 - p), depth, rate, least))
        s = s + _apply(grown[-1], x[train])
    model = Boosted(features, start, tuple(grown), 0.0)
    s = model.score(x[held])
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
    last_of_score = np.append(s[order][1:] < s[order][:-1], True)
    ok = np.flatnonzero((right >= precision) & last_of_score)
    return Boosted(features, start, tuple(grown), float(s[order][ok[-1]]) if len(ok) else float("inf"))
