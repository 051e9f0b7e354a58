"""Gradient boosting over counted feature vectors, and trees as SQL expressions.

Features are small integers. A corpus is reduced to its distinct feature vectors with their
numbers of rows and positives, by a DataFrame aggregation over all rows; their number is
bounded by the product of the features' ranges, not by the input. Boosting over these counts
equals boosting over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Cell:
    """Rows that share a feature vector; n may hold rows by weight."""

    features: tuple[int, ...]
    n: float
    positive: float


@dataclass
class Tree:
    """A leaf's value, or a split: feature <= cut goes left."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def __call__(self, x: tuple[int, ...]) -> float:
        if self.left is None or self.right is None:
            return self.value
        return (self.left if x[self.feature] <= self.cut else self.right)(x)

    def sql(self, feature) -> Column:
        if self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(feature(self.feature) <= self.cut, self.left.sql(feature)).otherwise(self.right.sql(feature))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _grow(cells: list[tuple[Cell, float, float]], depth: int, least: float) -> Tree:
    """cells: with their gradients and second derivatives, summed over their rows."""
    g, h = sum(x[1] for x in cells), sum(x[2] for x in cells)
    leaf = Tree(value=g / (h + 1.0))
    if depth == 0 or len(cells) < 2:
        return leaf
    best, base = None, g * g / (h + 1.0)
    for f in range(len(cells[0][0].features)):
        at: dict[int, list[float]] = {}
        for cell, a, b in cells:
            s = at.setdefault(cell.features[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        gl = hl = 0.0
        for cut in sorted(at)[:-1]:
            gl, hl = gl + at[cut][0], hl + at[cut][1]
            if min(hl, h - hl) >= least:
                gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - base
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, cut)
    if best is None:
        return leaf
    _, f, cut = best
    sides = [[x for x in cells if (x[0].features[f] <= cut) == side] for side in (True, False)]
    return Tree(feature=f, cut=cut, left=_grow(sides[0], depth - 1, least), right=_grow(sides[1], depth - 1, least))


@dataclass
class Boosted:
    """A sum of trees, in log odds, and the log odds from which precision is reached."""

    base: float
    trees: list[Tree]
    threshold: float = math.inf

    def __call__(self, x: tuple[int, ...]) -> float:
        return self.base + sum(t(x) for t in self.trees)

    def sql(self, feature) -> Column:
        """The log odds; feature(k) is the column of feature k."""
        return sum((t.sql(feature) for t in self.trees), F.lit(self.base))

    def calibrate(self, cells: list[Cell], precision: float) -> None:
        """Sets the lowest threshold at and above which `precision` of these rows, and of a negative
        one more, are positive; none below even odds, whatever stands above it."""
        self.threshold, n, positive = math.inf, 1.0, 0.0
        scored = sorted(((self(c.features), c) for c in cells), key=lambda x: -x[0])
        for k, (score, c) in enumerate(scored):
            if score < 0:
                break
            n, positive = n + c.n, positive + c.positive
            if (k + 1 == len(scored) or scored[k + 1][0] < score) and positive >= precision * n:
                self.threshold = score


def boost(cells: list[Cell], rounds: int = 20, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> Boosted | None:
    """None of no rows or no positive one; where all are positive, no trees are grown."""
    n, positive = sum(c.n for c in cells), sum(c.positive for c in cells)
    if not positive > 0:
        return None
    model = Boosted(math.log((positive + 0.5) / (n - positive + 0.5)), [])
    if positive >= n:
        return model
    score = {c.features: model.base for c in cells}
    for _ in range(rounds):
        parts = []
        for c in cells:
            p = _sigmoid(score[c.features])
            parts.append((c, c.positive - c.n * p, c.n * p * (1 - p)))
        tree = _grow(parts, depth, least)
        _scale(tree, rate)
        model.trees.append(tree)
        for c in cells:
            score[c.features] += tree(c.features)
    return model


def _scale(tree: Tree, rate: float) -> None:
    tree.value *= rate
    for t in (tree.left, tree.right):
        if t is not None:
            _scale(t, rate)
