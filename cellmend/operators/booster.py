"""Gradient boosted trees over binned columns (T5, T9, T10), in numpy.

A model learns from a bounded sample of rows (`model.max_training_row_num`), so one task fits
it; the models of several targets are fitted by as many tasks. Columns are binned once; a level
of a tree is found from histograms of all its nodes and columns together.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np

#: The parameters of a search, and from what their values are drawn.
SPACE = {
    "learning_rate": (0.05, 0.1, 0.2, 0.3),
    "max_depth": (3, 4, 5, 6, 8),
    "n_estimators": (30, 60, 100, 200),
    "min_child": (1, 3, 5, 10, 20),
    "min_split_gain": (0.0, 0.01, 0.1),
    "reg_alpha": (0.0, 0.1, 1.0),
    "column_share": (0.5, 0.8, 1.0),
}


@dataclass
class Columns:
    """How columns become bins: numbers at quantiles, texts with few values one by one, others in
    the order of their frequency. Null is bin 0, an unknown text the last."""

    max_bin: int = 255
    small: int = 12
    cuts: list[np.ndarray] = field(default_factory=list)
    values: list[dict[str, int]] = field(default_factory=list)

    def fit(self, numbers: np.ndarray, texts: np.ndarray) -> Columns:
        for x in numbers.T:
            known = np.unique(x[~np.isnan(x)])
            if len(known) > self.max_bin - 1:
                known = np.unique(np.quantile(x[~np.isnan(x)], np.linspace(0, 1, self.max_bin)))
            self.cuts.append((known[1:] + known[:-1]) / 2)
        for x in texts.T:
            found, n = np.unique([v for v in x if v is not None], return_counts=True)
            ordered = [str(found[i]) for i in np.lexsort((found, -n))] if len(found) else []
            self.values.append({v: i for i, v in enumerate(ordered)})
        return self

    def transform(self, numbers: np.ndarray, texts: np.ndarray) -> np.ndarray:
        out = [np.where(np.isnan(x), 0, np.searchsorted(c, x) + 1) for x, c in zip(numbers.T, self.cuts, strict=True)]
        for x, v in zip(texts.T, self.values, strict=True):
            code = np.fromiter((-1 if t is None else v.get(str(t), len(v)) for t in x), np.int64, len(x))
            out += [(code == k).astype(np.int64) for k in range(-1, len(v) + 1)] if len(v) < self.small else [np.minimum(code + 1, 4 * self.max_bin)]
        return np.stack(out, axis=1).astype(np.int32) if out else np.zeros((max(len(numbers), len(texts)), 1), np.int32)


@dataclass
class Tree:
    """Nodes by number: bins up to the cut go left; column -1 is a leaf."""

    column: list[int]
    cut: list[int]
    left: list[int]
    value: list[float]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        column, cut, left, value = (np.array(x) for x in (self.column, self.cut, self.left, self.value))
        at = np.zeros(len(bins), np.int64)
        while (open_ := column[at] >= 0).any():
            i = np.flatnonzero(open_)
            at[i] = left[at[i]] + (bins[i, column[at[i]]] > cut[at[i]])
        return value[at]


def _leaf(g: np.ndarray, h: np.ndarray, alpha: float) -> np.ndarray:
    return -np.sign(g) * np.maximum(np.abs(g) - alpha, 0) / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray, alpha: float) -> np.ndarray:
    return np.maximum(np.abs(g) - alpha, 0) ** 2 / (h + 1.0)


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, p: dict, columns: np.ndarray) -> Tree:
    """A tree of the gradients and second derivatives, level by level."""
    tree, alpha = Tree([-1], [0], [0], [0.0]), p["reg_alpha"]
    own = bins[:, columns]
    size, at = int(own.max(initial=0)) + 1, np.zeros(len(bins), np.int64)
    level = [0]
    sums = {0: (g.sum(), h.sum())}
    for depth in range(p["max_depth"] + 1):
        for node in level:
            tree.value[node] = float(_leaf(np.array(sums[node][0]), np.array(sums[node][1]), alpha))
        if depth == p["max_depth"] or not level:
            break
        place = np.full(len(tree.column), -1)
        place[level] = np.arange(len(level))
        rows = np.flatnonzero(place[at] >= 0)
        flat = ((place[at[rows]][:, None] * len(columns) + np.arange(len(columns))) * size + own[rows]).ravel()
        shape = (len(level), len(columns), size)
        hist = [np.bincount(flat, np.repeat(x[rows], len(columns)), int(np.prod(shape))).reshape(shape).cumsum(axis=2) for x in (g, h, np.ones(len(g)))]
        gl, hl, nl = hist
        gt, ht, nt = (x[:, :, -1:] for x in hist)
        gain = _gain(gl, hl, alpha) + _gain(gt - gl, ht - hl, alpha) - _gain(gt, ht, alpha)
        gain[(nl < p["min_child"]) | (nt - nl < p["min_child"])] = -np.inf
        best = gain.reshape(len(level), -1).argmax(axis=1)
        after = []
        for k, node in enumerate(level):
            c, cut = divmod(int(best[k]), size)
            if not gain[k, c, cut] > max(p["min_split_gain"], 1e-12):
                continue
            left = len(tree.column)
            for x, new in ((tree.column, -1), (tree.cut, 0), (tree.left, 0), (tree.value, 0.0)):
                x += [new, new]
            tree.column[node], tree.cut[node], tree.left[node] = int(columns[c]), cut, left
            sums[left], sums[left + 1] = (gl[k, c, cut], hl[k, c, cut]), (gt[k, c, 0] - gl[k, c, cut], ht[k, c, 0] - hl[k, c, cut])
            inside = rows[at[rows] == node]
            at[inside] = left + (bins[inside, columns[c]] > cut)
            after += [left, left + 1]
        level = after
    return tree


@dataclass
class Booster:
    """Sums of trees: one for numbers and two classes, one for each class of more."""

    params: dict
    classes: int = 0
    base: np.ndarray = field(default_factory=lambda: np.zeros(1))
    rounds: list[list[Tree]] = field(default_factory=list)

    def _raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += self.params["learning_rate"] * t.predict(bins)
        return out

    def _probabilities(self, raw: np.ndarray) -> np.ndarray:
        if self.classes == 2:
            p = 1 / (1 + np.exp(-np.clip(raw[:, 0], -30, 30)))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 42) -> Booster:
        rand, p = np.random.default_rng(seed), self.params
        n_trees = 1 if self.classes <= 2 else self.classes
        if self.classes:
            share = np.bincount(y.astype(int), weight, self.classes) / weight.sum()
            self.base = np.log(np.maximum(share, 1e-9)) if n_trees > 1 else np.array([np.log(max(share[1], 1e-9) / max(share[0], 1e-9))])
        else:
            self.base = np.array([np.average(y, weights=weight)])
        raw = np.tile(self.base, (len(bins), 1)).astype(float)
        width = max(1, round(bins.shape[1] * p["column_share"]))
        for _ in range(p["n_estimators"]):
            probabilities = self._probabilities(raw) if self.classes else None
            trees = []
            for k in range(n_trees):
                if probabilities is None:
                    g, h = (raw[:, 0] - y) * weight, weight.copy()
                else:
                    q = probabilities[:, 1 if n_trees == 1 else k]
                    g, h = (q - (y == (1 if n_trees == 1 else k))) * weight, np.maximum(q * (1 - q), 1e-6) * weight
                trees.append(grow(bins, g, h, p, np.sort(rand.choice(bins.shape[1], width, replace=False))))
            for k, t in enumerate(trees):
                raw[:, k] += p["learning_rate"] * t.predict(bins)
            self.rounds.append(trees)
        return self

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Numbers, or the classes' probabilities."""
        raw = self._raw(bins)
        return self._probabilities(raw) if self.classes else raw[:, 0]


def score(booster: Booster, bins: np.ndarray, y: np.ndarray) -> float:
    """The mean of the classes' F1, or the negative mean squared error."""
    found = booster.predict(bins)
    if not booster.classes:
        return -float(np.mean((found - y) ** 2))
    best, parts = found.argmax(axis=1), []
    for k in np.unique(y):
        right = np.sum((best == k) & (y == k))
        parts.append(2 * right / max(1, np.sum(best == k) + np.sum(y == k)))
    return float(np.mean(parts))


def validated(params: dict, classes: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int, seed: int) -> float:
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    return float(np.mean([score(Booster(params, classes).fit(bins[fold != k], y[fold != k], weight[fold != k], seed), bins[fold == k], y[fold == k]) for k in range(min(folds, len(y)))]))


def search(params: dict, classes: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, evals: int, folds: int, timeout: float, patience: int, seed: int = 42) -> tuple[dict, int]:
    """The best of `evals` trials over SPACE and how many ran: draws of each parameter, half of
    them from the best trial so far. It ends early after `patience` trials without progress or
    `timeout` seconds (0: none)."""
    rand, began = np.random.default_rng(seed), time.monotonic()
    best, best_score, since, tried = dict(params), -np.inf, 0, 0
    for trial in range(evals):
        drawn = {k: (best[k] if trial and rand.random() < 0.5 else v[rand.integers(len(v))]) for k, v in SPACE.items()} if trial else dict(params)
        tried, value = tried + 1, validated(drawn, classes, bins, y, weight, folds, seed)
        since = 0 if value > best_score else since + 1
        if value > best_score:
            best, best_score = drawn, value
        if since >= patience or (timeout and time.monotonic() - began > timeout):
            break
    return best, tried


def rebalance(numbers: np.ndarray, texts: np.ndarray, y: np.ndarray, seed: int = 42, neighbours: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes brought to the median size: larger ones sampled, smaller ones filled with
    synthetic rows. One is made of a row and its nearest ones of the class: texts by majority,
    numbers between the row and a neighbour."""
    rand, kinds, sizes = np.random.default_rng(seed), *np.unique(y, return_counts=True)
    middle = int(np.median(sizes))
    parts = []
    spread = np.nanstd(numbers, axis=0) if numbers.size else np.ones(numbers.shape[1])
    for kind, size in zip(kinds, sizes, strict=True):
        own = np.flatnonzero(y == kind)
        if size >= middle:
            at = rand.choice(own, middle, replace=False)
            parts.append((numbers[at], texts[at]))
            continue
        start = rand.choice(own, middle - size)
        new_numbers, new_texts = numbers[start].copy(), texts[start].copy()
        for i, s in enumerate(start):
            apart = (texts[own] != texts[s]).sum(axis=1) + np.nansum(np.abs(numbers[own] - numbers[s]) / np.where(spread > 0, spread, 1), axis=1)
            near = own[np.argsort(apart, kind="stable")[: neighbours + 1]]
            other = near[rand.integers(len(near))]
            new_numbers[i] += rand.random() * np.nan_to_num(numbers[other] - numbers[s])
            for c in range(texts.shape[1]):
                values = [v for v in texts[near, c] if v is not None]
                new_texts[i, c] = max(sorted(set(values)), key=values.count) if values else None
        parts.append((np.concatenate([numbers[own], new_numbers]), np.concatenate([texts[own], new_texts])))
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), np.repeat(kinds, [len(a) for a, _ in parts])
