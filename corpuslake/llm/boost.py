"""Gradient-boosted trees and logistic regression, in numpy or over all rows of a table.

``fit_trees`` and ``fit_logistic`` take a table of examples: ``x`` (the figures as
``written``), ``y`` and ``n``, how often the example occurs. Equal examples are merged.
What is left is summed up on the driver if it has few rows, else by the tasks, a job for
each level of a tree or step of the regression; both ways give the same trees, since
gradients are summed as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.session import cut_lineage

#: Figures are written in steps of 1 / GRID. Merged examples that the driver sums up; beyond it the tasks do. Bins, steps of a gradient.
GRID, MOST_ROWS, WIDE, FINE = 64, 300_000, 33, 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Binary logistic boosting; every tree splits all nodes of a level by histograms of at most 32 bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, shrink: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.shrink = trees, depth, rate, bins, shrink
        self.base, self.edges, self.model, self.grid = 0.0, [], [], 0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(f)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            q = _sigmoid(score)
            g, h = y - q, q * (1 - q)
            node = np.zeros(n, np.int64)
            levels = []
            for level in range(self.depth):
                k = 1 << level
                split = np.zeros((k, 2), np.int64)
                best = np.full(k, 1e-6)
                total_g, total_h = np.bincount(node, g, k), np.bincount(node, h, k)
                for j in range(f):
                    w = len(self.edges[j]) + 1
                    cg = np.bincount(node * w + b[:, j], g, k * w).reshape(k, w).cumsum(axis=1)[:, :-1]
                    ch = np.bincount(node * w + b[:, j], h, k * w).reshape(k, w).cumsum(axis=1)[:, :-1]
                    if not cg.shape[1]:
                        continue
                    rg, rh = total_g[:, None] - cg, total_h[:, None] - ch
                    gain = cg**2 / (ch + self.shrink) + rg**2 / (rh + self.shrink) - (total_g**2 / (total_h + self.shrink))[:, None]
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(k), at] > best
                    best = np.where(better, gain[np.arange(k), at], best)
                    split[better] = np.stack([np.full(k, j), at + 1], axis=1)[better]
                levels.append(split)
                node = 2 * node + (b[np.arange(n), split[node, 0]] >= split[node, 1])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + self.shrink)
            self.model.append((levels, leaf))
            score += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if self.grid:
            x = np.rint(x * self.grid) / self.grid
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for levels, leaf in self.model:
            node = np.zeros(len(x), np.int64)
            for split in levels:
                node = 2 * node + (b[rows, split[node, 0]] >= split[node, 1])
            score += leaf[node]
        return _sigmoid(score)


class Logistic:
    def __init__(self, steps: int = 300, rate: float = 0.5, ridge: float = 1e-3):
        self.steps, self.rate, self.ridge = steps, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            self.w += self.rate * (z.T @ (y - _sigmoid(z @ self.w)) / len(y) - self.ridge * self.w)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.hstack([(x - self.mean) / self.spread, np.ones((len(x), 1))]) @ self.w) if len(x) else np.zeros(0)


def written(x: list[float]) -> str:
    return ",".join([str(round(v * GRID)) for v in x])


def _read(x: pd.Series) -> np.ndarray:
    return np.array([v.split(",") for v in x], np.int64)


def _merged(examples: DataFrame) -> tuple[DataFrame, dict[float, int]]:
    rows = cut_lineage(examples.groupBy("x", "y").agg(F.sum("n").alias("n")))
    return rows, {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}


def _cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """The quantiles of every figure over all rows, from the counts of its values."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, n = _read(b["x"]), b["n"].to_numpy(float)
                for j in range(x.shape[1]):
                    value, at = np.unique(x[:, j], return_inverse=True)
                    yield pd.DataFrame({"j": j, "value": value, "n": np.bincount(at, n).astype(np.int64)})

    found = rows.mapInPandas(values, "j int, value bigint, n bigint").groupBy("j", "value").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for _, own in found.sort_values(["j", "value"]).groupby("j"):
        up = own["n"].cumsum().to_numpy(float)
        at = np.searchsorted(up, np.linspace(0, 1, bins + 1)[1:-1] * up[-1])
        out.append(np.unique(own["value"].to_numpy()[at]) / GRID)
    return out


def _sums(b: np.ndarray, score: np.ndarray, node: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """(g or h, figure, node, bin): the summed gradients, as whole numbers."""
    q = _sigmoid(score)
    at = [np.bincount(node * WIDE + b[:, j], np.rint(v * weight * FINE), k * WIDE) for v in (y - q, q * (1 - q)) for j in range(b.shape[1])]
    return np.array(at).reshape(2, b.shape[1], k, WIDE)


def _down(b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for split in levels:
        node = 2 * node + (b[rows, split[node, 0]] >= split[node, 1])
    return node


def fit_trees(examples: DataFrame, trees: int = 60, even: bool = False, most: int = MOST_ROWS) -> Boosted | None:
    """Boosted trees over all examples, none if they are of one kind; with ``even`` both kinds weigh the same."""
    rows, classes = _merged(examples)
    if len(classes) < 2:
        return None
    fitted, total = Boosted(trees), sum(classes.values())
    fitted.grid, fitted.edges = GRID, _cuts(rows, fitted.bins)
    share = {y: total / (2 * n) if even else 1.0 for y, n in classes.items()}
    mean = sum(y * n * share[y] for y, n in classes.items()) / sum(n * share[y] for y, n in classes.items())
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    fitted.base, edges, figures = float(np.log(mean / (1 - mean))), fitted.edges, len(fitted.edges)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _read(b["x"]) / GRID if len(b) else np.zeros((0, figures))
            at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"b": [r.tobytes() for r in at], "y": b["y"], "n": b["n"]}).astype({"b": "object"})

    rows = cut_lineage(rows.mapInPandas(binned, "b binary, y double, n bigint").groupBy("b", "y").agg(F.sum("n").alias("n")))

    def unpacked(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = p["y"].to_numpy(float)
        return np.frombuffer(b"".join(p["b"]), np.uint8).reshape(len(p), figures).astype(np.int64), y, p["n"].to_numpy(float) * np.array([share[v] for v in y])

    local = rows.count() <= most
    if local:
        b, y, weight = unpacked(rows.toPandas())
        score = np.full(len(b), fitted.base)

    def summed(levels: list[np.ndarray], k: int) -> np.ndarray:
        if local:
            return _sums(b, score, _down(b, levels), y, weight, k)
        base, model = fitted.base, list(fitted.model)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((2, figures, k, WIDE))
            for p in batches:
                if len(p):
                    b, y, weight = unpacked(p)
                    score = np.full(len(b), base)
                    for before, leaf in model:
                        score += leaf[_down(b, before)]
                    out += _sums(b, score, _down(b, levels), y, weight, k)
            at = np.flatnonzero(out)
            yield pd.DataFrame({"at": at, "v": out.ravel()[at]})

        found = rows.mapInPandas(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(2 * figures * k * WIDE)
        out[found["at"].to_numpy(int)] = found["v"]
        return out.reshape(2, figures, k, WIDE)

    for _ in range(fitted.trees):
        levels: list[np.ndarray] = []
        for level in range(fitted.depth):
            k = 1 << level
            g, h = summed(levels, k) / FINE
            all_g, all_h = g[0].sum(axis=1), h[0].sum(axis=1)
            left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            right_g, right_h = all_g[None, :, None] - left_g, all_h[None, :, None] - left_h
            gain = left_g**2 / (left_h + fitted.shrink) + right_g**2 / (right_h + fitted.shrink) - (all_g**2 / (all_h + fitted.shrink))[None, :, None]
            gain = gain.transpose(1, 0, 2).reshape(k, -1)
            best = gain.argmax(axis=1)
            found = gain[np.arange(k), best] > 1e-6
            j, at = np.divmod(best, WIDE - 1)
            levels.append(np.where(found[:, None], np.stack([j, at + 1], axis=1), 0))
        # A node that isn't split hands all it has to its right child.
        own_g, own_h = np.where(found, left_g[j, np.arange(k), at], 0), np.where(found, left_h[j, np.arange(k), at], 0)
        leaf = fitted.rate * np.stack([own_g, all_g - own_g], axis=1).ravel() / (np.stack([own_h, all_h - own_h], axis=1).ravel() + fitted.shrink)
        if local:
            score += leaf[_down(b, levels)]
        fitted.model.append((levels, leaf))
    return fitted


def fit_logistic(examples: DataFrame, most: int = MOST_ROWS, steps: int = 12) -> Logistic | None:
    """Logistic regression over all examples by Newton's steps, none if they are of one kind."""
    rows, classes = _merged(examples)
    if len(classes) < 2:
        return None
    fitted, total = Logistic(), sum(classes.values())
    kept = rows.toPandas().sort_values(["x", "y"]) if rows.count() <= most else None

    def summed(f) -> np.ndarray:
        part = lambda p: f(_read(p["x"]) / GRID, p["y"].to_numpy(float), p["n"].to_numpy(float))
        if kept is not None:
            return part(kept)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    yield pd.DataFrame({"at": np.arange(part(p).size), "v": part(p).ravel()})

        found = rows.mapInPandas(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
        return found["v"].to_numpy()

    once, twice = summed(lambda x, y, n: np.stack([n @ x, n @ (x * x)])).reshape(2, -1) / total
    fitted.mean, fitted.spread = once, np.sqrt(np.maximum(twice - once**2, 0)) + 1e-6
    fitted.w = np.zeros(len(once) + 1)

    def step(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        z, p = np.hstack([(x - fitted.mean) / fitted.spread, np.ones((len(x), 1))]), fitted.predict(x)
        return np.vstack([z.T @ (z * (n * p * (1 - p))[:, None]), (n * (y - p)) @ z])

    for _ in range(steps):
        s = summed(step).reshape(-1, len(fitted.w)) / total
        fitted.w = fitted.w + np.linalg.solve(s[:-1] + fitted.ridge * np.eye(len(fitted.w)), s[-1] - fitted.ridge * fitted.w)
    return fitted
