"""Kernel classifiers by explicit features, a whole grid fitted together (K9).

Each kernel becomes a feature map of bounded width:

rbf      random Fourier features, cos(w.x + b)
poly     tensor sketch: count sketches of the factors, multiplied in the
         frequency domain (Pham & Pagh 2013)
sigmoid  landmark (Nystroem) features: kernel values against landmark rows,
         whitened by the positive part of the landmarks' own kernel matrix

On the features a linear classifier with squared hinge loss is fitted,

    |w|^2 / 2 + C * sum max(0, 1 - y f(x))^2,   y = -1 or 1,  bias not penalised,

by Newton steps.  All cells of a grid and all folds take a step in one pass
over packed blocks; a pass returns for each fit still moving the moments of
its active rows, numbers whose count depends on the grid and the width alone.
Rows with a null feature or label take no part.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int
from quarry.operators.learn import _packed


PART = 1 << 14          # rows whose features are made together


@dataclass(frozen=True)
class Fourier:
    """exp(-gamma |x - z|^2)"""
    w: Any
    b: Any

    @classmethod
    def draw(cls, d: int, width: int, gamma: float, seed: int = 42):
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width))

    def __call__(self, x):
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


@dataclass(frozen=True)
class TensorSketch:
    """(gamma x.z + coef0)^degree"""
    sketches: Any           # degree x (features + 1) x width, one +-1 in each row
    scale: float
    tail: float

    @classmethod
    def draw(cls, d: int, width: int, gamma: float, degree: int = 3, coef0: float = 0.0, seed: int = 42):
        rng = np.random.default_rng(seed)
        sketches = np.zeros((degree, d + 1, width))
        slots, signs = rng.integers(0, width, (degree, d + 1)), rng.choice([-1.0, 1.0], (degree, d + 1))
        np.put_along_axis(sketches, slots[:, :, None], signs[:, :, None], axis=2)
        return cls(sketches, float(np.sqrt(gamma)), float(np.sqrt(coef0)))

    def __call__(self, x):
        own = np.hstack([self.scale * x, np.full((len(x), 1), self.tail)])
        product = np.prod([own @ np.fft.rfft(s, axis=1) for s in self.sketches], axis=0)
        return np.fft.irfft(product, n=self.sketches.shape[2], axis=1)


@dataclass(frozen=True)
class Landmarks:
    """tanh(gamma x.z + coef0), which is no positive kernel: its positive part."""
    points: Any
    whiten: Any
    gamma: float
    coef0: float

    @classmethod
    def of(cls, points: np.ndarray, gamma: float, coef0: float = 0.0):
        values, vectors = np.linalg.eigh(np.tanh(gamma * points @ points.T + coef0))
        keep = values > 1e-9 * max(np.abs(values).max(initial=0), 1e-300)
        return cls(points, vectors[:, keep] / np.sqrt(values[keep]), gamma, coef0)

    def __call__(self, x):
        return np.tanh(self.gamma * x @ self.points.T + self.coef0) @ self.whiten


def kernel_value(features, point, kind: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> Column:
    """The exact kernel between each row and a given point."""
    inner = reduce(add, [F.col(c) * F.lit(float(v)) for c, v in zip(features, point)])
    if kind == "rbf":
        return F.exp(-gamma * reduce(add, [(F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(features, point)]))
    return (gamma * inner + coef0) ** degree if kind == "poly" else F.tanh(gamma * inner + coef0)


def landmark_rows(df: DataFrame, features, id_col: str, count: int, salt: str = "landmark") -> np.ndarray:
    """``count`` rows with all features present, chosen by a hash of the id."""
    rows = (df.dropna(subset=list(features)).select(hash_int(id_col, salt).alias("h"), F.col(id_col).alias("i"),
                                                    *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)])
            .orderBy("h", "i").limit(count).collect())
    return np.array([list(r)[2:] for r in rows], float).reshape(len(rows), len(features))


def gammas(df: DataFrame, features, names) -> dict:
    """Numbers of the names: ``scale`` is 1 / (features * variance of all entries), ``auto`` 1 / features."""
    d = len(features)
    sums = df.dropna(subset=list(features)).agg(
        F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.var_pop)]).first()
    mean, var = (np.array([x or 0.0 for x in sums[i::2]]) for i in (1, 2))
    whole = float((var + mean ** 2).mean() - mean.mean() ** 2) if d else 0.0
    fixed = {"scale": 1.0 / (d * whole) if whole > 0 else 1.0, "auto": 1.0 / d}
    return {g: fixed.get(g, g) for g in names}


def _with_bias(z):
    return np.hstack([z, np.ones((len(z), 1))])


def _block_moments(z, sign, f, weights, held):
    """Z'Z and Z'y of each fit's active training rows, and their loss.

    The fits of a map differ in cost and fold alone, so most of their rows are
    active in all: products are made once for each fold of a fit in the
    middle, and each fit adds or takes away the rows in which it differs."""
    folds = np.unique(f)
    gap = np.maximum(1.0 - sign * (weights.T @ z.T), 0.0)       # (fits, rows)
    active = gap > 0
    base = active[active.sum(1).argsort()[len(active) // 2]]
    of, of_fold = {}, {fold: f == fold for fold in folds}
    for fold in folds:
        rows = np.flatnonzero(base & of_fold[fold])
        part = z[rows]
        of[fold] = part.T @ part, sign[rows] @ part
    whole = [reduce(add, part) for part in zip(*of.values())] if of else None
    for j, fold in enumerate(held):
        other = active[j] != base
        if fold in of:
            gap[j, of_fold[fold]] = 0.0
            other &= ~of_fold[fold]
        rows = np.flatnonzero(other)
        zz, zy = (a - b for a, b in zip(whole, of[fold])) if fold in of else (x.copy() for x in whole)
        for rows, way in ((rows[~base[rows]], 1.0), (rows[base[rows]], -1.0)):
            if len(rows):
                part = z[rows]
                zz, zy = zz + way * (part.T @ part), zy + way * (sign[rows] @ part)
        yield [zz, zy, float(gap[j] @ gap[j])]


def _moments(blocks, maps, fits, weights, live):
    """Per live fit: Z'Z and Z'y of its active training rows, and their loss."""
    wanted: dict[int, list[int]] = {}
    for k in live:
        wanted.setdefault(fits[k][0], []).append(k)

    def add_up(part):
        total: dict[int, list] = {}
        for x, y, f in part:
            sign = 2.0 * (y > 0) - 1.0
            if not len(x):
                continue
            for m, ks in wanted.items():
                for a in range(0, len(x), PART):
                    at = slice(a, a + PART)
                    z = _with_bias(maps[m](x[at]))
                    found = _block_moments(z, sign[at], f[at], np.stack([weights[k] for k in ks], 1), [fits[k][2] for k in ks])
                    for k, own in zip(ks, found):
                        total[k] = own if k not in total else [p + q for p, q in zip(total[k], own)]
        yield total

    def merge(a, b):
        return {k: [p + q for p, q in zip(a[k], b[k])] if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}
    return blocks.mapPartitions(add_up).treeReduce(merge)


def fit_together(blocks, maps, fits, widths, passes: int = 40, tol: float = 1e-6) -> list[np.ndarray]:
    """Weights (bias last) of every fit (map number, C, held-out fold).

    A Newton step solves the ridge problem of the active rows; a step that
    does not lower the loss is halved."""
    weights = [np.zeros(widths[m] + 1) for m, _, _ in fits]
    before: list = [None] * len(fits)       # (weights, loss) the step started from
    live = list(range(len(fits)))
    for _ in range(passes):
        found = _moments(blocks, maps, fits, weights, live)
        still = []
        for k in live:
            c, w = fits[k][1], weights[k]
            if k not in found:
                continue
            zz, zy, loss = found[k]
            ridge = np.ones(len(w))
            ridge[-1] = 0.0
            loss = 0.5 * float((ridge * w * w).sum()) + c * loss
            if before[k] is not None and loss > before[k][1] * (1 + 1e-12):
                if np.abs(w - before[k][0]).max() <= tol * max(1.0, np.abs(w).max()):
                    weights[k] = before[k][0]
                else:
                    weights[k] = (w + before[k][0]) / 2
                    still.append(k)
                continue
            gradient = ridge * w + 2 * c * (zz @ w - zy)
            before[k] = (w, loss)
            if np.abs(gradient).max() <= tol * max(1.0, 2 * c * np.abs(zy).max()):
                continue
            weights[k] = np.linalg.solve(np.diag(ridge + 1e-9) + 2 * c * zz, 2 * c * zy)
            still.append(k)
        live = still
        if not live:
            break
    return [w if b is None or k not in live else b[0] for k, (w, b) in enumerate(zip(weights, before))]


def kernel_maps(df: DataFrame, features, id_col: str, kernels, gamma_names, width: int, degree: int = 3,
                coef0: float = 0.0, seed: int = 42) -> dict:
    """{(kernel, gamma name): feature map}"""
    d, numbers = len(features), gammas(df, features, gamma_names)
    points = landmark_rows(df, features, id_col, width) if "sigmoid" in kernels else None
    make = {"rbf": lambda g: Fourier.draw(d, width, g, seed),
            "poly": lambda g: TensorSketch.draw(d, width, g, degree, coef0, seed),
            "sigmoid": lambda g: Landmarks.of(points, g, coef0)}
    return {(k, g): make[k](numbers[g]) for k in kernels for g in gamma_names}


def kernel_grid(df: DataFrame, features, label: str, id_col: str, fold: str, kernels=("rbf", "poly", "sigmoid"),
                gamma_names=("scale", "auto", 0.1, 0.01, 0.001), costs=(0.1, 1, 10, 100, 1000), width: int = 64) -> DataFrame:
    """Mean accuracy over the folds of every cell: (kernel, gamma, cost, accuracy, best).

    Each fold is scored by the fit without it; ties go to the cell first in the grid."""
    features = list(features)
    named = kernel_maps(df, features, id_col, kernels, gamma_names, width)
    maps = list(named.values())
    widths = [m(np.zeros((1, len(features)))).shape[1] for m in maps]
    folds = [int(r[0]) for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
    fits = [(m, float(c), f) for m in range(len(maps)) for c in costs for f in folds]
    spark, schema = df.sparkSession, "kernel string, gamma string, cost double, accuracy double, best int"
    if not folds:
        return spark.createDataFrame([], schema)
    blocks = _packed(df, features, label, fold)
    try:
        weights = fit_together(blocks, maps, fits, widths)
        of_map = [np.stack([w for w, (m, _, _) in zip(weights, fits) if m == k], 1) for k in range(len(maps))]
        held = np.array([f for _, _, f in fits[:len(costs) * len(folds)]])

        def score(part):
            total = np.zeros((len(maps), 2, len(held)), np.int64)
            for x, y, f in part:
                own = f[:, None] == held
                for k, m in enumerate(maps):
                    right = (_with_bias(m(x)) @ of_map[k] >= 0) == (y[:, None] > 0)
                    total[k] += np.stack([(own & right).sum(0), own.sum(0)])
            yield total
        hits = blocks.mapPartitions(score).treeReduce(np.add)
    finally:
        blocks.unpersist()
    shares = (hits[:, 0] / np.maximum(hits[:, 1], 1)).reshape(len(maps), len(costs), len(folds)).mean(2)
    first = int(shares.argmax())
    rows = [(k, str(g), float(c), float(shares[i, j]), int(i * len(costs) + j == first))
            for i, (k, g) in enumerate(named) for j, c in enumerate(costs)]
    return spark.createDataFrame(rows, schema)
