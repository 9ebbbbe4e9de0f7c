"""Per-row feature attributions: Shapley values of any scored model."""
from __future__ import annotations

import json
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int


def coalitions(d: int, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of the proper, non-empty feature subsets to score.

    All 2^d - 2 with their kernel weights where that is at most ``most``;
    else ``most`` drawn by size in proportion to the kernel, each beside its
    complement, and weighted by how often they were drawn."""
    if 2 ** min(d, 60) - 2 <= most:
        masks = [[int(j in s) for j in range(d)] for k in range(1, d) for s in combinations(range(d), k)]
        masks = np.array(masks, np.int64).reshape(-1, d)
        size = masks.sum(1)
        return masks, np.array([(d - 1) / (comb(d, int(k)) * k * (d - k)) for k in size])
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, d)
    chance = 1.0 / (sizes * (d - sizes))
    masks = np.zeros((2 * (most // 2), d), np.int64)
    for i, k in enumerate(rng.choice(sizes, most // 2, p=chance / chance.sum())):
        masks[2 * i, rng.permutation(d)[:k]] = 1
        masks[2 * i + 1] = 1 - masks[2 * i]
    masks, drawn = np.unique(masks, axis=0, return_counts=True)
    return masks, drawn.astype(float)


def attribution_weights(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(d, coalitions + 2): attributions as a linear map of the coalitions' values.

    The weighted least squares fit of v(S) = v(none) + sum of the attributions
    in S, under the condition that all of them add up to v(all) - v(none), is
    linear in the values; the last two columns belong to v(none) and v(all)."""
    n, d = masks.shape
    if d == 1:
        return np.array([[0.0] * n + [-1.0, 1.0]])
    x = (masks[:, :-1] - masks[:, -1:]).astype(float)
    last = masks[:, -1].astype(float)
    # y = v(S) - v(none) - last * (v(all) - v(none))
    y = np.hstack([np.eye(n), (last - 1)[:, None], -last[:, None]])
    xw = x.T * weights
    head = np.linalg.lstsq(xw @ x, xw @ y, rcond=None)[0]
    whole = np.zeros(n + 2)
    whole[-2:] = -1, 1
    return np.vstack([head, whole - head.sum(0)])


def background(df: DataFrame, id_col: str, features, rows: int, salt: str = "background") -> list[tuple]:
    """At most ``rows`` rows that stand for absent features: the first by hash of the
    id, of those without a null feature."""
    whole = df.dropna(subset=list(features))
    return [tuple(map(float, r)) for r in
            whole.orderBy(hash_int(id_col, salt), id_col).limit(rows).select(*features).collect()]


def shapley(df: DataFrame, id_col: str, features, score: Column, base_rows: list[tuple],
            most: int = 2048, out: str = "phi_") -> DataFrame:
    """Shapley values of ``score`` (an expression over ``features``) per row.

    v(S) is the mean score with the features in S from the row and the others
    from each of ``base_rows`` (a bounded list, see ``background``).  Every row
    meets all coalitions and base rows inside its own task; since attributions
    are a linear map of the values, one partial sum per feature is all that is
    shuffled (one row per id).  Returns id, base (the mean score of the base
    rows), prediction and one column ``out`` + feature each; they add up to
    prediction - base.  Exact up to ``most`` coalitions (11 features), a
    weighted least squares estimate beyond.

    ``id_col`` is to be unique.  A row with a null feature, or that scores
    null anywhere, has null results; no base rows give nulls."""
    features = list(features)
    masks, weights = coalitions(len(features), most)
    linear = attribution_weights(masks, weights)
    subsets = np.vstack([masks, np.zeros((1, len(features)), np.int64), np.ones((1, len(features)), np.int64)])
    kinds = [0] * len(masks) + [1, 2]
    told = json.dumps([{"use": s.tolist(), "w": w.tolist(), "kind": k} for s, w, k in zip(subsets, linear.T, kinds)])
    held = json.dumps([list(b) for b in base_rows])
    asked = F.from_json(F.lit(told), "array<struct<use array<int>, w array<double>, kind int>>")
    bases = F.from_json(F.lit(held), "array<array<double>>")
    own = [F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(features)]
    met = (df.select(F.col(id_col).alias("__id"), *own)
           .select("*", F.explode(asked).alias("__s"))
           .select("*", F.explode_outer(bases).alias("__b")))
    sound = ~F.greatest(*[F.col(f"__x{j}").isNull() for j in range(len(features))], F.lit(False))
    mixed = met.select("__id", "__s", sound.alias("__sound"), *[
        F.when(F.col("__s.use")[j] == 1, F.col(f"__x{j}")).otherwise(F.col("__b")[j]).alias(f)
        for j, f in enumerate(features)])
    mean = 1.0 / max(len(base_rows), 1)
    scored = mixed.select("__id", "__s", "__sound", score.cast("double").alias("__v"))
    v = F.col("__v") * mean
    whole = F.count("__v") == len(subsets) * len(base_rows) if base_rows else F.lit(False)
    found = scored.groupBy("__id").agg(
        (F.min("__sound") & whole).alias("__whole"),
        F.sum(F.when(F.col("__s.kind") == 1, v)).alias("base"),
        F.sum(F.when(F.col("__s.kind") == 2, v)).alias("prediction"),
        *[F.sum(F.col("__s.w")[j] * v).alias(out + f) for j, f in enumerate(features)])
    return found.select(F.col("__id").alias(id_col), *[
        F.when(F.col("__whole"), F.col(c)).alias(c) for c in ["base", "prediction", *[out + f for f in features]]])


def mean_attributions(found: DataFrame, features, out: str = "phi_") -> DataFrame:
    """(feature, mean_abs, mean): the attributions of all rows in one aggregate, largest first."""
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(out + f).alias("phi")) for f in features]))
    return (found.select(long.alias("r")).groupBy("r.feature")
            .agg(F.avg(F.abs("r.phi")).alias("mean_abs"), F.avg("r.phi").alias("mean"))
            .orderBy(F.desc("mean_abs"), "feature"))
