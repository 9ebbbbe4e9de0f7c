"""Fitted models.

Two kinds of code live here:

* algorithms the reference writes by hand and MLlib lacks — full-batch
  logistic gradient ascent (K1), the gain-ratio decision tree (K4), discrete
  AdaBoost (K7), stacking (K11), permutation importance (K19) — written as
  loops whose every step is one distributed aggregate; only the model state
  (θ, stage weights) lives on the driver;
* thin, explicit configurations of MLlib estimators (K2, K8, K9) with the
  parameters the reference uses.

Boosted trees and forests (K5, K6, K12, K13) are in ``boosting`` and ``forest``.

Iterative loops cut lineage through the shared checkpoint folder.
"""
from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int, sigmoid
from quarry.operators.packs import written
from quarry.plans.ranking import prefix_sums, row_number
from quarry.session import cut_lineage, ship_package


# --------------------------------------------------------------------- K1
def _dot(theta, features) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(t)) * F.col(c) for t, c in zip(theta, features)])


#: Rows of a packed block: one task handles at least one.
BLOCK_ROWS = 1 << 16


#: Rows of a block of a gradient step: what a product makes of them stays in a core's cache.
STEP_ROWS = 4096
#: Rows a task of a gradient step goes through; fewer where all cores would not have a task.
TASK_ROWS = 1 << 23


def _packed(df: DataFrame, features, label: str, fold: str | None, even: bool = False):
    """Rows as an RDD of (matrix, labels, folds), written once to the shared folder.

    A step over it is one small job.  It is an RDD because a step has nothing to plan:
    1000 steps as queries would spend their time in the optimiser.  With ``even``, blocks of a table of more
    than ``BLOCK_ROWS`` rows are small and dealt to a whole number of rounds of all cores, with a fold and a transposed matrix each."""
    d = len(features)
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select(*cols, F.col(label).cast("double").alias("y"), (F.col(fold).cast("long") if fold else F.lit(-1).cast("long")).alias("f"))
    n = rows.count()
    dealt = even and n > BLOCK_ROWS

    def pack(batches):
        held = []

        def block():
            m = np.concatenate(held)
            m = m[~np.isnan(m).any(1)]
            return pd.DataFrame({"n": [len(m)], "m": [m.tobytes()]})
        for pdf in batches:
            held.append(pdf.to_numpy(float, na_value=np.nan))
            if dealt:
                whole = np.concatenate(held)
                cut = len(whole) // STEP_ROWS * STEP_ROWS
                for s in range(0, cut, STEP_ROWS):
                    held = [whole[s:s + STEP_ROWS]]
                    yield block()
                held = [whole[cut:]]
            elif sum(map(len, held)) >= BLOCK_ROWS:
                yield block()
                held = []
        if held and (len(held[0]) or not dealt):
            yield block()

    def arrays(row):
        m = np.frombuffer(row["m"]).reshape(row["n"], d + 2)
        return np.ascontiguousarray(m[:, :d]), m[:, d].copy(), m[:, d + 1].astype(np.int64)

    def by_fold(row):
        x, y, f = arrays(row)
        for g in np.unique(f):
            yield np.ascontiguousarray(x[f == g].T), y[f == g], int(g)
    if dealt:
        cores = df.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(-(-n // BLOCK_ROWS), cores * -(-n // (cores * TASK_ROWS))))
        return cut_lineage(rows.mapInPandas(pack, "n long, m binary").repartition(tasks)).rdd.flatMap(by_fold).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = cut_lineage(rows.coalesce(max(1, -(-n // BLOCK_ROWS))).mapInPandas(pack, "n long, m binary"))
    return blocks.rdd.map(arrays).persist()


def _residuals(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y − σ(θx): (fits, rows).  Beyond 60 from 0, σ is 0 or 1 to 26 digits; where that holds for most, only the rest is worked out."""
    z = theta @ x
    open_ = np.flatnonzero(~((z >= 60) | (z <= -60)))
    if len(open_) > z.size // 4:
        np.negative(z, out=z)
        np.clip(z, -700, 700, out=z)
        np.exp(z, out=z)
        z += 1.0
        np.divide(1.0, z, out=z)
    else:
        inner = 1.0 / (1.0 + np.exp(-z.ravel()[open_]))
        np.greater(z, 0, out=z, casting="unsafe")
        z.ravel()[open_] = inner
    return np.subtract(y, z, out=z)


def _ascend(blocks, d: int, fits, iters: int, theta=None) -> np.ndarray:
    """θ ← θ + α·Xᵀ(y − σ(Xθ)) for all ``fits`` (alpha, held-out fold) at once: (d, fits)."""
    alpha = np.array([a for a, _ in fits])
    held = np.array([f for _, f in fits])
    theta = np.zeros((d, len(fits))) if theta is None else np.array(theta, float).reshape(d, len(fits))
    for _ in range(iters):
        def gradient(part, theta=theta):
            total = np.zeros((d, len(fits)))
            for x, y, f in part:
                if np.ndim(f):                              # a small table's one block: 1000 steps at a large rate amplify the order of its sum
                    p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -700, 700)))
                    total += x.T @ np.where(f[:, None] != held, y[:, None] - p, 0.0)
                else:
                    own = held != f                         # a held-out fold costs its fits nothing
                    total[:, own] += (_residuals(theta.T[own], x, y) @ x.T).T
            yield total
        parts = blocks.mapPartitions(gradient)
        total = sum(parts.collect()) if blocks.getNumPartitions() <= 1024 else parts.treeReduce(np.add)
        theta = theta + alpha * total
    return theta


def logreg_gd(df: DataFrame, features, label: str, alpha: float, iters: int, theta0=None):
    """θ ← θ + α·Xᵀ(y − σ(Xθ)) (summed gradient, no intercept), ``iters``
    full-batch steps; each step is one pass over packed blocks (K1).  Rows
    with nulls take no part."""
    blocks = _packed(df, features, label, None, even=True)
    try:
        return _ascend(blocks, len(features), [(alpha, -2)], iters, theta0)[:, 0].tolist()
    finally:
        blocks.unpersist()


def logreg_gd_cv(df: DataFrame, features, label: str, fold: str, alphas, iters: int) -> DataFrame:
    """:func:`logreg_gd` for every learning rate and fold (K1): fitted on the
    other folds, scored on its own.  All fits take a step together, one matrix
    product a block.  Returns (alpha, fold, accuracy, theta)."""
    folds = [int(r[0]) for r in df.select(fold).distinct().orderBy(fold).collect()]
    fits = [(float(a), f) for a in alphas for f in folds]
    blocks = _packed(df, features, label, fold, even=True)
    try:
        theta = _ascend(blocks, len(features), fits, iters)
        held = np.array([f for _, f in fits])

        def score(block):
            x, y, f = block
            if np.ndim(f):
                own = f[:, None] == held
                return np.stack([(own & ((x @ theta >= 0) == (y[:, None] > 0))).sum(0), own.sum(0)])
            own = held == f
            return np.stack([own * ((theta.T @ x >= 0) == (y > 0)).sum(1), own * len(y)])
        hits, n = blocks.map(score).treeReduce(np.add)
    finally:
        blocks.unpersist()
    rows = [(a, f, float(hits[k] / n[k]), theta[:, k].tolist()) for k, (a, f) in enumerate(fits)]
    return df.sparkSession.createDataFrame(rows, "alpha double, fold int, accuracy double, theta array<double>")


def logreg_predict(df: DataFrame, features, theta, out: str = "prediction") -> DataFrame:
    p = sigmoid(_dot(theta, features))
    return df.withColumn("probability", p).withColumn(out, (p >= 0.5).cast("int"))


# --------------------------------------------------------------------- K4
def _h2(p: Column) -> Column:
    q = F.lit(1.0) - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.log2(p) - q * F.log2(q))


def best_splits(df: DataFrame, features, label: str, node: str = "node") -> DataFrame:
    """Best gain-ratio split per node over every distinct value of every
    feature as threshold (left: x >= t).  Ties: smaller feature index, then
    smaller threshold.  Counts per (node, feature, value) are partial
    aggregates; left-side counts are distributed running sums in descending
    value order.  Returns (node, feature, threshold, gain_ratio) (K4)."""
    pairs = ", ".join(f"{i}, CAST(`{c}` AS double)" for i, c in enumerate(features))
    long = df.selectExpr(f"`{node}` AS node", f"CAST(`{label}` AS int) AS y",
                         f"stack({len(features)}, {pairs}) AS (feature, value)").where(
        F.col("value").isNotNull())
    cnt = long.groupBy("node", "feature", "value").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("y").alias("pos"))
    cum = prefix_sums(cnt, [F.desc("value")], ["n", "pos"], ["node", "feature"],
                      out_cols=["nl", "pl"], rank_col=None)
    # node totals per (node, feature) from the same counts: an equi-join on
    # two keys (never degenerates into a cross join when ``node`` is
    # constant); rows with a null feature value take no part in its split
    # (written, so that a join on a node that holds most rows can still be split at run time)
    tot = cut_lineage(cnt.groupBy("node", "feature").agg(F.sum("n").alias("tot_n"), F.sum("pos").alias("tot_p")))
    j = cum.join(tot, ["node", "feature"])
    N, P, nl, pl = (F.col(c).cast("double") for c in ("tot_n", "tot_p", "nl", "pl"))
    nr, pr = N - nl, P - pl
    gain = _h2(P / N) - (nl / N) * _h2(pl / nl) - (nr / N) * F.coalesce(
        _h2(F.try_divide(pr, nr)), F.lit(0.0))
    fl, fr = nl / N, nr / N
    split_info = F.when((fl == 0) | (fr == 0), F.lit(0.0)).otherwise(
        -fl * F.log2(fl) - fr * F.log2(fr))
    gr = F.when(split_info != 0, gain / split_info).otherwise(F.lit(0.0))
    j = j.withColumn("gr", gr)
    best = F.max_by(F.struct("feature", "value", "gr"),
                    F.struct("gr", (-F.col("feature")).alias("f"), (-F.col("value")).alias("v")))
    return j.groupBy("node").agg(best.alias("b")).select(
        "node", F.col("b.feature").alias("feature"), F.col("b.value").alias("threshold"),
        F.col("b.gr").alias("gain_ratio"))


#: Rows of a node whose subtree one task finishes (with four features some 32 MB; upper levels take jobs each).
NODE_ROWS = 1_000_000

_LN2_HI, _LN2_LO = 6.93147180369123816490e-01, 1.90821492927058770002e-10
_LG = (6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01,
       1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01)


def _ln(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of normal numbers > 0 rounded as ``StrictMath.log`` does, which is what Spark's ``log2``
    divides: splits that are equal but for rounding are told apart alike in tasks and in :func:`best_splits`."""
    bits = np.asarray(x, float).view(np.int64)
    high = (bits >> 32) & 0xFFFFF
    up = (high + 0x95F64) & 0x100000
    k = ((bits >> 52) - 1023 + (up >> 20)).astype(float)
    f = ((bits & 0xFFFFFFFF) | ((high | (up ^ 0x3FF00000)) << 32)).view(float) - 1.0
    near = f * f * (0.5 - 0.33333333333333333 * f)
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (_LG[0] + w * (_LG[2] + w * (_LG[4] + w * _LG[6]))) + w * (_LG[1] + w * (_LG[3] + w * _LG[5]))
    half = 0.5 * f * f
    mid = ((high - 0x6147A) | (0x6B851 - high)) > 0
    far = np.where(mid, np.where(k == 0, f - (half - s * (half + r)), k * _LN2_HI - ((half - (s * (half + r) + k * _LN2_LO)) - f)),
                   np.where(k == 0, f - s * (f - r), k * _LN2_HI - ((s * (f - r) - k * _LN2_LO) - f)))
    close = np.where(f == 0, k * _LN2_HI + k * _LN2_LO, np.where(k == 0, f - near, k * _LN2_HI - ((near - k * _LN2_LO) - f)))
    return np.where((0xFFFFF & (2 + high)) < 3, close, far)


def _log2(x: np.ndarray) -> np.ndarray:
    return _ln(x) / math.log(2.0)


def _entropy(p: np.ndarray) -> np.ndarray:
    out, inside = np.zeros(len(p)), (p > 0) & (p < 1)
    p = p[inside]
    q = 1.0 - p
    out[inside] = -p * _log2(p) - q * _log2(q)
    return out


def _gain_ratio(nl, pl, n, p):
    """Gain ratio of cuts by rows and positives at or above them and in all (as in :func:`best_splits`)."""
    nr, pr = n - nl, p - pl
    with np.errstate(invalid="ignore", divide="ignore"):
        right = np.where(nr > 0, pr / nr, 0.0)
    gain = _entropy(p / n) - (nl / n) * _entropy(pl / nl) - (nr / n) * _entropy(right)
    info, cut = np.zeros(len(nl)), nr > 0
    fl, fr = (nl / n)[cut], (nr / n)[cut]
    info[cut] = -fl * _log2(fl) - fr * _log2(fr)
    return np.divide(gain, info, out=np.zeros(len(nl)), where=info != 0)


def _near_best(nl, pl, n, p, first):
    """Which cuts can be the best of their run (runs begin at ``first``): all whose gain ratio, worked out by counts with a
    plain logarithm, is within the error of that of the run's best.  Both ways of working it out err by less than 1e-13 in
    gain and split information; only cuts within ten times that are worked out as :func:`best_splits` does."""
    def xlog(c):
        return c * np.log2(np.maximum(c, 1.0))
    nr, whole = n - nl, xlog(n)
    left, right = xlog(nl), xlog(nr)
    gain = whole - xlog(p) - xlog(n - p) - (left - xlog(pl) - xlog(nl - pl)) - (right - xlog(p - pl) - xlog(nr - (p - pl)))
    info = whole - left - right
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio, off = gain / info, 1e-12 * n / info
    closed = nr <= 0
    ratio[closed], off[closed] = 0.0, 0.0
    least = np.maximum.reduceat(ratio - off, first)
    return np.flatnonzero(ratio + off >= np.repeat(least, np.diff(np.append(first, len(nl)))))


def grow_gain_ratio(x: np.ndarray, y: np.ndarray, depth: int = 0, max_depth: int | None = None):
    """The tree of :func:`build_tree` over rows of one task, as arrays (depth, place in its depth, feature, threshold,
    gain ratio, n, pos), breadth first; feature -1 in leaves.  ``x`` is (features, rows), NaN for null."""
    d, plain = len(x), bool(np.isin(y, (0, 1)).all())
    orders = [o[~np.isnan(v[o])] for v, o in ((v, np.argsort(-v, kind="stable")) for v in x)]
    place, count, out = np.zeros(len(y), np.int64), 1, []
    alive = np.arange(len(y))
    while True:
        n, pos = np.bincount(place[alive], minlength=count), np.bincount(place[alive], y[alive], count)
        best, cut, feature = np.zeros(count), np.full(count, np.nan), np.full(count, -1)
        open_ = (pos > 0) & (pos < n) if plain else np.ones(count, bool)
        if max_depth is not None and depth >= max_depth:
            open_[:] = False
        alive = alive[open_[place[alive]]]
        for f in range(d):
            o = orders[f][place[orders[f]] >= 0]
            o = o[open_[place[o]]]
            o = orders[f] = o[np.argsort(place[o].astype(np.int16 if count < 32_000 else np.int64), kind="stable")]
            if not len(o):
                continue
            node, v, c = place[o], x[f, o], y[o].cumsum()
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            sizes = np.diff(np.append(starts, len(o)))
            before = np.repeat(np.where(starts > 0, c[starts - 1], 0), sizes)
            ends = np.flatnonzero(np.append((v[1:] != v[:-1]) | (node[1:] != node[:-1]), True))
            nl, pl = (np.arange(len(o)) - np.repeat(starts, sizes) + 1.0)[ends], (c - before)[ends]
            whole, all_ = np.repeat(sizes, sizes)[ends].astype(float), np.repeat(c[starts + sizes - 1], sizes)[ends] - before[ends]
            own = node[ends]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            if plain:
                near = _near_best(nl, pl, whole, all_, first)
                nl, pl, whole, all_, own, ends = (c[near] for c in (nl, pl, whole, all_, own, ends))
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ratio = _gain_ratio(nl, pl, whole, all_)
            top = np.maximum.reduceat(ratio, first)
            hit = np.flatnonzero(ratio == np.repeat(top, np.diff(np.append(first, len(own)))))
            last = hit[np.searchsorted(hit, np.append(first[1:], len(own))) - 1]        # the smallest of equal thresholds
            at = own[first]
            better = top > best[at]
            best[at[better]], cut[at[better]], feature[at[better]] = top[better], v[ends[last]][better], f
        out.append((np.full(count, depth), np.arange(count), feature, cut, np.where(feature >= 0, best, np.nan), n, pos.astype(np.int64)))
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            return [np.concatenate(c) for c in zip(*out)]
        number = np.full(count, -1)
        number[split] = np.arange(len(split))
        kept = alive[number[place[alive]] >= 0]
        of = place[kept]
        place[:] = -1
        with np.errstate(invalid="ignore"):
            place[kept] = 2 * number[of] + ~(x[feature[of], kept] >= cut[of])
        alive, count, depth = kept, 2 * len(split), depth + 1


_TREE_ROWS = "path string, at long, depth int, feature int, threshold double, gain_ratio double, n long, pos long"
VALUE_ROWS = 1 << 19        # rows of a block in the order of a feature's values
_VALUES = "feature int, at long, n long, x binary, y binary"


def _value_blocks(rows: DataFrame, d: int, n: int) -> DataFrame:
    """Rows (x0, ..., _y) once per feature from its largest value down, nulls last, in blocks that stay in place."""
    names = [f"x{i}" for i in range(d)]
    slots = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(slots, -(-n * d // (2 * VALUE_ROWS)))
    copies = (rows.withColumn("feature", F.explode(F.array(*map(F.lit, range(d)))))
              .withColumn("value", -F.element_at(F.array(*names), F.col("feature") + 1)))
    order = [F.col("feature"), F.asc_nulls_last("value"), F.xxhash64(*names, "_y")]         # a frequent value is cut by a hash of the row

    def pack(batches):
        from pyspark import TaskContext
        pid, number, held, size, of = TaskContext.get().partitionId(), 0, [], 0, None

        def block():
            m = np.concatenate(held)
            return pd.DataFrame({"feature": [of], "at": [pid * (1 << 32) + number], "n": [len(m)], "x": [m[:, :d].T.tobytes()], "y": [m[:, d].astype(np.int8).tobytes()]})
        for pdf in batches:
            of_rows, m = pdf["feature"].to_numpy(), pdf[[*names, "_y"]].to_numpy(float, na_value=np.nan)
            for f in np.unique(of_rows):
                part = m[of_rows == f]
                if held and (f != of or size + len(part) > VALUE_ROWS):
                    yield block()
                    held, size, number = [], 0, number + 1
                of, size = int(f), size + len(part)
                held.append(part)
        if held:
            yield block()
    return written(copies.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("feature", *names, "_y").mapInPandas(pack, _VALUES), "values")


def _boxed(batches, boxes, d: int):
    """(feature, at, number of a box, values of the feature, labels, all values) of its rows in each block; a box (low, high) holds
    rows with values of at least ``low`` and not of at least ``high``: a null is in no box above a bound."""
    for pdf in batches:
        for feature, at, n, x, y in pdf.itertuples(index=False):
            x, y = np.frombuffer(x).reshape(d, n), np.frombuffer(y, np.int8)
            for i, (low, high) in enumerate(boxes):
                inside = None
                for f in range(d):
                    for bound, side in ((low[f], True), (high[f], False)):
                        if np.isfinite(bound):
                            here = (x[f] >= bound) == side
                            inside = here if inside is None else inside & here
                if inside is None:
                    yield feature, at, i, x[feature], y, x
                elif inside.any():
                    yield feature, at, i, x[feature, inside], y[inside], x[:, inside]


def _grow_top(rows: DataFrame, d: int, n: int, pos: int, max_depth: int | None, node_rows: int):
    """Upper nodes of :func:`build_tree` over rows that stay in place: (their rows of the tree, [(path, box)] of nodes that a task
    finishes, blocks).  A level is two passes over the blocks: sums, then the best cut of each (block, node)."""
    blocks = _value_blocks(rows, d, n)
    done, small, depth = [], [], 0
    front = [("", (np.full(d, -np.inf), np.full(d, np.inf)), n, pos)]
    while front:
        large, depth_ = [], depth
        for path, box, n_, pos_ in front:
            if not 0 < pos_ < n_ or (max_depth is not None and depth_ >= max_depth):
                done.append((path, 0, depth_, None, None, None, n_, pos_))
            elif n_ <= node_rows:
                small.append((path, box))
            else:
                large.append((path, box, n_, pos_))
        front, boxes = [], [box for _, box, _, _ in large]
        if not large:
            break

        def sums(batches, boxes=boxes):
            for feature, at, i, v, y, _ in _boxed(batches, boxes, d):
                k = len(v) - int(np.isnan(v).sum())                 # nulls come last
                if k:
                    yield pd.DataFrame({"feature": [feature], "at": [at], "i": [i], "n": [k], "pos": [int(y[:k].sum())], "first": [v[0]]})
        before, totals, after = {}, {}, {}
        met = sorted(blocks.mapInPandas(sums, "feature int, at long, i int, n long, pos long, first double").collect(), key=lambda r: r["at"])
        for r in met:                                               # a row a block and node
            own = r["feature"], r["i"]
            before[r["feature"], r["at"], r["i"]] = totals.get(own, (0, 0))
            totals[own] = tuple(a + b for a, b in zip(totals.get(own, (0, 0)), (r["n"], r["pos"])))
        following = {}
        for r in reversed(met):
            after[r["feature"], r["at"], r["i"]] = following.get((r["feature"], r["i"]), math.nan)
            following[r["feature"], r["i"]] = r["first"]

        def cuts(batches, boxes=boxes, before=before, totals=totals, after=after):
            for feature, at, i, v, y, _ in _boxed(batches, boxes, d):
                if (feature, at, i) not in before:
                    continue
                v = v[:len(v) - int(np.isnan(v).sum())]
                spots = np.flatnonzero(v != np.append(v[1:], after[feature, at, i]))        # the last row of a value
                if not len(spots):
                    continue
                (n0, p0), (n_, p_) = before[feature, at, i], map(float, totals[feature, i])
                nl, pl = n0 + spots + 1.0, p0 + y[:len(v)].cumsum(dtype=np.int64)[spots].astype(float)
                whole, all_ = np.full(len(spots), n_), np.full(len(spots), p_)
                near = _near_best(nl, pl, whole, all_, np.zeros(1, np.int64))
                ratio = _gain_ratio(nl[near], pl[near], whole[near], all_[near])
                best = near[np.flatnonzero(ratio == ratio.max())[-1]]                       # the smallest of equal thresholds
                yield pd.DataFrame({"feature": [feature], "i": [i], "ratio": [ratio.max()], "value": [v[spots[best]]], "nl": [int(nl[best])], "pl": [int(pl[best])]})
        best: dict = {}
        for r in blocks.mapInPandas(cuts, "feature int, i int, ratio double, value double, nl long, pl long").collect():
            if r["ratio"] > 0 and (r["i"] not in best or (r["ratio"], -r["feature"], -r["value"]) > best[r["i"]][0]):
                best[r["i"]] = (r["ratio"], -r["feature"], -r["value"]), r
        for i, (path, (low, high), n_, pos_) in enumerate(large):
            if i not in best:
                done.append((path, 0, depth_, None, None, None, n_, pos_))
                continue
            r = best[i][1]
            f, cut = r["feature"], r["value"]
            done.append((path, 0, depth_, f, cut, r["ratio"], n_, pos_))
            inner, outer = low.copy(), high.copy()
            inner[f], outer[f] = cut, cut
            front += [(path + "0", (inner, high), r["nl"], r["pl"]), (path + "1", (low, outer), n_ - r["nl"], pos_ - r["pl"])]
        depth += 1
    return done, small, blocks


def _placed_tree(rows: DataFrame, d: int, n: int, pos: int, max_depth: int | None, node_rows: int, finished) -> DataFrame:
    """The tree's rows: upper nodes grown in place, rows of the others moved to a task each once."""
    done, small, blocks = _grow_top(rows, d, n, pos, max_depth, node_rows)
    tree = rows.sparkSession.createDataFrame(done, _TREE_ROWS)
    if not small:
        return tree
    paths, boxes = [path for path, _ in small], [box for _, box in small]

    def move(batches):
        for _, _, i, _, y, x in _boxed(batches, boxes, d):
            yield pd.DataFrame({"path": [paths[i]], "x": [x.tobytes()], "y": [y.tobytes()]})

    def finish(pdf):
        x = np.concatenate([np.frombuffer(raw).reshape(d, -1) for raw in pdf["x"]], 1)
        return finished(pdf["path"].iat[0], x, np.frombuffer(b"".join(pdf["y"]), np.int8).astype(np.int64))
    moved = blocks.where("feature = 0").mapInPandas(move, "path string, x binary, y binary").repartition(max(2 * len(paths), rows.sparkSession.sparkContext.defaultParallelism), "path")
    return tree.unionByName(cut_lineage(moved.groupBy("path").applyInPandas(finish, _TREE_ROWS)))


def build_tree(df: DataFrame, features, label: str, max_depth: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """Grow the gain-ratio tree until no split has a positive gain ratio (a
    pure node has none).  Returns one row per node: (node, depth, feature,
    threshold, gain_ratio, n, pos, value, yes, no).  Ids
    number the nodes breadth-first from 1; ``yes`` (x >= threshold) and ``no``
    (the rest, nulls included) point to the children and are null in leaves.

    Nodes of more than ``node_rows`` rows are split level by level, over rows that stay in place, in the order of each feature;
    the others move to one task each, which finishes the subtree (rows with NaN, without label or with a label
    other than 0 and 1: nodes and rows meet in joins).  While it grows a node is its path of turns."""
    spark = df.sparkSession
    ship_package(spark)
    names = [f"x{i}" for i in range(len(features))]
    cur = cut_lineage(df.select(*[F.col(c).cast("double").alias(x) for c, x in zip(features, names)],
                                F.col(label).cast("int").alias("_y"), F.lit("").alias("node")))
    odd = reduce(lambda a, b: a | b, [F.coalesce(F.isnan(x), F.lit(False)) for x in names], F.col("_y").isNull())
    endless = reduce(lambda a, b: a | b, [F.coalesce(F.abs(x) == F.lit(math.inf), F.lit(False)) for x in names])
    seen = cur.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.max(odd.cast("int")).alias("odd"),
                   F.max((endless | (F.col("_y") < 0) | (F.col("_y") > 1)).cast("int")).alias("wide")).first()
    if seen["odd"]:
        node_rows = 0           # tasks would not tell NaN from null

    def finish(pdf):
        return finished(pdf["node"].iat[0], pdf[names].to_numpy(float, na_value=np.nan).T.copy(), pdf["_y"].to_numpy(np.int64))

    def finished(path, x, y):
        nodes = grow_gain_ratio(x, y, len(path), max_depth)
        out = pd.DataFrame(dict(zip(["depth", "at", "feature", "threshold", "gain_ratio", "n", "pos"], nodes)))
        leaf = out["feature"] < 0
        out["feature"] = out["feature"].astype("Int32").mask(leaf)
        for c in ("threshold", "gain_ratio"):
            out[c] = out[c].astype(object).mask(leaf, None)
        return out.assign(path=path)[[c.split()[0] for c in _TREE_ROWS.split(", ")]]

    tree, depth = None, 0
    placed = seen["n"] > max(node_rows, 1) and not seen["odd"] and not seen["wide"]
    if placed:
        tree = _placed_tree(cur.select(*names, "_y"), len(names), seen["n"], seen["pos"], max_depth, node_rows, finished)
    while not placed:
        stats = cut_lineage(cur.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")))
        few = stats.where(F.col("n") <= node_rows).select("node")
        level = None
        if not few.isEmpty():
            level = cut_lineage(cur.join(few, "node").groupBy("node").applyInPandas(finish, _TREE_ROWS))
        large = stats.where(F.col("n") > node_rows)
        grown = 0
        if not large.isEmpty():
            best = best_splits(cur.join(large.select("node"), "node"), names, "_y").where("gain_ratio > 0")
            if max_depth is not None and depth >= max_depth:
                best = best.limit(0)
            splits = cut_lineage(best)
            grown = splits.count()
            here = cut_lineage(large.join(splits, "node", "left").select(
                F.col("node").alias("path"), F.lit(0).cast("long").alias("at"), F.lit(depth).alias("depth"),
                F.col("feature").cast("int").alias("feature"), "threshold", "gain_ratio", "n", "pos"))
            level = here if level is None else here.unionByName(level)
        if level is not None:
            tree = level if tree is None else tree.unionByName(level)
        if depth % 32 == 31:
            tree = cut_lineage(tree)
        if grown == 0:
            break
        x = F.element_at(F.array(*names), F.col("feature") + 1)
        cur = cut_lineage(cur.join(splits, "node").select(
            *names, "_y", F.concat("node", F.when(x >= F.col("threshold"), F.lit("0")).otherwise(F.lit("1"))).alias("node")))
        depth += 1
    if tree is None:
        tree = spark.createDataFrame([], _TREE_ROWS)
    # breadth first: children take the next two numbers in the order of their parents
    split = F.col("feature").isNotNull()
    numbered = prefix_sums(tree.withColumn("_split", split.cast("long")), ["depth", "path", "at"], ["_split"], out_cols=["_made"], rank_col="node")
    return numbered.select("node", "depth", "feature", "threshold", "gain_ratio", "n", "pos", (F.col("pos") * 2 >= F.col("n")).cast("int").alias("value"),
                           F.when(split, 2 * F.col("_made")).alias("yes"), F.when(split, 2 * F.col("_made") + 1).alias("no"))


def tree_predict(df: DataFrame, features, tree: DataFrame, out: str = "prediction") -> DataFrame:
    """Apply a node table of :func:`build_tree`: each step joins the rows that
    have not reached a leaf to the nodes of their level."""
    depths = (tree.agg(F.max("depth")).first()[0] or 0) + 1
    x = F.element_at(F.array(*[F.col(c).cast("double") for c in features]), F.col("_f") + 1)
    cur, done = df.withColumn("_node", F.lit(1).cast("long")), None
    for depth in range(depths):
        nodes = tree.where(F.col("depth") == depth).select(
            F.col("node").alias("_node"), F.col("feature").alias("_f"), F.col("threshold").alias("_t"),
            F.col("value").alias("_v"), F.col("yes").alias("_yes"), F.col("no").alias("_no"))
        met = cut_lineage(cur.join(nodes, "_node"))
        leaves = met.where("_f IS NULL").select(*[met[c] for c in df.columns], F.col("_v").alias(out))
        done = leaves if done is None else done.unionByName(leaves)
        cur = met.where("_f IS NOT NULL").select(
            *[met[c] for c in df.columns],
            F.when(x >= F.col("_t"), F.col("_yes")).otherwise(F.col("_no")).alias("_node"))
    return done


# ----------------------------------------------------------- MLlib models
def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """Feature columns → one ML vector column."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def estimator(kind: str, **params):
    """MLlib estimator for a model family (K2, K5, K6, K8, K9 base)."""
    from pyspark.ml import classification as C
    defaults = {
        "logreg": (C.LogisticRegression, dict(maxIter=1000)),
        "forest": (C.RandomForestClassifier, dict(numTrees=100, seed=42)),
        "gbt": (C.GBTClassifier, dict(maxIter=100, maxDepth=3, stepSize=0.1, seed=42)),
        "tree": (C.DecisionTreeClassifier, dict(seed=42)),
        "mlp": (C.MultilayerPerceptronClassifier, dict(maxIter=200, seed=42)),
        "svm": (C.LinearSVC, dict(maxIter=100)),
    }
    cls, d = defaults[kind]
    d = {**d, **params}
    return cls(**d)


def sklearn_style_logreg(n_rows: int, C: float = 1.0, max_iter: int = 1000, **params):
    """MLlib logistic regression with the objective of scikit-learn's default
    (L2, C=1, unstandardised penalty): Σ loss + ½‖w‖²/C equals n·(mean loss
    + regParam·½‖w‖²) with regParam = 1/(C·n) (K2)."""
    return estimator("logreg", maxIter=max_iter, regParam=1.0 / (C * max(n_rows, 1)),
                     elasticNetParam=0.0, standardization=False, **params)


def dealt(df: DataFrame, keys, width: int, part_bytes: int = 64 << 20) -> DataFrame:
    """``df`` in partitions that stay about ``part_bytes`` large when rows get ``width`` doubles each:
    rows are dealt while they are narrow, and more rows make more tasks."""
    parts = -(-df.count() * 8 * width // part_bytes)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)


def random_fourier(df: DataFrame, features, n_components: int = 100, gamma: float = 0.1,
                   seed: int = 42, prefix: str = "rff") -> DataFrame:
    """Random Fourier features approximating an RBF kernel (K9): columns
    sqrt(2/D)·cos(w·x + b) with w ~ N(0, 2γ), b ~ U(0, 2π).  The D×d draw is
    model state; the features are JVM column expressions."""
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, len(features)))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    s = math.sqrt(2.0 / n_components)
    cols = [(F.lit(s) * F.cos(reduce(lambda a, c: a + c, [F.lit(float(W[i, j])) * F.col(f)
                                                          for j, f in enumerate(features)])
                              + F.lit(float(b[i])))).alias(f"{prefix}_{i}")
            for i in range(n_components)]
    return df.select("*", *cols)


def _sorted_blocks(df: DataFrame, features, label: str):
    """The rows once per feature, in the order of its values, as an RDD of
    (feature, matrix, labels, value after the block's last): written once, so
    rounds of boosting change weights only.  Nulls lie below all values."""
    features, low = list(features), F.lit(float("-inf"))
    d = len(features)
    xs = [F.coalesce(F.nanvl(F.col(c).cast("double"), low), low).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.where(F.col(label).isNotNull()).select(*xs, F.col(label).cast("double").alias("y"))
    names = [f"x{i}" for i in range(d)]
    copies = (rows.withColumn("feature", F.explode(F.array(*map(F.lit, range(d)))))
              .withColumn("value", F.element_at(F.array(*names), F.col("feature") + 1)))
    # a frequent value is cut by a hash of the row, so no value is bound to one task
    order = ["feature", "value", F.xxhash64(*names, "y")]

    def pack(batches):
        from pyspark import TaskContext
        pid, number, held, of = TaskContext.get().partitionId(), 0, [], None

        def block():
            m = np.concatenate(held)
            return pd.DataFrame({"feature": [of], "at": [pid * (1 << 32) + number], "n": [len(m)], "first": [float(m[0, of])], "m": [m.tobytes()]})
        for pdf in batches:
            for f, part in pdf.groupby("feature", sort=True):
                m = part[[*names, "y"]].to_numpy(float)
                if held and (f != of or sum(map(len, held)) + len(m) > BLOCK_ROWS):
                    yield block()
                    held, number = [], number + 1
                of = int(f)
                held.append(m)
        if held:
            yield block()
    blocks = cut_lineage(copies.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        pack, "feature int, at long, n long, first double, m binary"))
    places = blocks.select("feature", "at", "first").orderBy("feature", "at").collect()        # a row a block
    after = {(r["feature"], r["at"]): (s["first"] if s is not None and s["feature"] == r["feature"] else math.inf)
             for r, s in zip(places, [*places[1:], None])}

    def arrays(r):
        m = np.frombuffer(r["m"]).reshape(r["n"], d + 1)
        return r["feature"], r["at"], np.ascontiguousarray(m[:, :d]), m[:, d].copy(), after[r["feature"], r["at"]]
    return blocks.rdd.map(arrays).persist(), [(r["feature"], r["at"]) for r in places]


def _log_weights(x: np.ndarray, y: np.ndarray, stumps) -> np.ndarray:
    out = np.zeros(len(x))
    for feature, threshold, left, right, alpha in stumps:
        out += alpha * (np.where(x[:, feature] <= threshold, left, right) != y)
    return out


def adaboost(df: DataFrame, features, label: str, n_estimators: int = 50, learning_rate: float = 1.0):
    """Discrete SAMME boosting of exact stumps (K7).

    Every value of every feature is a cut (threshold midway to the next value);
    the purest split by weighted Gini wins, ties to the smaller feature and value.
    A round is two small passes over blocks kept in value order: sums of the
    blocks, then the best cut inside each given the sums before it.  Returns a list of
    (feature, threshold, class at or below it, class above it, alpha)."""
    blocks, places = _sorted_blocks(df, features, label)
    stumps, shift = [], 0.0
    try:
        for _ in range(n_estimators):
            def weights(block, stumps=tuple(stumps), shift=shift):
                return np.exp(_log_weights(block[2], block[3], stumps) - shift)

            def sums(block, weights=weights):
                w = weights(block)
                return (block[0], block[1]), (w.sum(), w @ block[3])
            found = dict(blocks.map(sums).collect())
            before, so_far, totals = {}, {}, {}
            for f, at in places:
                before[f, at] = so_far.get(f, (0.0, 0.0))
                so_far[f] = tuple(a + b for a, b in zip(before[f, at], found[f, at]))
            totals = so_far

            def best(block, weights=weights, before=before, totals=totals):
                f, at, x, y, after = block
                (w0, p0), (wt, pt) = before[f, at], totals[f]
                w = weights(block)
                v = np.append(x[:, f], after)
                cut = np.flatnonzero((v[1:] != v[:-1]) & np.isfinite(v[1:]))
                if not len(cut):
                    return None
                wl, pl = (w0 + w.cumsum())[cut], (p0 + (w * y).cumsum())[cut]
                wr, pr = wt - wl, pt - pl
                score = (pl * pl + (wl - pl) ** 2) / wl + (pr * pr + (wr - pr) ** 2) / wr
                i = int(score.argmax())
                a, b = v[cut[i]], v[cut[i] + 1]
                middle = (a + b) / 2
                return float(score[i]), f, float(middle if a <= middle < b else a), wl[i], pl[i], wt, pt
            cuts = [c for c in blocks.map(best).collect() if c is not None]
            if not cuts:
                break
            _, feature, threshold, wl, pl, wt, pt = max(cuts, key=lambda c: (c[0], -c[1], -c[2]))
            wr, pr = wt - wl, pt - pl
            left, right = int(2 * pl > wl), int(2 * pr > wr)
            e = (min(pl, wl - pl) + min(pr, wr - pr)) / wt
            if e >= 0.5:
                break
            if e <= 1e-15:
                stumps.append((feature, threshold, left, right, 1.0))
                break
            alpha = learning_rate * math.log((1 - e) / e)
            stumps.append((feature, threshold, left, right, alpha))
            shift += math.log(wt * (1 - e + e * math.exp(alpha)))      # so that the next weights sum to 1
    finally:
        blocks.unpersist()
    return stumps


def adaboost_predict(df: DataFrame, features, stumps, out: str = "prediction") -> DataFrame:
    """``df`` with the class that most of the stumps' weights vote for, as a JVM expression."""
    low = F.lit(float("-inf"))
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), low), low) for c in features]
    votes = [F.when(x[f] <= F.lit(t), F.lit(a * (2 * left - 1))).otherwise(F.lit(a * (2 * right - 1))) for f, t, left, right, a in stumps]
    score = reduce(lambda a, b: a + b, votes, F.lit(0.0))
    return df.withColumn(out, (score > 0).cast("int"))


def cross_validate(est, grid, df: DataFrame, fold_col: str, label: str = "label",
                   parallelism: int = 4, metric: str = "accuracy"):
    """Exhaustive grid with user-given folds (K12).  Returns (model, table of
    param map index, params, mean and std of the metric)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                        parallelism=parallelism, collectSubModels=False)
    model = cv.fit(df)
    rows = [(i, "; ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)),
             float(m), float(s)) for i, (pm, m, s) in
            enumerate(zip(grid, model.avgMetrics, model.stdMetrics))]
    table = df.sparkSession.createDataFrame(rows, "grid_id int, params string, mean double, std double")
    return model, table


def random_grid(grid, n_iter: int, seed: int = 42):
    """Seeded sample of ``n_iter`` parameter maps from a full grid."""
    if n_iter >= len(grid):
        return list(grid)
    return random.Random(seed).sample(list(grid), n_iter)


def rff_svm(features, n_components: int = 100, gamma: float = 0.5, **params):
    """LinearSVC on random Fourier features (K9) as one pipeline over the feature columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    cols = ", ".join(f"{c} AS rff_{i}" for i, c in enumerate(_fourier_sql(features, n_components, gamma)))
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"),
        VectorAssembler(inputCols=[f"rff_{i}" for i in range(n_components)], outputCol="rff"),
        estimator("svm", featuresCol="rff", **params)])


def _fourier_sql(features, n_components: int, gamma: float, seed: int = 42):
    """The features of :func:`random_fourier` as SQL expressions."""
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, len(features)))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    s = math.sqrt(2.0 / n_components)
    return [f"{s!r}D * cos(" + " + ".join(f"{float(W[i, j])!r}D * `{f}`" for j, f in enumerate(features))
            + f" + {float(b[i])!r}D)" for i in range(n_components)]


class Stack:
    """Base models and the logistic model on their probabilities."""

    def __init__(self, features, label, id_col, members, meta=None, oof=None):
        self.features, self.label, self.id_col = features, label, id_col
        self.members, self.meta, self.oof = members, meta, oof

    def base_scores(self, df: DataFrame, fold: int = -1) -> DataFrame:
        """``df`` with ``p_<name>`` of each member fitted without ``fold`` (-1: on all rows)."""
        from pyspark.ml.functions import vector_to_array
        columns = df.columns
        for name, kind, model, at in self.members:
            if kind == "boosted":
                df = model.predict(df, [f"p_{name}"], [at[fold]])
            elif kind == "forest":
                df = model.predict(df, self.id_col, [f"p_{name}"], [at[fold]])
            else:
                kept = df.columns
                scored = at[fold].transform(assemble(df, self.features))
                raw = "probability" if "probability" in scored.columns else "rawPrediction"
                df = scored.select(*kept, vector_to_array(raw).getItem(1).alias(f"p_{name}"))
        return df.select(*columns, *[f"p_{m[0]}" for m in self.members])

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` of class 1."""
        from pyspark.ml.functions import vector_to_array
        scored = self.meta.transform(assemble(self.base_scores(df), [f"p_{m[0]}" for m in self.members], "_meta"))
        return scored.select(*df.columns, vector_to_array("probability").getItem(1).alias("probability"))


def stacking(df: DataFrame, features, label: str, id_col: str, fold_col: str, base: dict, threads: int = 8) -> Stack:
    """Out-of-fold probabilities of base models → logistic meta model.

    ``base`` maps names to boosting specs, forest specs or MLlib estimators
    (on the vector ``features`` or the feature columns).  All boosted models of all
    members and folds grow together, so do all forests; the MLlib fits of
    members and folds run side by side as Spark jobs of several threads.  Every
    member is also fitted on all rows, for scoring."""
    from concurrent.futures import ThreadPoolExecutor
    from dataclasses import replace
    from pyspark.ml.classification import LogisticRegression
    from quarry.operators import boosting, forest
    features = list(features)
    data = df.select(id_col, fold_col, *features, F.col(label).cast("double").alias("label")).persist()
    folds = [*(r[0] for r in data.select(fold_col).distinct().orderBy(fold_col).collect()), -1]
    members = []
    for kind, module, spec_type in (("boosted", boosting, boosting.Spec), ("forest", forest, forest.Spec)):
        names = [n for n, b in base.items() if isinstance(b, spec_type)]
        if names:
            specs = [replace(base[n], fold=f) for n in names for f in folds]
            model = module.fit(data, features, "label", id_col, specs, fold_col)
            members += [(n, kind, model, {f: i * len(folds) + j for j, f in enumerate(folds)}) for i, n in enumerate(names)]
    others = [n for n, b in base.items() if n not in {m[0] for m in members}]
    vectors = assemble(data, features).persist()
    with ThreadPoolExecutor(threads) as pool:
        jobs = {(n, f): pool.submit(base[n].copy().fit, vectors.where(F.col(fold_col) != f)) for f in folds for n in others}
        members += [(n, "mllib", None, {f: jobs[n, f].result() for f in folds}) for n in others]
    members.sort(key=lambda m: list(base).index(m[0]))
    stack = Stack(features, "label", id_col, members)
    parts = [stack.base_scores(data.where(F.col(fold_col) == f), f) for f in folds[:-1]]
    stack.oof = cut_lineage(reduce(DataFrame.unionByName, parts))
    stack.meta = LogisticRegression(featuresCol="_meta", labelCol="label", maxIter=1000).fit(
        assemble(stack.oof, [f"p_{m[0]}" for m in members], "_meta"))
    vectors.unpersist()
    data.unpersist()
    return stack


def permutation_importance(df: DataFrame, id_col: str, features, label: str, score_fn,
                           salt: str = "perm") -> DataFrame:
    """Accuracy drop when one feature is permuted (K19, in place of SHAP).

    The permutation pairs the row at position r in id order with the row at
    position r in hash order — two distributed rankings and one equi-join,
    no shuffle-to-one-task.  ``score_fn(df) -> DataFrame`` must add an int
    ``prediction`` column."""
    def acc(d):
        return d.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    base = acc(score_fn(df))
    rows = []
    by_id = row_number(df, [id_col], out="_r")
    for f in features:
        donor = row_number(df.select(id_col, f).withColumn("_h", hash_int(id_col, salt + f)),
                           ["_h", id_col], out="_r").select("_r", F.col(f).alias("_perm"))
        perm = by_id.join(donor, "_r").withColumn(f, F.col("_perm")).drop("_r", "_perm")
        rows.append((f, float(base), float(base - acc(score_fn(perm)))))
    return df.sparkSession.createDataFrame(rows, "feature string, base_accuracy double, importance double")


# -------------------------------------------------------------------- K14
def text_classifier(docs: DataFrame, tokens: str, label: str, max_iter: int = 100):
    """Token arrays → term counts over the whole vocabulary → IDF → logistic regression, one
    MLlib pipeline fitted on the labelled rows (K14: the scoring side of the
    reference's fine-tuned text classifier, re-aimed)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer
    terms = docs.select(F.explode(tokens).alias("term")).distinct().count()
    pipe = Pipeline(stages=[CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=max(terms, 1)),
                            IDF(inputCol="_tf", outputCol="_tfidf"),
                            LogisticRegression(featuresCol="_tfidf", labelCol=label, maxIter=max_iter)])
    return pipe.fit(docs.where(F.col(label).isNotNull())
                    .withColumn(label, F.col(label).cast("double")))


def score_texts(model, docs: DataFrame, id_col: str) -> DataFrame:
    """Batch scoring: (id, probability of class 1, prediction)."""
    from pyspark.ml.functions import vector_to_array
    return model.transform(docs).select(
        id_col, vector_to_array("probability").getItem(1).alias("probability"),
        F.col("prediction").cast("int").alias("prediction"))
