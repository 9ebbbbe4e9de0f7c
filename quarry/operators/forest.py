"""Random forests with exact splits and no limit of depth or bins.

A tree takes bootstrap counts from hashes of (row, tree), every node draws
its features by hashes of its path, thresholds lie midway between
neighbouring values, and nodes are split until they are pure (or a given
limit holds).  All of this depends on keys only, so a tree is the same
whatever the partitions.

Trees grow level by level.  The rows are written once per feature, in the
order of its values, in blocks that stay in place: a row's weight and node in
a tree follow from its id and values, so a level is two passes that return
sums, then the best cut, of each (block, node).  A node of at most
``node_rows`` rows moves to one task that finishes its subtree, unless it is
a leaf already.  Where all rows stay below ``one_task`` bytes, every root is
such a node: the rows are broadcast once and each task grows a run of trees.

Ties go to the smaller feature, then the smaller threshold.  Nulls and NaN
lie below all values; rows without a label take no part.  A node draws
``max_features`` of the features that can split it at all.
"""
from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage, ship_package

ONE_TASK = 64 << 20         # bytes of rows that are broadcast to tasks of some trees each
NODE_ROWS = 200_000         # rows of a node that one task finishes
BROADCAST_NODES = 2_000_000     # nodes of a forest that rows are scored with in place; larger ones are joined
BLOCK_BYTES = 64 << 20      # rows of a block in the order of a feature
PLACES = 1 << 22            # (block, tree, node) sums that the driver holds at a time
RUN = 25                    # trees of a task, at most
UNIT = 1 << 30              # held-out shares are summed as whole numbers: sums do not depend on the order
ROOT = 1


@dataclass(frozen=True)
class Spec:
    """One forest; ``fold`` is the held-out fold (-1: none), ``max_features`` None takes all."""
    trees: int = 100
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    max_features: int | None = None
    bootstrap: bool = True
    fold: int = -1
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def child_keys(key: np.ndarray, side: int) -> np.ndarray:
    """Key of a child from its parent's: a hash of the path (64 bits)."""
    with np.errstate(over="ignore"):
        return _mix(key * np.uint64(2) + np.uint64(side + 0x51ED))


def _poisson(h: np.ndarray) -> np.ndarray:
    chance = np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 16.0)))
    return np.searchsorted(np.cumsum(chance), (h >> np.uint64(11)).astype(float) / 2.0 ** 53, side="right").astype(float)


def _counts() -> np.ndarray:
    """Counts by the upper 16 bits of a hash; -1 where the others decide."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    a, b = _poisson(low), _poisson(low + np.uint64((1 << 48) - 1))
    return np.where(a == b, a, -1.0)


_COUNTS = _counts()


def draws(ids: np.ndarray, tree: int, spec: Spec) -> np.ndarray:
    """Bootstrap counts of rows: Poisson with mean 1 by hashes."""
    if not spec.bootstrap:
        return np.ones(len(ids))
    with np.errstate(over="ignore"):
        h = _mix(_mix(ids.astype(np.uint64) + np.uint64(spec.seed)) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15))
    out = _COUNTS[h >> np.uint64(48)]
    unsure = np.flatnonzero(out < 0)
    out[unsure] = _poisson(h[unsure])
    return out


def _order_of_features(keys: np.ndarray, tree: int, seed: int, d: int) -> np.ndarray:
    """A hash for each (node, feature): nodes draw the features of smallest hashes."""
    with np.errstate(over="ignore"):
        base = _mix(keys + np.uint64(tree * 2 + 1) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        return np.stack([_mix(base + np.uint64(f + 1) * np.uint64(0x9E3779B97F4A7C15)) for f in range(d)], 1)


def _drawn(valid: np.ndarray, keys: np.ndarray, tree: int, spec: Spec) -> np.ndarray:
    """Which features each node draws of those that can split it."""
    d = valid.shape[1]
    if spec.max_features is None or spec.max_features >= d:
        return valid
    rank = _order_of_features(keys, tree, spec.seed, d)
    worse = valid[:, None, :] & (rank[:, None, :] < rank[:, :, None])       # features drawn before this one
    return valid & (worse.sum(2) < spec.max_features)


def _choose(score: np.ndarray, keys: np.ndarray, tree: int, spec: Spec) -> np.ndarray:
    """Best feature of each node among those drawn; -1 where no feature can split."""
    valid = _drawn(np.isfinite(score), keys, tree, spec)
    masked = np.where(valid, score, -np.inf)
    return np.where(valid.any(1), masked.argmax(1), -1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, spec: Spec, key: int = ROOT, depth: int = 0, orders=None):
    """Nodes below (and with) ``key`` as arrays (key, depth, feature, threshold, w, pos, n), breadth first.

    ``x`` is (features, rows); rows of weight 0 take no part."""
    used = w > 0
    d = len(x)
    orders = [np.argsort(v, kind="stable") for v in x] if orders is None else orders
    orders = [o[used[o]] for o in orders]
    wy = w * y
    place = np.where(used, 0, -1)
    keys, out = np.array([key], np.uint64), []
    while True:
        k = len(keys)
        rows = orders[0]
        at = place[rows]
        sizes = np.bincount(at, minlength=k)
        weight, pos = np.bincount(at, w[rows], k), np.bincount(at, wy[rows], k)
        feature, threshold = np.full(k, -1), np.zeros(k)
        open_ = (pos > 0) & (pos < weight) & (sizes >= spec.min_split)
        if spec.max_depth is not None and depth >= spec.max_depth:
            open_[:] = False
        if open_.any():
            number = np.cumsum(open_) - 1
            place = np.where(place >= 0, np.where(open_[place], number[place], -1), -1)
            m, few = int(open_.sum()), sizes[open_]
            ends = np.cumsum(few)
            starts = ends - few
            owner = np.repeat(np.arange(m), few)
            wt, pt = weight[open_], pos[open_]
            scores, cuts = np.full((m, d), -np.inf), np.zeros((m, d))
            found, valid = [], np.zeros((m, d), bool)
            kind = np.int16 if m < 32_000 else np.int64
            for f in range(d):
                o = orders[f]
                here = place[o]
                if not open_.all():
                    inside = here >= 0
                    o, here = o[inside], here[inside]
                if m > 1:
                    o = o[np.argsort(here.astype(kind), kind="stable")]
                orders[f] = o
                v = x[f].take(o)
                ok = v[1:] != v[:-1]
                ok[ends[:-1] - 1] = False                       # the next row is of another node
                spots = np.flatnonzero(ok)
                of = owner[spots]
                if spec.min_leaf > 1:
                    left = spots - starts[of] + 1
                    fits = (left >= spec.min_leaf) & (few[of] - left >= spec.min_leaf)
                    spots, of = spots[fits], of[fits]
                found.append((v, spots, of))
                valid[of, f] = True
            drawn = _drawn(valid, keys[open_], tree, spec)
            for f, (o, (v, spots, of)) in enumerate(zip(orders, found)):
                if not drawn[:, f].all():
                    mine = drawn[of, f]
                    spots, of = spots[mine], of[mine]
                if not len(spots):
                    continue
                wl, pl = w.take(o).cumsum(), wy.take(o).cumsum()
                w0, p0 = (np.where(starts > 0, s[starts - 1], 0.0) for s in (wl, pl))
                score = _score(wl[spots] - w0[of], pl[spots] - p0[of], wt[of], pt[of])
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                top, mine = np.maximum.reduceat(score, begin), of[begin]
                hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(begin, len(of)))))
                first = spots[hit[np.searchsorted(hit, begin)]]
                scores[mine, f] = top
                cuts[mine, f] = midway(v[first], v[first + 1])
            best = _choose(scores, keys[open_], tree, spec)
            feature[open_] = best
            threshold[open_] = np.where(best >= 0, cuts[np.arange(m), best], 0.0)
        out.append((keys, np.full(k, depth), feature, threshold, weight, pos, sizes))
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        # children of the nodes that split, left then right; their rows move there
        number = np.full(m, -1)
        number[feature[open_] >= 0] = np.arange(len(split))
        kept = np.flatnonzero(place >= 0)
        at = number[place[kept]]
        place[kept] = -1
        kept, at = kept[at >= 0], at[at >= 0]
        place[kept] = 2 * at + (x[feature[split][at], kept] > threshold[split][at])
        if len(kept) < len(orders[0]):
            orders = [o[place.take(o) >= 0] for o in orders]
        keys = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], 1).ravel()
        depth += 1
    return [np.concatenate(c) for c in zip(*out)]


def _score(wl, pl, w, p):
    """Larger is purer: sum of squared class weights over the weight, left and right."""
    wr, pr = w - wl, p - pl
    return (pl * pl + (wl - pl) * (wl - pl)) / wl + (pr * pr + (wr - pr) * (wr - pr)) / wr


def midway(a, b):
    """Threshold between two values; the lower where nothing lies between."""
    with np.errstate(invalid="ignore"):
        m = (a + b) / 2
    return np.where((m < b) & (m >= a), m, a)


class Walk:
    """The nodes of one tree as arrays, to find rows' leaves."""

    def __init__(self, key, feature, threshold, share):
        order = np.argsort(key)
        self.key, self.feature, self.threshold, self.share = key[order], feature[order], threshold[order], share[order]
        inner = self.feature >= 0
        self.left, self.right = np.zeros((2, len(key)), np.int64)
        for side, to in ((0, self.left), (1, self.right)):
            to[inner] = np.searchsorted(self.key, child_keys(self.key[inner], side))

    def shares(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Shares of the leaves of ``rows`` (all, if not given)."""
        return self.share[self.leaves(x, rows)]

    def under(self, stop: np.ndarray) -> np.ndarray:
        """For each node, that in which its rows end if the tree is cut off at ``stop`` (by key order)."""
        end, front = np.arange(len(self.key)), np.searchsorted(self.key, np.array([ROOT], np.uint64))
        while len(front):
            front = front[self.feature[front] >= 0]
            for to in (self.left, self.right):
                end[to[front]] = np.where(stop[end[front]], end[front], to[front])
            front = np.concatenate([self.left[front], self.right[front]])
        return end

    def leaves(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Numbers (by key order) of the leaves of ``rows`` (all, if not given)."""
        rows = np.arange(x.shape[1]) if rows is None else rows
        at = np.full(len(rows), np.searchsorted(self.key, np.uint64(ROOT)))
        moving = np.arange(len(rows))
        while len(moving):
            moving = moving[self.feature[at[moving]] >= 0]
            here = at[moving]
            at[moving] = np.where(x[self.feature[here], rows[moving]] <= self.threshold[here], self.left[here], self.right[here])
        return at


def _matrix(pdf: pd.DataFrame, features) -> np.ndarray:
    x = np.stack([pdf[c].to_numpy(float, na_value=np.nan) for c in features])
    return np.where(np.isnan(x), -np.inf, x)


_NODE = "model int, tree int, key long, depth int, feature int, threshold double, w double, pos double, n long"


def _node_rows(model: int, tree: int, nodes) -> pd.DataFrame:
    key, depth, feature, threshold, w, pos, n = nodes
    return pd.DataFrame({"model": model, "tree": tree, "key": key.view(np.int64), "depth": depth, "feature": feature,
                         "threshold": threshold, "w": w, "pos": pos, "n": n})


class Forests:
    """Fitted forests: the node table, or the held-out scores of each by stage."""

    def __init__(self, features, specs, nodes: DataFrame | None, scores=None):
        self.features, self.specs, self.nodes, self.scores = list(features), list(specs), nodes, scores

    def importances(self) -> DataFrame:
        """(model, feature, importance): weighted decrease of impurity, summing to 1 per forest."""
        n = self.nodes
        impurity = F.col("w") - (F.col("pos") * F.col("pos") + (F.col("w") - F.col("pos")) * (F.col("w") - F.col("pos"))) / F.col("w")
        # the impurity of a split node counts for its feature, that of its children against it
        inner = n.where("feature >= 0").select("model", "tree", "key", "feature", impurity.alias("gain"))
        keys = F.pandas_udf(lambda k: pd.Series(child_keys(k.to_numpy().view(np.uint64), 0).view(np.int64)), "long")
        right = F.pandas_udf(lambda k: pd.Series(child_keys(k.to_numpy().view(np.uint64), 1).view(np.int64)), "long")
        child = inner.select("model", "tree", "feature", F.explode(F.array(keys("key"), right("key"))).alias("key"))
        lost = n.select("model", "tree", "key", impurity.alias("i")).join(child, ["model", "tree", "key"]).select(
            "model", "tree", "feature", (-F.col("i")).alias("gain"))
        root = n.where(F.col("key") == ROOT).select("model", "tree", F.col("w").alias("rows"))
        gains = (inner.select("model", "tree", "feature", "gain").union(lost).groupBy("model", "tree", "feature").agg(F.sum("gain").alias("gain"))
                 .join(root, ["model", "tree"]).withColumn("gain", F.col("gain") / F.col("rows")))
        gains = gains.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("model", "tree")))
        trees = root.groupBy("model").agg(F.count("*").alias("trees"))
        return (gains.groupBy("model", "feature").agg(F.sum("share").alias("s")).join(trees, "model")
                .select("model", "feature", (F.col("s") / F.col("trees")).alias("importance")))

    def predict(self, df: DataFrame, id_col: str, names, models=None, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
        """``df`` with the mean share of class 1 over each forest's trees, as columns ``names``."""
        names, models = list(names), list(range(len(self.specs)) if models is None else models)
        nodes = self.nodes.where(F.col("model").isin(models))
        if nodes.count() > broadcast_nodes:
            return self._predict_by_joins(df, id_col, names, models)
        walks = {m: [] for m in models}
        for (m, _), g in nodes.select("model", "tree", "key", "feature", "threshold", (F.col("pos") / F.col("w")).alias("share")).toPandas().groupby(["model", "tree"]):
            walks[m].append(Walk(g["key"].to_numpy().view(np.uint64), g["feature"].to_numpy(), g["threshold"].to_numpy(), g["share"].to_numpy()))
        shared, inputs = df.sparkSession.sparkContext.broadcast([walks[m] for m in models]), self.features

        def run(*columns: pd.Series) -> pd.DataFrame:
            x = _matrix(pd.DataFrame(dict(zip(inputs, columns))), inputs)
            return pd.DataFrame({name: sum(t.shares(x) for t in trees) / max(len(trees), 1) for name, trees in zip(names, shared.value)})

        score = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
        return (df.select("*", score(*[F.col(c).cast("double") for c in inputs]).alias("_scores"))
                .select(*df.columns, *[F.col(f"_scores.{n}").alias(n) for n in names]))

    def _predict_by_joins(self, df, id_col, names, models):
        """Rows meet the nodes of their level, tree by tree, in joins: for forests of any size."""
        low = F.lit(float("-inf"))
        x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), low), low) for c in self.features])
        trees = self.nodes.where((F.col("key") == ROOT) & F.col("model").isin(models)).select("model", "tree")
        cur = df.select(F.col(id_col).alias("_id"), x.alias("_x")).join(trees).withColumn("key", F.lit(ROOT).cast("long"))
        sides = [F.pandas_udf(lambda k, s=s: pd.Series(child_keys(k.to_numpy().view(np.uint64), s).view(np.int64)), "long") for s in (0, 1)]
        found = None
        for depth in range((self.nodes.agg(F.max("depth")).first()[0] or 0) + 1):
            level = self.nodes.where(F.col("depth") == depth).select("model", "tree", "key", "feature", "threshold", (F.col("pos") / F.col("w")).alias("share"))
            met = cut_lineage(cur.join(level, ["model", "tree", "key"]))
            leaves = met.where("feature < 0").select("_id", "model", "share")
            found = leaves if found is None else found.union(leaves)
            inner = met.where("feature >= 0")
            goes = F.element_at("_x", F.col("feature") + 1) <= F.col("threshold")
            cur = inner.select("_id", "_x", "model", "tree", F.when(goes, sides[0]("key")).otherwise(sides[1]("key")).alias("key"))
        shares = found.groupBy("_id").agg(*[F.avg(F.when(F.col("model") == m, F.col("share"))).alias(n) for m, n in zip(models, names)])
        return df.join(shares, F.col(id_col) == F.col("_id")).select(*[df[c] for c in df.columns], *names)


def fit(df: DataFrame, features, label: str, id_col: str, specs, fold: str | None = None, stages=None, keep: bool = True,
        one_task: int = ONE_TASK, node_rows: int = NODE_ROWS) -> Forests:
    """Fit all ``specs``.  With ``stages`` (see :func:`_scores_in_tasks`) the held-out rows are
    scored and no trees kept; these need rows below ``one_task`` bytes."""
    spark, specs, features = df.sparkSession, list(specs), list(features)
    ship_package(spark)
    low = F.lit(float("-inf"))
    rows = cut_lineage(df.where(F.col(label).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(label).cast("double").alias("_y"),
        (F.col(fold).cast("int") if fold else F.lit(-2)).alias("_fold"),
        *[F.coalesce(F.nanvl(F.col(c).cast("double"), low), low).alias(f"x{i}") for i, c in enumerate(features)]))
    small = rows.count() * (8 * len(features) + 20) <= one_task
    if stages is not None:
        if not small:
            raise ValueError("held-out scores by stage need rows below one_task bytes; fit and predict each fold instead")
        return Forests(features, specs, None, _scores_in_tasks(rows, specs, stages))
    nodes = _fit_in_tasks(rows, specs) if small else _fit_in_levels(rows, specs, len(features), node_rows)
    return Forests(features, specs, nodes)


def _shared_rows(rows: DataFrame):
    pdf = rows.toPandas()                    # below ``one_task`` bytes
    x = pdf[[c for c in pdf.columns if c.startswith("x")]].to_numpy().T.copy()
    return rows.sparkSession.sparkContext.broadcast((pdf["_id"].to_numpy(), pdf["_y"].to_numpy(), pdf["_fold"].to_numpy(), x))


def _runs_of_trees(spark, specs) -> DataFrame:
    """(model, first, last): runs of trees, dealt one by one to the tasks."""
    slots = 4 * spark.sparkContext.defaultParallelism
    run = max(1, min(RUN, sum(s.trees for s in specs) // slots))
    runs = [(k, a, min(a + run, s.trees)) for k, s in enumerate(specs) for a in range(0, s.trees, run)]
    random.Random(1).shuffle(runs)
    parts = min(len(runs), slots)
    pdf = pd.DataFrame(runs, columns=["model", "first", "last"])
    pdf["p"] = np.arange(len(runs)) % parts
    return spark.createDataFrame(pdf).repartitionByRange(parts, "p").select("model", "first", "last")


def _trees_of(shared, specs):
    """Grow the trees of each run: yields (model, tree, nodes, held-out rows)."""
    ids, y, folds, x = shared.value
    sorted_ = [np.argsort(v, kind="stable") for v in x]

    def run(model, first, last):
        spec = specs[model]
        for tree in range(first, last):
            w = draws(ids, tree, spec) * (folds != spec.fold)
            yield tree, grow(x, y, w, tree, spec, orders=list(sorted_))
    return run


def _fit_in_tasks(rows, specs):
    shared = _shared_rows(rows)

    def run(batches):
        grown = _trees_of(shared, specs)
        for pdf in batches:
            for m, a, b in pdf.itertuples(index=False):
                yield pd.concat([_node_rows(m, tree, nodes) for tree, nodes in grown(m, a, b)])
    return cut_lineage(_runs_of_trees(rows.sparkSession, specs).mapInPandas(run, _NODE))


def _scores_in_tasks(rows, specs, stages):
    """[({limits: hits by number of trees}, held-out rows)] of every spec.

    ``stages[m]`` maps (max_depth, min_split) to numbers of trees: a tree grown under
    such limits is the unlimited one cut off there, as nodes draw by their paths."""
    shared = _shared_rows(rows)

    def run(batches):
        grown = _trees_of(shared, specs)
        _, _, folds, x = shared.value
        for pdf in batches:
            for m, a, b in pdf.itertuples(index=False):
                held = x[:, folds == specs[m].fold]
                limits = list(stages[m])
                totals = [np.zeros(held.shape[1], np.int64) for _ in limits]
                for tree, (key, depth, feature, threshold, w, pos, n) in grown(m, a, b):
                    walk, order = Walk(key, feature, threshold, pos / w), np.argsort(key)
                    leaf, whole = walk.leaves(held), np.rint(walk.share * UNIT).astype(np.int64)
                    seen, depth, n = {}, depth[order], n[order]
                    for i, limit in enumerate(limits):
                        if tree >= stages[m][limit][-1]:
                            continue
                        stop = ((n < limit[1]) | (depth >= (1 << 30 if limit[0] is None else limit[0]))) & (walk.feature >= 0)
                        code = stop.tobytes()
                        if code not in seen:        # most limits leave a tree as it is
                            seen[code] = whole[walk.under(stop)][leaf]
                        totals[i] += seen[code]
                        if tree + 1 == b or tree + 1 in stages[m][limit]:
                            yield pd.DataFrame({"model": [m], "at": [i], "upto": [tree + 1], "sums": [totals[i].tobytes()]})
                            totals[i] = np.zeros(held.shape[1], np.int64)

    def score(pdf):
        m, i = int(pdf["model"].iat[0]), int(pdf["at"].iat[0])
        _, y, folds, _ = shared.value
        held = y[folds == specs[m].fold] > 0
        total, hits, sizes = np.zeros(len(held), np.int64), [], list(stages[m].values())[i]
        for upto, raw in sorted(zip(pdf["upto"], pdf["sums"])):
            total += np.frombuffer(raw, np.int64)
            if upto in sizes:
                hits.append(int(((2 * total > upto * UNIT) == held).sum()))
        return pd.DataFrame({"model": [m], "at": [i], "hits": [hits], "n": [len(held)]})

    sums = _runs_of_trees(rows.sparkSession, specs).mapInPandas(run, "model int, at int, upto int, sums binary")
    scores = [({}, 0) for _ in specs]
    for r in sums.groupBy("model", "at").applyInPandas(score, "model int, at int, hits array<long>, n long").collect():
        limit = list(stages[r["model"]])[r["at"]]
        scores[r["model"]] = (scores[r["model"]][0] | {limit: dict(zip(stages[r["model"]][limit], r["hits"]))}, r["n"])
    return scores


_BLOCK = "feature int, at long, ids binary, folds binary, y binary, x binary"


def _value_blocks(rows, d, n):
    """Each row once per feature, in the order of its values, packed in blocks that stay where they are:
    (feature, place in its order, ids, folds, labels, values of all features)."""
    xs = [f"x{i}" for i in range(d)]
    width = 8 * d + 20
    slots = rows.sparkSession.sparkContext.defaultParallelism
    parts = slots * max(1, -(-n * d * width // (BLOCK_BYTES * slots)))
    copies = (rows.withColumn("feature", F.explode(F.array(*map(F.lit, range(d)))))
              .withColumn("value", F.element_at(F.array(*xs), F.col("feature") + 1)))
    order = ["feature", "value", F.xxhash64("_id", *xs)]        # a frequent value is cut by a hash of the row
    most = max(1, 2 * BLOCK_BYTES // width)

    def pack(batches):
        from pyspark import TaskContext
        pid, number, held, of = TaskContext.get().partitionId(), 0, [], None

        def block():
            pdf = pd.concat(held)
            return pd.DataFrame({"feature": [of], "at": [pid * (1 << 32) + number], "ids": [pdf["_id"].to_numpy(np.int64).tobytes()],
                                 "folds": [pdf["_fold"].to_numpy(np.int32).tobytes()], "y": [pdf["_y"].to_numpy(float).tobytes()],
                                 "x": [pdf[xs].to_numpy(float).T.tobytes()]})
        for pdf in batches:
            pdf["_fold"] = pdf["_fold"].fillna(-2)              # held out of no fold
            for f, part in pdf.groupby("feature", sort=True):
                if held and (f != of or sum(map(len, held)) + len(part) > most):
                    yield block()
                    held, number = [], number + 1
                of = int(f)
                held.append(part)
        if held:
            yield block()
    return cut_lineage(copies.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(pack, _BLOCK))


def _arrays(batches, d):
    """(feature, at, ids, folds, y, x) of each block."""
    for pdf in batches:
        for feature, at, ids, folds, y, x in pdf.itertuples(index=False):
            yield feature, at, np.frombuffer(ids, np.int64), np.frombuffer(folds, np.int32), np.frombuffer(y), np.frombuffer(x).reshape(d, -1)


class _Top:
    """The upper nodes of one tree while it grows: state of the model, on the driver."""

    def __init__(self, model, tree):
        self.model, self.tree = model, tree
        self.key, self.feature, self.threshold = np.array([ROOT], np.uint64), np.array([-1]), np.zeros(1)
        self.front, self.small = np.array([0]), []      # nodes of the current level; (node, depth) of those that tasks finish

    def walk(self, some):
        """Rows find the number of their node in ``some``, or -1."""
        number = np.full(len(self.key), -1)
        number[some] = np.arange(len(some))
        return Walk(self.key, self.feature, self.threshold, number)

    def split(self, nodes, feature, threshold):
        self.feature[nodes], self.threshold[nodes] = feature, threshold
        at = len(self.key)
        self.key = np.append(self.key, np.stack([child_keys(self.key[nodes], 0), child_keys(self.key[nodes], 1)], 1).ravel())
        self.feature, self.threshold = np.append(self.feature, np.full(2 * len(nodes), -1)), np.append(self.threshold, np.zeros(2 * len(nodes)))
        self.front = np.arange(at, len(self.key))


def _members(shared, specs, d, batches):
    """For every block and tree: (block, number of the tree, its task, weights, rows in value order, their nodes)."""
    tops = shared.value
    for block in _arrays(batches, d):
        _, _, ids, folds, _, x = block
        for i, (model, tree, walk, task) in enumerate(tops):
            w = draws(ids, tree, specs[model]) * (folds != specs[model].fold)
            rows = np.flatnonzero(w)
            node = walk.shares(x, rows)
            rows, node = rows[node >= 0], node[node >= 0]
            if len(rows):
                yield block, i, task, w, rows, node


_TALLY = "feature int, at long, i int, node binary, n binary, w binary, pos binary, first binary"


def _tallies(shared, specs, d):
    """Of each block and tree: sums and the smallest value of the nodes met there."""
    def run(batches):
        for (feature, at, _, _, y, x), i, m, w, rows, node in _members(shared, specs, d, batches):
            n, weight, pos = np.bincount(node, minlength=m), np.bincount(node, w[rows], m), np.bincount(node, w[rows] * y[rows], m)
            first = np.zeros(m)
            first[node[::-1]] = x[feature, rows[::-1]]
            met = np.flatnonzero(n)
            yield pd.DataFrame({"feature": [feature], "at": [at], "i": [i], "node": [met.tobytes()], "n": [n[met].tobytes()],
                                "w": [weight[met].tobytes()], "pos": [pos[met].tobytes()], "first": [first[met].tobytes()]})
    return run


_CUT = "feature int, i int, node binary, score binary, value binary, next binary"


def _cuts(shared, specs, d):
    """Of each block and tree: the best cut of each open node inside the block, given the sums before it."""
    def run(batches):
        for (feature, at, _, _, y, x), i, (weight, pos, size, places), w, rows, node in _members(shared, specs, d, batches):
            nodes, n0, w0, p0, after = places[feature, at]
            order = np.argsort(node.astype(np.int16 if len(weight) < 32_000 else np.int64), kind="stable")
            rows, node = rows[order], node[order]
            v, starts = x[feature, rows], np.searchsorted(node, nodes)
            sizes = np.diff(np.append(starts, len(rows)))
            owner = np.repeat(np.arange(len(nodes)), sizes)
            wl, pl = w[rows].cumsum(), (w[rows] * y[rows]).cumsum()
            wl, pl = (s + (s0 - np.where(starts > 0, s[starts - 1], 0.0))[owner] for s, s0 in ((wl, w0), (pl, p0)))
            nxt = np.append(v[1:], np.nan)
            nxt[starts + sizes - 1] = after                 # NaN: no row of the node lies above
            ok = (v != nxt) & ~np.isnan(nxt)
            least = specs[shared.value[i][0]].min_leaf
            if least > 1:
                left = np.arange(len(rows)) - starts[owner] + 1 + n0[owner]
                ok &= (left >= least) & (size[nodes][owner] - left >= least)
            spots = np.flatnonzero(ok)
            if not len(spots):
                continue
            own = owner[spots]
            score = _score(wl[spots], pl[spots], weight[nodes][own], pos[nodes][own])
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(own)))))
            best = spots[hit[np.searchsorted(hit, first)]]
            yield pd.DataFrame({"feature": [feature], "i": [i], "node": [nodes[own[first]].tobytes()], "score": [top.tobytes()],
                                "value": [v[best].tobytes()], "next": [nxt[best].tobytes()]})
    return run


def _coded(v: np.ndarray):
    """(values, codes) of a column of at most 256 values, else (None, column): fewer bytes to move."""
    values = np.unique(v[:: max(1, len(v) // 4096)])
    if len(values) <= 256:
        values, codes = np.unique(v, return_inverse=True)
        if len(values) <= 256:
            return values, codes.astype(np.uint8)
    return None, v


def _moved(shared, specs, d):
    """Rows of the nodes that one task finishes, a piece for each block and node."""
    names = ["y", *[f"x{j}" for j in range(d)]]

    def run(batches):
        last, coded = None, None
        for block, i, (keys, depths), w, rows, node in _members(shared, specs, d, batches):
            if block is not last:
                last, coded = block, [_coded(v) for v in (block[4], *block[5])]
            model, tree = shared.value[i][:2]
            order = np.argsort(node.astype(np.int16 if len(keys) < 32_000 else np.int64), kind="stable")
            rows, node = rows[order], node[order]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            pieces = np.split(rows, starts[1:])
            out = pd.DataFrame({"model": model, "tree": tree, "key": keys[node[starts]].view(np.int64), "depth": depths[node[starts]],
                                "w": [w[p].astype(np.uint8).tobytes() for p in pieces]})
            for name, (values, codes) in zip(names, coded):
                out[name] = [codes[p].tobytes() for p in pieces]
                out["v" + name] = b"" if values is None else values.tobytes()
            yield out
    schema = "model int, tree int, key long, depth int, w binary, " + ", ".join(f"{c} binary, v{c} binary" for c in names)
    return run, schema


def _tops_grown(blocks, specs, d, trees, node_rows):
    """Upper nodes of ``trees`` level by level; returns (tops, finished node rows)."""
    sc, tops, found, depth = blocks.sparkSession.sparkContext, [_Top(m, t) for m, t in trees], [], 0

    def asked(kernel, schema, tasks):
        shared = sc.broadcast(tasks)
        try:
            return blocks.mapInPandas(kernel(shared, specs, d), schema).collect()     # some numbers a block, tree and node
        finally:
            shared.unpersist()

    def leaves(top, nodes, w, pos, n):
        if len(nodes):
            found.append(_node_rows(top.model, top.tree, (top.key[nodes], depth, top.feature[nodes], top.threshold[nodes], w, pos, n)))
    while True:
        live = [t for t in tops if len(t.front)]
        if not live:
            return tops, found
        tallies = {}
        for r in asked(_tallies, _TALLY, [(t.model, t.tree, t.walk(t.front), len(t.front)) for t in live]):
            tallies.setdefault(r["i"], {}).setdefault(r["feature"], []).append(
                (r["at"], np.frombuffer(r["node"], np.int64), *[np.frombuffer(r[c], k) for c, k in (("n", np.int64), ("w", float), ("pos", float), ("first", float))]))
        tasks, open_ = [], []
        for i, top in enumerate(live):
            spec, front, top.front = specs[top.model], top.front, np.array([], int)
            parts = tallies.get(i, {})
            n, w, pos = np.zeros(len(front), int), np.zeros(len(front)), np.zeros(len(front))
            for _, node, n1, w1, p1, _ in parts.get(0, []):
                n[node] += n1
                w[node] += w1
                pos[node] += p1
            more = (pos > 0) & (pos < w) & (n >= spec.min_split) & (spec.max_depth is None or depth < spec.max_depth)
            done = (n > 0) & ~more
            leaves(top, front[done], w[done], pos[done], n[done])
            top.small += [(int(x), depth) for x in front[more & (n <= node_rows)]]
            large = np.flatnonzero(more & (n > node_rows))
            if not len(large):
                continue
            to = np.full(len(front), -1)
            to[large] = np.arange(len(large))
            places = {}
            for f, blocks_of in parts.items():
                blocks_of.sort(key=lambda b: b[0])
                before, after = np.zeros((3, len(large))), np.full(len(large), np.nan)
                for at, node, *sums, _ in blocks_of:
                    mine = to[node] >= 0
                    at_ = to[node[mine]]
                    places[f, at] = [at_, *before[:, at_]]
                    before[:, at_] += np.stack([s[mine] for s in sums])
                for at, node, _, _, _, first in reversed(blocks_of):
                    mine = to[node] >= 0
                    at_ = to[node[mine]]
                    places[f, at].append(after[at_])
                    after[at_] = first[mine]
            top_nodes = front[large]
            tasks.append((top.model, top.tree, top.walk(top_nodes), (w[large], pos[large], n[large], places)))
            open_.append((top, top_nodes, w[large], pos[large], n[large]))
        if tasks:
            best = [(np.full((len(o[1]), d), -np.inf), np.zeros((len(o[1]), d)), np.zeros((len(o[1]), d))) for o in open_]
            for r in asked(_cuts, _CUT, tasks):
                node, score, value, nxt = (np.frombuffer(r[c], k) for c, k in (("node", np.int64), ("score", float), ("value", float), ("next", float)))
                f, (scores, values, nexts) = r["feature"], best[r["i"]]
                better = (score > scores[node, f]) | ((score == scores[node, f]) & (value < values[node, f]))
                node = node[better]
                scores[node, f], values[node, f], nexts[node, f] = score[better], value[better], nxt[better]
            for (top, nodes, w, pos, n), (scores, values, nexts) in zip(open_, best):
                feature = _choose(scores, top.key[nodes], top.tree, specs[top.model])
                split, at = feature >= 0, np.arange(len(nodes))
                threshold = midway(values[at, feature], nexts[at, feature])
                top.split(nodes[split], feature[split], threshold[split])
                leaves(top, nodes, w, pos, n)
        depth += 1


def _fit_in_levels(rows, specs, d, node_rows):
    """Upper nodes of all trees level by level over rows that stay in place; nodes of few rows
    are finished in one task each, and only rows of those that can be split move."""
    spark, n, xs = rows.sparkSession, rows.count(), [f"x{j}" for j in range(d)]
    blocks = _value_blocks(rows, d, n)
    n_blocks = blocks.count()
    # a level sends some numbers a (block, tree, node) to the driver: trees grow in turns of bounded size
    turn = max(1, PLACES // (max(1, n_blocks) * max(1, 4 * n // max(1, node_rows))))
    trees, found = [(m, t) for m, s in enumerate(specs) for t in range(s.trees)], None

    def finish(pdf):
        m, tree, depth = (int(pdf[c].iat[0]) for c in ("model", "tree", "depth"))
        key = int(np.int64(pdf["key"].iat[0]).view(np.uint64))
        y, *x = (np.concatenate([np.frombuffer(values)[np.frombuffer(codes, np.uint8)] if len(values) else np.frombuffer(codes)
                                 for codes, values in zip(pdf[c], pdf["v" + c])]) for c in ("y", *xs))
        w = np.concatenate([np.frombuffer(raw, np.uint8) for raw in pdf["w"]]).astype(float)
        return _node_rows(m, tree, grow(np.stack(x), y, w, tree, specs[m], key, depth))

    for a in range(0, len(trees), turn):
        tops, made = _tops_grown(blocks, specs, d, trees[a:a + turn], node_rows)
        level = spark.createDataFrame(pd.concat(made), _NODE) if made else None
        tasks = []
        for t in tops:
            if t.small:
                nodes, depths = np.array(t.small).T
                tasks.append((t.model, t.tree, t.walk(nodes), (t.key[nodes], depths)))
        if tasks:
            shared = spark.sparkContext.broadcast(tasks)
            move, schema = _moved(shared, specs, d)
            node = ["model", "tree", "key"]
            moved = blocks.where("feature = 0").mapInPandas(move, schema).repartition(max(n_blocks, 4 * spark.sparkContext.defaultParallelism), *node)
            done = cut_lineage(moved.groupBy(*node).applyInPandas(finish, _NODE))
            shared.unpersist()
            level = done if level is None else level.union(done)
        if level is not None:
            found = level if found is None else found.union(level)
    return cut_lineage(found if found is not None else spark.createDataFrame([], _NODE))


def draw_cells(grid: dict, n_iter: int | None = None, seed: int = 42) -> list[dict]:
    """All cells of a grid, or ``n_iter`` of them drawn without repetition."""
    total = int(np.prod([len(v) for v in grid.values()]))
    chosen = range(total) if n_iter is None or n_iter >= total else sorted(random.Random(seed).sample(range(total), n_iter))
    cells = []
    for at in chosen:
        cell = {}
        for name, values in grid.items():
            at, i = divmod(at, len(values))
            cell[name] = values[i]
        cells.append(cell)
    return cells


def _shares_of_cells(df, features, label, id_col, fold, cells, folds, params):
    """Held-out accuracies of each cell, every (cell, fold) a forest of its own in the node table."""
    forests = fit(df, features, label, id_col, [Spec(fold=f, **c) for c in cells for f in folds], fold, **params)
    shares = [[0.0] * len(folds) for _ in cells]
    names = [f"_p{i}" for i in range(len(cells))]
    for j, f in enumerate(folds):
        scored = forests.predict(df.where(F.col(fold) == f), id_col, names, [i * len(folds) + j for i in range(len(cells))])
        right = scored.agg(*[F.avg(((2 * F.col(n) > 1) == (F.col(label) > 0)).cast("double")).alias(n) for n in names]).first()
        for i, n in enumerate(names):
            shares[i][j] = right[n]
    return shares


def search(df: DataFrame, features, label: str, id_col: str, fold: str, grid: dict, n_iter: int | None = None, seed: int = 42, **params) -> DataFrame:
    """Cross-validated accuracy of all cells of ``grid`` (K12) or of ``n_iter`` drawn ones.

    ``grid`` maps field names of :class:`Spec` (at least ``trees``, ``max_depth``,
    ``min_split``) to values.  Cells that differ in these three only are read off one
    forest where rows fit one task.  Returns the cell's values, mean, std and place
    (1 is the best)."""
    cells = draw_cells(grid, n_iter, seed)
    read_off = ("trees", "max_depth", "min_split")
    rest = lambda c: tuple((k, v) for k, v in c.items() if k not in read_off)
    folds = [r[0] for r in df.select(F.col(fold).cast("int")).distinct().orderBy(fold).collect()]
    groups: dict = {}
    for c in cells:
        groups.setdefault(rest(c), {}).setdefault((c["max_depth"], c["min_split"]), set()).add(c["trees"])
    groups = {g: {limit: sorted(sizes) for limit, sizes in limits.items()} for g, limits in groups.items()}
    labelled = df.where(F.col(label).isNotNull())
    if labelled.count() * (8 * len(features) + 20) <= params.get("one_task", ONE_TASK):
        specs = [Spec(trees=max(s[-1] for s in limits.values()), fold=f, **dict(g)) for g, limits in groups.items() for f in folds]
        scores = fit(df, features, label, id_col, specs, fold, [limits for limits in groups.values() for _ in folds], **params).scores
        at = {g: i * len(folds) for i, g in enumerate(groups)}
        shares = [[hits[c["max_depth"], c["min_split"]][c["trees"]] / n for hits, n in scores[at[rest(c)]:at[rest(c)] + len(folds)]] for c in cells]
    else:
        shares = _shares_of_cells(labelled, features, label, id_col, fold, cells, folds, params)
    rows = []
    for c, share in zip(cells, shares):
        rows.append((*[None if v is None else int(v) for v in c.values()], float(np.mean(share)), float(np.std(share))))
    rows.sort(key=lambda r: (-r[-2], tuple(-1 if v is None else v for v in r[:-2])))
    schema = ", ".join(f"{n} int" for n in grid) + ", mean double, std double, place int"
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], schema)
