"""Gradient-boosted trees on binned features, many models at a time.

Features are cut once into quantile bins of a byte; rows are packed into
blocks of bins, labels and folds.  All models (grid cells x folds x members
of a stack) then grow together: one level of every live tree is one pass
over the blocks that adds up gradient histograms by (model, node) and one
aggregate that picks the splits.  Margins are written every few rounds, so a
lost executor costs these at most.  The driver holds models, never rows.

Where the packed rows of all folds stay below ``ONE_TASK`` bytes, no exchange
between rows is needed: they are broadcast once and every model is grown by
one task, with the same sums and splits.  Gradients are rounded to 2^-20, so
sums are exact in any order and both ways give the same trees.

Trees are those of the usual second-order booster: gain
GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l), leaves -G/(H+l) times the rate, a
child needs ``min_weight`` of hessian, ties go to the smaller feature and
bin.  Nulls and NaN lie below all values; rows without a label take no part.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, ship_package

SCALE = float(1 << 20)
MAX_BINS = 255
ONE_TASK = 32 << 20         # packed bytes that are broadcast to tasks of one model each
WRITE_EVERY = 5             # rounds of one model after which margins are written; until then its trees are gone through again
HELD_BYTES = 64 << 20       # sums that a task adds up before it sends them


@dataclass(frozen=True)
class Spec:
    """One model: ``fold`` is the held-out fold (-1: none)."""
    rounds: int = 100
    rate: float = 0.3
    depth: int = 6
    subsample: float = 1.0
    fold: int = -1
    l2: float = 1.0
    min_weight: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in breadth-first order; ``feature`` -1 marks a leaf, the right child follows the left."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row; ``bins`` is (features, rows)."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while len(rows):
            f = feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            here = at[rows]
            at[rows] = left[here] + (bins[f, rows] > cut[here])
        return at


# ------------------------------------------------------------------ binning
def cut_points(df: DataFrame, features, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Up to ``max_bins`` - 2 quantiles of each feature, in one aggregate."""
    probs = F.array(*[F.lit(i / (max_bins - 1)) for i in range(1, max_bins - 1)])
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), probs, 10_000).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def _binned(pdf: pd.DataFrame, features, cuts) -> np.ndarray:
    out = np.zeros((len(features), len(pdf)), np.uint8)
    for i, (c, edges) in enumerate(zip(features, cuts)):
        x = pdf[c].to_numpy(float, na_value=np.nan)
        known = ~np.isnan(x)
        out[i, known] = 1 + np.searchsorted(edges, x[known], side="left")
    return out


_BLOCK = "block string, n long, ids binary, y binary, fold binary, bins binary"


def packed(df: DataFrame, features, label: str, id_col: str, fold: str | None, cuts) -> DataFrame:
    """Rows as blocks of (ids, labels, folds, bins)."""
    features = list(features)

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["_y"].notna()]
            if len(pdf):
                yield pd.DataFrame([(uuid.uuid4().hex, len(pdf), pdf["_id"].to_numpy(np.int64).tobytes(), pdf["_y"].to_numpy(np.uint8).tobytes(),
                                     pdf["_fold"].to_numpy(np.int16).tobytes(), _binned(pdf, features, cuts).tobytes())],
                                   columns=[c.split()[0] for c in _BLOCK.split(", ")])
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"),
                     (F.col(fold).cast("int") if fold else F.lit(-2)).alias("_fold"), *features).mapInPandas(run, _BLOCK)


class Block:
    """A block's arrays, and what a model needs of them."""

    def __init__(self, row, d: int):
        self.name, self.n = row.block, int(row.n)
        self.ids, self.y = np.frombuffer(row.ids, np.int64), np.frombuffer(row.y, np.uint8).astype(float)
        self.fold = np.frombuffer(row.fold, np.int16)
        self.bins = np.frombuffer(row.bins, np.uint8).reshape(d, self.n)

    def gradients(self, margin: np.ndarray, spec: Spec, number: int):
        """Gradient and hessian of the rows that take part in round ``number``, 0 of others."""
        p = 1.0 / (1.0 + np.exp(-margin))
        part = self.fold != spec.fold
        if spec.subsample < 1:
            part &= _uniform(self.ids, spec.seed, number) < spec.subsample
        return np.rint((p - self.y) * SCALE) * part, np.rint(p * (1 - p) * SCALE) * part


def _uniform(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) by row, seed and round, whatever the partitions."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + number)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53


# ------------------------------------------------------------------- splits
def _gain(gl, hl, g, h, spec):
    s = SCALE
    gl, hl, g, h = gl / s, hl / s, g / s, h / s
    gr, hr = g - gl, h - hl
    gain = gl * gl / (hl + spec.l2) + gr * gr / (hr + spec.l2) - g * g / (h + spec.l2)
    return np.where((hl >= spec.min_weight) & (hr >= spec.min_weight), gain, 0.0)


def split_of_histogram(g: np.ndarray, h: np.ndarray, spec: Spec):
    """(feature, cut, gain) of one node from its (features, bins) sums; gain 0: none."""
    gl, hl = g.cumsum(1), h.cumsum(1)
    gain = _gain(gl, hl, gl[:, -1:], hl[:, -1:], spec)
    best = int(gain.argmax())
    feature, cut = divmod(best, gain.shape[1])
    return feature, cut, float(gain[feature, cut])


def splits_of_histograms(g: np.ndarray, h: np.ndarray, spec: Spec):
    """(features, cuts, gains) of many nodes from their (nodes, features, bins) sums."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gain = _gain(gl, hl, gl[:, :, -1:], hl[:, :, -1:], spec).reshape(len(g), -1)
    best = gain.argmax(1)
    feature, cut = np.divmod(best, g.shape[2])
    return feature, cut, gain[np.arange(len(g)), best]


def _histograms(bins, n_bins: int, place: np.ndarray, rows, n_nodes: int, sums):
    """Sums of ``rows`` (None: all) by (node, feature, bin); ``place`` is their node, ``n_nodes`` for none."""
    base = place * n_bins
    weights = sums if rows is None else [w[rows] for w in sums]
    found = np.empty((len(sums), n_nodes, len(bins), n_bins))
    for f, b in enumerate(bins):
        at = base + (b if rows is None else b[rows])
        for s, w in enumerate(weights):
            found[s, :, f] = np.bincount(at, w, (n_nodes + 1) * n_bins)[:n_nodes * n_bins].reshape(n_nodes, n_bins)
    return found


def splits_of_rows(orders, bins, node: np.ndarray, n_nodes: int, g, h, spec: Spec):
    """The same for all nodes of a level from rows in one task: rows in bin order are
    dealt to their nodes, running sums give the left sides."""
    best = np.zeros(n_nodes)
    feature, cut = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
    sizes = np.bincount(node[node >= 0], minlength=n_nodes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for f, order in enumerate(orders):
        where = node[order]
        order = order[where >= 0]
        where = where[where >= 0]
        order = order[np.argsort(where.astype(np.int16 if n_nodes < 32_000 else np.int64), kind="stable")]
        owner = np.repeat(np.arange(n_nodes), sizes)
        gs, hs = g[order].cumsum(), h[order].cumsum()
        g0, h0 = (np.where(starts > 0, s[starts - 1], 0.0) for s in (gs, hs))
        gt, ht = gs[ends - 1] - g0, hs[ends - 1] - h0
        b = bins[f, order]
        last = np.append(b[1:] != b[:-1], True) | np.append(owner[1:] != owner[:-1], True)
        gain = np.where(last, _gain(gs - g0[owner], hs - h0[owner], gt[owner], ht[owner], spec), 0.0)
        top = np.maximum.reduceat(gain, starts)
        spots = np.flatnonzero(gain == top[owner])
        first = spots[np.searchsorted(spots, starts)]
        better = top > best
        best[better], feature[better], cut[better] = top[better], f, b[first][better]
    return feature, cut, best


# ------------------------------------------------------- one model, one task
def boost(block: Block, spec: Spec, stages=()):
    """Grow one model on a block of all rows: (trees, held-out hits at each stage, held-out rows)."""
    orders, flat_bins = [np.argsort(b, kind="stable") for b in block.bins], block.bins.ravel()
    margin, held, numbers = np.zeros(block.n), block.fold == spec.fold, np.arange(block.n)
    trees, hits, n_bins = [], [], int(block.bins.max(initial=0)) + 1
    for number in range(spec.rounds):
        g, h = block.gradients(margin, spec, number)
        tree, node = Tree(), np.zeros(block.n, np.int64)
        open_ = [0]
        place = np.zeros(block.n, np.int64)         # of a row's node in ``open_``; -1: in a leaf
        parents = None                              # sums of the nodes whose children are open, if known
        for depth in range(spec.depth):
            k = len(open_)
            if k * n_bins < block.n:
                if parents is None:
                    sums = _histograms(block.bins, n_bins, np.where(place >= 0, place, k), None, k, (g, h))
                else:       # whole numbers: the larger child is exactly the parent without the smaller
                    size = np.bincount(place[place >= 0], minlength=k)
                    small = np.arange(0, k, 2) + (size[1::2] < size[::2])
                    pair = np.full(k + 1, -1)
                    pair[small] = np.arange(k // 2)
                    rows = np.flatnonzero(pair[place] >= 0)
                    part = _histograms(block.bins, n_bins, pair[place[rows]], rows, k // 2, (g, h))
                    sums = np.empty((2, k, *part.shape[2:]))
                    sums[:, small], sums[:, small ^ 1] = part, parents - part
                feature, cut, gain = splits_of_histograms(*sums, spec)
            else:
                sums = None
                feature, cut, gain = splits_of_rows(orders, block.bins, place, k, g, h, spec)
            split = np.flatnonzero(gain > 0)
            if not len(split):
                break
            lefts = np.full(k, -1)
            lefts[split] = [tree.split(open_[i], int(feature[i]), int(cut[i])) for i in split]
            parents = None if sums is None else sums[:, split]
            # rows of nodes that split go to a child, others stay: a leaf's cut lies above all bins
            above, offset, to = np.full(len(tree.feature), MAX_BINS + 1, np.int16), np.zeros(len(tree.feature), np.int64), np.arange(len(tree.feature))
            here = np.array(open_)[split]
            above[here], offset[here], to[here] = cut[split], np.asarray(feature)[split] * block.n, lefts[split]
            right = flat_bins.take(offset.take(node) + numbers) > above.take(node)
            node = to.take(node) + right
            open_ = [x for left in lefts[split] for x in (left, left + 1)]
            spot = np.full(len(tree.feature), -1)
            spot[open_] = np.arange(len(open_))
            place = spot.take(node)
        _set_values(tree, np.bincount(node, g, len(tree.feature)), np.bincount(node, h, len(tree.feature)), spec)
        margin += np.array(tree.value)[node]
        trees.append(tree)
        if number + 1 in stages:
            hits.append(int(((margin > 0) == (block.y > 0))[held].sum()))
    return trees, hits, int(held.sum())


def _set_values(tree: Tree, g, h, spec: Spec) -> None:
    value = -(g / SCALE) / (h / SCALE + spec.l2) * spec.rate
    tree.value = np.where(np.array(tree.feature) < 0, value, 0.0).tolist()


class Boosted:
    """Fitted models: ``trees[i]`` and held-out (hits, rows) by stage of ``specs[i]``."""

    def __init__(self, features, cuts, specs, trees, scores):
        self.features, self.cuts, self.specs, self.trees, self.scores = list(features), cuts, specs, trees, scores

    def predict(self, df: DataFrame, names, models=None) -> DataFrame:
        """``df`` with the probability of class 1 by each model, as columns ``names``."""
        names, models = list(names), range(len(self.trees)) if models is None else list(models)
        inputs, cuts = self.features, self.cuts
        shared = df.sparkSession.sparkContext.broadcast([self.trees[m] for m in models])

        def run(*columns: pd.Series) -> pd.DataFrame:
            bins = _binned(pd.DataFrame(dict(zip(inputs, columns))), inputs, cuts)
            out = {}
            for name, trees in zip(names, shared.value):
                margin = np.zeros(bins.shape[1])
                for t in trees:
                    margin += np.array(t.value)[t.leaves(bins)]
                out[name] = 1.0 / (1.0 + np.exp(-margin))
            return pd.DataFrame(out)

        score = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
        new = score(*[F.col(c).cast("double") for c in inputs])
        return df.select("*", new.alias("_scores")).select(*df.columns, *[F.col(f"_scores.{n}").alias(n) for n in names])


def fit(df: DataFrame, features, label: str, id_col: str, specs, fold: str | None = None, stages=(), max_bins: int = MAX_BINS,
        keep_trees: bool = True, one_task: int = ONE_TASK) -> Boosted:
    """Fit all ``specs`` on ``df``; ``stages`` are numbers of rounds after which held-out rows are scored."""
    spark, specs, features = df.sparkSession, list(specs), list(features)
    ship_package(spark)
    cuts = cut_points(df, features, max_bins)
    blocks = _written(packed(df, features, label, id_col, fold, cuts), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (len(features) + 11)
    run = _fit_in_tasks if size <= one_task else _fit_in_passes
    trees, scores = run(blocks, len(features), specs, tuple(stages), keep_trees)
    return Boosted(features, cuts, specs, trees, scores)


def _fit_in_tasks(blocks, d, specs, stages, keep_trees):
    spark = blocks.sparkSession
    rows = blocks.drop("block").collect()           # below ``one_task`` bytes
    whole = {c: b"".join(r[c] for r in rows) for c in ("ids", "y", "fold")}
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(d, -1) for r in rows] or [np.zeros((d, 0), np.uint8)], axis=1)
    shared = spark.sparkContext.broadcast(pd.Series(whole | {"block": "", "n": bins.shape[1], "bins": bins.tobytes()}))

    def run(batches):
        import pickle
        block = Block(shared.value, d)
        for pdf in batches:
            for k in pdf["k"]:
                trees, hits, n = boost(block, specs[k], stages)
                yield pd.DataFrame({"k": [k], "hits": [hits], "n": [n], "trees": [pickle.dumps(trees) if keep_trees else b""]})

    import pickle
    # the slowest models first, dealt one by one
    order = sorted(range(len(specs)), key=lambda k: -specs[k].rounds * specs[k].depth)
    parts = min(len(order), 4 * spark.sparkContext.defaultParallelism)
    tasks = spark.createDataFrame(pd.DataFrame({"k": order, "p": [i % parts for i in range(len(order))]}))
    done = tasks.repartitionByRange(parts, "p").select("k").mapInPandas(run, "k long, hits array<long>, n long, trees binary").collect()
    trees, scores = [None] * len(specs), [None] * len(specs)
    for r in done:
        trees[r["k"]] = pickle.loads(r["trees"]) if keep_trees else []
        scores[r["k"]] = (list(r["hits"]), r["n"])
    return trees, scores


# ---------------------------------------------------- many models, many passes
def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STATE = _BLOCK + ", margins binary"
_SUMS = "model long, node long, g binary, h binary"


def _fit_in_passes(blocks, d, specs, stages, keep_trees):
    spark = blocks.sparkSession
    sc = spark.sparkContext
    state = blocks.withColumn("margins", F.lit(None).cast("binary"))
    trees, scores = [[] for _ in specs], [([], 0) for _ in specs]
    pending: list = []          # trees of the rounds since margins were written
    every, last = max(1, WRITE_EVERY // max(1, len(specs))), max((s.rounds for s in specs), default=0)

    def margins_of(row, block, pending):
        margins = np.zeros((len(specs), block.n)) if row.margins is None else np.frombuffer(row.margins).reshape(len(specs), block.n).copy()
        for grown in pending:
            for k, tree in grown.items():
                margins[k] += np.array(tree.value)[tree.leaves(block.bins)]
        return margins

    for number in range(last):
        live = {k: Tree() for k, s in enumerate(specs) if number < s.rounds}
        frontier = {k: [0] for k in live}

        def sums(batches, shared, leaves):
            """Histograms of open nodes (or, at the end, sums of all nodes) by model, added up in the task."""
            live, frontier, pending = shared.value
            held: dict = {}

            def out():
                rows = [(*at, *(x.tobytes() for x in found)) for at, found in held.items()]
                held.clear()
                return pd.DataFrame(rows, columns=["model", "node", "g", "h"])

            def add(k, x, *found):
                mine = held.setdefault((k, x), [np.zeros(f.shape, np.int64) for f in found])
                for whole, f in zip(mine, found):
                    whole += f.astype(np.int64)
            for pdf in batches:
                for row in pdf.itertuples():
                    block = Block(row, d)
                    margins = margins_of(row, block, pending)
                    for k, tree in live.items():
                        if not (leaves or frontier.get(k)):
                            continue
                        g, h = block.gradients(margins[k], specs[k], number)
                        node = tree.leaves(block.bins)
                        if leaves:
                            n = len(tree.feature)
                            add(k, -1, np.bincount(node, g, n), np.bincount(node, h, n))
                            continue
                        for x in frontier[k]:
                            rows = np.flatnonzero(node == x)
                            if len(rows):
                                add(k, x, *(np.stack([np.bincount(b[rows], w[rows], 256) for b in block.bins]) for w in (g, h)))
                    if len(held) * d * 4096 > HELD_BYTES:
                        yield out()
            if held:
                yield out()

        def added(pdf):
            return [sum(np.frombuffer(x, np.int64) for x in pdf[c]).astype(float) for c in ("g", "h")]

        def choose(pdf):
            g, h = (x.reshape(d, 256) for x in added(pdf))
            k = int(pdf["model"].iat[0])
            return pd.DataFrame([(k, int(pdf["node"].iat[0]), *split_of_histogram(g, h, specs[k]))], columns=["model", "node", "feature", "cut", "gain"])

        def values(pdf):
            g, h = added(pdf)
            return pd.DataFrame({"model": pdf["model"].iloc[:1], "g": [g.tolist()], "h": [h.tolist()]})

        for depth in range(max(specs[k].depth for k in live)):
            frontier = {k: x for k, x in frontier.items() if depth < specs[k].depth and x}
            if not frontier:
                break
            shared = sc.broadcast((live, frontier, pending))
            found = (state.mapInPandas(lambda b, s=shared: sums(b, s, False), _SUMS).groupBy("model", "node")
                     .applyInPandas(choose, "model long, node long, feature int, cut int, gain double").where("gain > 0").collect())
            frontier = {k: [] for k in live}
            for r in sorted(found, key=lambda r: (r["model"], r["node"])):
                left = live[r["model"]].split(r["node"], r["feature"], r["cut"])
                frontier[r["model"]] += [left, left + 1]
        shared = sc.broadcast((live, frontier, pending))
        for r in (state.mapInPandas(lambda b, s=shared: sums(b, s, True), _SUMS).groupBy("model")
                  .applyInPandas(values, "model long, g array<double>, h array<double>").collect()):
            _set_values(live[r["model"]], np.array(r["g"]), np.array(r["h"]), specs[r["model"]])
        for k, tree in live.items():
            trees[k].append(tree)
        pending = [*pending, live]
        shared = sc.broadcast(pending)
        if number + 1 in stages:
            def hits(batches, shared=shared):
                for pdf in batches:
                    for row in pdf.itertuples():
                        block = Block(row, d)
                        right = (margins_of(row, block, shared.value) > 0) == (block.y > 0)
                        yield pd.DataFrame([(k, int(right[k][block.fold == s.fold].sum()), int((block.fold == s.fold).sum()))
                                            for k, s in enumerate(specs)], columns=["k", "hits", "n"])
            for r in state.mapInPandas(hits, "k long, hits long, n long").groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect():
                if number < specs[r["k"]].rounds:
                    scores[r["k"]] = (scores[r["k"]][0] + [r["hits"]], r["n"])
        if len(pending) >= every and number + 1 < last:
            def update(batches, shared=shared):
                for pdf in batches:
                    for row in pdf.itertuples():
                        margins = margins_of(row, Block(row, d), shared.value)
                        yield pd.DataFrame([(*row[1:-1], margins.tobytes())], columns=[c.split()[0] for c in _STATE.split(", ")])

            state, pending = _written(state.mapInPandas(update, _STATE), "margins"), []
    return trees, scores


def grid_search(df: DataFrame, features, label: str, id_col: str, fold: str, rounds, rates, depths, subsamples=(1.0,), **params) -> DataFrame:
    """Cross-validated accuracy of every cell (K12): (n_estimators, learning_rate, max_depth,
    subsample, mean, std, place).  Cells that differ in the number of rounds
    only are stages of one model.  ``fold`` holds 0, 1, ...; place 1 is the best cell."""
    folds = [r[0] for r in df.select(F.col(fold).cast("int")).distinct().orderBy(fold).collect()]
    cells = [(rate, depth, sub) for rate in rates for depth in depths for sub in subsamples]
    specs = [Spec(max(rounds), rate, depth, sub, f) for rate, depth, sub in cells for f in folds]
    stages = sorted(rounds)
    model = fit(df, features, label, id_col, specs, fold, stages, keep_trees=False, **params)
    rows = []
    for c, (rate, depth, sub) in enumerate(cells):
        mine = model.scores[c * len(folds):(c + 1) * len(folds)]
        for s, n in enumerate(stages):
            share = [hits[s] / held for hits, held in mine]
            rows.append((n, float(rate), depth, float(sub), float(np.mean(share)), float(np.std(share))))
    rows.sort(key=lambda r: (-r[4], r[:4]))
    return df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)],
                                           "n_estimators int, learning_rate double, max_depth int, subsample double, mean double, std double, place int")
