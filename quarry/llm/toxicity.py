"""Toxicity: a counterfactually regularised text classifier.

Features of a text are the presence of its distinct words and of their
beginnings (4, 5 and 6 bytes), hashed.  From a bounded sample of the labelled
rows the features that go with the label are chosen by their z score, and a
logistic model is fitted to them by Newton steps (conjugate gradients on sparse
rows: memory goes with the features that rows hold) on

    log loss + ridge * |w|^2 + fairness * mean (score(x) - score(x'))^2

where x' is x with every identity term swapped for the next term of its
group.  The last term keeps a neutral mention of a group from moving the
score, so that it does not become a sign of toxicity just because it is
frequent in toxic rows.  Identity terms always belong to the chosen features.

Only the text enters a score.  Defined results: a null or empty text gets the
score of the bias alone; a row without a label or with a null label takes no
part in the fit; if an id has labels that disagree, the larger one holds; with no
usable rows (empty tables included) or one class only, every score is that
class's smoothed share; repeated rows are scored each; other columns are
ignored.
"""
from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_CACHE, alnum_words, crc_mod, table, utf8, written

#: Identity terms by group; a term's counterfactual is the next one of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("she", "he"),
    ("gay", "lesbian", "straight", "transgender", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
)
HASH_BITS = 20
PREFIXES = (4, 5, 6)


def swaps(groups=IDENTITY_GROUPS) -> dict[bytes, bytes]:
    return {a.encode(): b.encode() for g in groups for a, b in zip(g, g[1:] + g[:1])}


def word_features(word: bytes) -> set[int]:
    mask = (1 << HASH_BITS) - 1
    return {zlib.crc32(b"w:" + word) & mask} | {
        zlib.crc32(b"p%d:" % n + word[:n]) & mask for n in PREFIXES if len(word) >= n}


def features(words) -> np.ndarray:
    return np.fromiter(set().union(*map(word_features, words)), np.int32)


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        """Score of a text's bytes; the weights of a word's features are looked up once."""
        weights, bias, limit = self.weights, self.bias, WORD_CACHE
        known: dict[bytes, tuple[int, ...]] = {}

        def score(raw: bytes | None) -> float:
            hit: set[int] = set()
            for word in set(alnum_words(raw)) if raw else ():
                own = known.get(word)
                if own is None:
                    if len(known) >= limit:
                        known.clear()
                    own = known[word] = tuple(f for f in word_features(word) if f in weights)
                if own:
                    hit.update(own)
            z = bias + math.fsum(weights[f] for f in sorted(hit))
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        return score


def _extract(pairs: dict[bytes, bytes]):
    def run(batches):
        for pdf in batches:
            out = []
            for label, raw in zip(pdf["label"], pdf["raw"]):
                words = set(alnum_words(raw)) if raw is not None else set()
                swapped = {pairs.get(w, w) for w in words}
                out.append((label, features(words), features(swapped) if swapped != words else None))
            yield pd.DataFrame(out, columns=["label", "x", "other"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    max_rows: int) -> DataFrame:
    """(label, raw): labelled rows of ``docs`` on which ``train`` holds, thinned by a hash
    of the id to about ``max_rows`` rows (all of them, if there are no more)."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & train)
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    return (docs.select("doc_id", utf8("text").alias("raw")).join(known, "doc_id")
            .select("label", "raw"))


class Rows:
    """A 0/1 matrix by its rows' columns; memory goes with the ones, not with rows x columns."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.width = width
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32)
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, v[self.columns], len(self.sizes))

    def back(self, v: np.ndarray) -> np.ndarray:
        """The transpose times ``v``."""
        return np.bincount(self.columns, v[self.owner], self.width)


def conjugate_gradient(matrix, target: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """Solve ``matrix(x) = target`` for a positive definite matrix known by its products, until the
    rest is ``tolerance`` of the target: Newton steps correct what one of them leaves."""
    x, rest = np.zeros(len(target)), target.copy()
    lead = rest / diagonal
    way, size = lead.copy(), rest @ lead
    first = size
    for _ in range(10 * len(target)):
        if size <= tolerance * tolerance * first:
            break
        image = matrix(way)
        far = size / (way @ image)
        x, rest = x + far * way, rest - far * image
        lead = rest / diagonal
        size, before = rest @ lead, size
        way = lead + size / before * way
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None,
        max_rows: int = 8000, min_z: float = 3.5,
        ridge: float = 1.0, fairness: float = 10.0, groups=IDENTITY_GROUPS) -> Model:
    """Fit on at most about ``max_rows`` labelled rows (a bounded sample). Features are
    counted and chosen on Spark; the driver gets the rows' chosen features only."""
    pairs = swaps(groups)
    sample = labelled_sample(docs, labels, label, F.lit(True) if train is None else train, max_rows)
    rows = written(sample.mapInPandas(_extract(pairs), "label int, x array<int>, other array<int>"), "toxicity-sample")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share, prior = positive / max(n, 1), (positive + 0.5) / (n + 1)
    if positive in (0, n):
        return Model(math.log(prior / (1 - prior)))
    # z score of the share of positives among the rows with the feature
    df = F.col("df")
    z = (F.col("hits") - df * share) / F.sqrt(df * share * (1 - share) * F.greatest(1 - df / n, F.lit(1 / n)))
    counts = (rows.select("label", F.explode("x").alias("feature")).groupBy("feature")
              .agg(F.count("*").cast("double").alias("df"), F.sum("label").alias("hits")))
    best = counts.where((df >= 2) & (F.abs(z) >= min_z)).select("feature").collect()
    # identity terms that occur; one that does not could only share the weight of its partner
    named = sorted(set().union(*map(word_features, pairs)))
    best += counts.where(F.col("feature").isin(named)).select("feature").collect()
    chosen = np.array(sorted({r["feature"] for r in best}), np.int64)
    column = {int(f): i for i, f in enumerate(chosen)}
    only = lambda c: F.filter(c, lambda f: f.isin(*map(int, chosen)))
    found = rows.select("label", only("x").alias("x"), only("other").alias("other")).toPandas()
    y, xs, others = found["label"].to_numpy(float), list(found["x"]), list(found["other"])

    bias = len(chosen)
    x = Rows([np.append([column[f] for f in s], bias) for s in xs], bias + 1)
    swapped = [i for i, o in enumerate(others) if o is not None]
    ours, theirs = (Rows([np.array([column[f] for f in side[i]], np.int64) for i in swapped], bias + 1) for side in (xs, others))
    weight = np.append(np.full(bias, ridge), 1e-6)

    def penalty(v: np.ndarray) -> np.ndarray:
        apart = ours.times(v) - theirs.times(v)
        return weight * v + 2 * fairness * (ours.back(apart) - theirs.back(apart))

    w = np.zeros(bias + 1)
    w[-1] = math.log(prior / (1 - prior))
    loss = math.inf
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -35, 35)))
        curve = p * (1 - p)
        step = conjugate_gradient(lambda v: penalty(v) + x.back(curve * x.times(v)), penalty(w) + x.back(p - y),
                                  weight + x.back(curve))
        rate = 1.0
        while rate > 1e-4:
            new = w - rate * step
            s = x.times(new)
            now = np.logaddexp(0, s).sum() - y @ s + 0.5 * new @ penalty(new)
            if now <= loss:
                break
            rate /= 2
        done = loss - now < 1e-7
        w, loss = new, now
        if done:
            break
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(chosen, w) if v})


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score column ``into`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for batch in texts:
            yield pd.Series([score(raw) for raw in batch], dtype=float)

    return docs.withColumn(into, F.pandas_udf(run, "double").asNondeterministic()(utf8(text_col)))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    return (scored(docs, model).select("doc_id", held.alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted")))
