"""Quality classifier: a factorisation machine.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair
term is computed in linear time as half of sum_f (sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2.  The x are a text's hashed words (shares of the text,
scaled to length one), statistics of its structure and its size data
(standardised on the sample), so that pairs mix words with structure.

Only the text enters a score.  Fitted by Adam over a bounded sample of the
labelled rows.  Defined results: a null text is the empty text, whose
statistics are all zero before standardising; labels other than 0 and 1 or
with a null id take no part, the larger of two different labels of an id holds;
without usable rows or with one class only every score is that class's
smoothed share; repeated rows are scored each; other columns are ignored.
"""
from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_CACHE, alnum_words, crc_mod, table, utf8
from quarry.llm.toxicity import labelled_sample

HASH_BITS = 14
RANK = 4
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_STOPS, _MARKS = b".,;:?'\"()-", b"!"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS + _MARKS + b"|")
STATISTICS = ("log_bytes", "log_words", "word_length", "upper", "digits", "blanks", "high", "stops", "marks",
              "bars", "symbols", "distinct", "top_word", "log_lines", "same_lines", "bar_lines", "log_line_words",
              "long_words", "same_words")


def statistics(raw: bytes, words: list[bytes], codes: np.ndarray) -> list[float]:
    """Structure and size of a text; all zero for the empty text."""
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k, m = max(len(words), 1), max(len(lines), 1)
    _, counts = np.unique(codes, return_counts=True)
    return [math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / k, share(_UPPER), share(_DIGIT),
            share(_SPACE), share(_HIGH), share(_STOPS), share(_MARKS), share(b"|"), share(_SYMBOLS),
            len(counts) / k, counts.max() / k if len(counts) else 0.0, math.log1p(len(lines)), 1 - len(set(lines)) / m,
            sum(b"|" in x for x in lines) / m, math.log1p(len(words) / m),
            sum(len(x) > 15 for x in words) / k, float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0]


class Reader:
    """Text bytes -> (statistics, word buckets, word values)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def code(self, word: bytes) -> int:
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        found = self.known[word] = zlib.crc32(word)
        return found

    def __call__(self, raw: bytes | None):
        raw = raw or b""
        words = alnum_words(raw)
        known, code = self.known, self.code
        codes = np.fromiter([known[w] if w in known else code(w) for w in words], np.int64, len(words))
        bucket, counts = np.unique(codes & ((1 << HASH_BITS) - 1), return_counts=True)
        norm = math.sqrt(float((counts * counts).sum())) or 1.0
        return statistics(raw, words, codes), bucket, counts / norm


@dataclass
class Model:
    bias: float
    linear: np.ndarray      # statistics first, then word buckets
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scorer(self):
        reader, s = Reader(), len(STATISTICS)
        word_linear, word_factors = self.linear[s:], self.factors[s:]
        squares = word_factors ** 2

        def score(raw: bytes | None) -> float:
            stats, bucket, value = reader(raw)
            x = np.clip((np.array(stats) - self.centre) / self.scale, -4, 4)
            first = x @ self.linear[:s] + value @ word_linear[bucket]
            sums = x @ self.factors[:s] + value @ word_factors[bucket]
            own = (x * x) @ self.factors[:s] ** 2 + (value * value) @ squares[bucket]
            z = self.bias + float(first) + 0.5 * float((sums * sums - own).sum())
            return 1 / (1 + math.exp(-max(z, -700.0)))
        return score


def _extract(batches):
    reader = Reader()
    for pdf in batches:
        out = [(label, *reader(raw)) for label, raw in zip(pdf["label"], pdf["raw"])]
        yield pd.DataFrame([(a, b, c.astype(np.int32), d.astype(np.float32)) for a, b, c, d in out],
                           columns=["label", "stats", "bucket", "value"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None,
        max_rows: int = 6000, steps: int = 150, rate: float = 0.05, ridge: float = 1e-3,
        seed: int = 7) -> Model:
    """Fit on at most about ``max_rows`` labelled rows (a bounded sample on the driver)."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if train is None else train, max_rows)
    rows = sample.mapInPandas(_extract, "label int, stats array<double>, bucket array<int>, value array<float>").toPandas()
    s, size = len(STATISTICS), len(STATISTICS) + (1 << HASH_BITS)
    y = rows["label"].to_numpy(float) if len(rows) else np.zeros(0)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(prior / (1 - prior))
    if len(y) == 0 or y.min() == y.max():
        return Model(bias, np.zeros(size), np.zeros((size, RANK)), np.zeros(s), np.ones(s))
    stats = np.array(rows["stats"].tolist())
    centre, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    stats = np.clip((stats - centre) / scale, -4, 4)
    counts = rows["bucket"].map(len).to_numpy()
    bucket = np.concatenate(rows["bucket"].to_list()).astype(np.int64)
    value = np.concatenate(rows["value"].to_list()).astype(float)
    row = np.repeat(np.arange(len(y)), counts)
    by_row = lambda v: np.bincount(row, v, len(y))
    by_word = lambda v: np.bincount(bucket, v, size - s)
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(size), rng.normal(0, 0.05, (size, RANK))
    state = [np.zeros(1), linear, factors]
    state[0][0] = bias
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    for step in range(1, steps + 1):
        b, w, v = state
        parts = []
        for f in range(RANK):
            g = value * v[s:, f][bucket]
            parts.append((by_row(g), by_row(g * g)))
        sums = stats @ v[:s] + np.stack([a for a, _ in parts], 1)
        own = (stats ** 2) @ (v[:s] ** 2) + np.stack([b for _, b in parts], 1)
        z = b[0] + stats @ w[:s] + by_row(value * w[s:][bucket]) + 0.5 * (sums ** 2 - own).sum(1)
        d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
        dx = d[row] * value
        gw = np.concatenate([stats.T @ d, by_word(dx)]) + ridge * w / len(y)
        gv, squared = np.empty_like(v), by_word(dx * value)
        for f in range(RANK):
            gv[:s, f] = stats.T @ (d * sums[:, f]) - (stats ** 2).T @ d * v[:s, f]
            gv[s:, f] = by_word(dx * sums[:, f][row]) - squared * v[s:, f]
        gv += ridge * v / len(y)
        for p, g, (m1, m2) in zip(state, (np.array([d.sum()]), gw, gv), moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Model(float(state[0][0]), state[1], state[2], centre, scale)


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score column ``into`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for batch in texts:
            yield pd.Series([score(raw) for raw in batch], dtype=float)

    return docs.withColumn(into, F.pandas_udf(run, "double").asNondeterministic()(utf8(text_col)))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    return (scored(docs, model).select("doc_id", held.alias("held_out"), "score",
                                       (F.col("score") >= 0.5).cast("int").alias("predicted")))
