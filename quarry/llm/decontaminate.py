"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the item windows: every ``window`` consecutive words of an
item, or the whole item where it is shorter.  Patterns of one length share a
matcher.  A matcher slides over a document's words and looks at the block of
the last two words under the pattern window: the shift table says how far the
window can move before that block could fit any pattern; at shift 0 the
suffix bucket (patterns ending in that block) lists the strings to compare
directly.  The documents are scanned where they lie: no shuffle.

The benchmark is not assumed small.  Its patterns are cut into blocks of at
most ``max_patterns`` windows by a hash of the item; each block is one
broadcast of bounded size and one more pass over the documents' words.

Defined results: a null or empty text has no words and no hits; an item
without words or with a null id has no windows; rows that repeat an item id
add windows to that item; repeated document rows are scanned each; other
columns are ignored.
"""
from __future__ import annotations

from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import alnum_words, table, utf8

BLOCK = 2


class Matcher:
    """Wu-Manber tables for patterns (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple, list], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(pattern[-self.block:], {})[pattern] = items

    def find(self, words: list) -> Iterator[tuple[int, list]]:
        """(start, item numbers) of every occurrence of a pattern."""
        shift, default, m, b = self.shift.get, self.default, self.length, self.block
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b:end])
            step = shift(key, default)
            if step:
                end += step
                continue
            items = self.bucket[key].get(tuple(words[end - m:end]))
            if items is not None:
                yield end - m, items
            end += 1


def matchers(rows: list[tuple]) -> list[Matcher]:
    """rows: (item number, list of words of one window)."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, words in rows:
        found = by_length.setdefault(len(words), {}).setdefault(tuple(words), [])
        if item not in found:
            found.append(item)
    return [Matcher(p, m) for m, p in sorted(by_length.items())]


def _windows(window: int):
    def run(batches):
        for pdf in batches:
            out = []
            for item, raw in zip(pdf["item_id"], pdf["raw"]):
                words = alnum_words(raw) if raw is not None else []
                if len(words) <= window:
                    out += [(item, words)] if words else []
                else:
                    out += [(item, words[i:i + window]) for i in range(len(words) - window + 1)]
            yield pd.DataFrame({"item_id": [a for a, _ in out], "words": [b for _, b in out]},
                               dtype=object)
    return run


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(item_id string, words array<binary>): the windows of every item, in place."""
    return (benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("raw"))
            .mapInPandas(_windows(window), "item_id string, words array<binary>"))


def _scanner(shared):
    def run(series: Iterator[Tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, rows = shared.value
        machines = matchers(rows)
        for raws, masks, found in series:
            out = []
            for raw, mask, before in zip(raws, masks, found):
                words = alnum_words(raw) if raw is not None else []
                hits, items = [], set()
                for machine in machines:
                    for start, numbers in machine.find(words):
                        hits.append((start, start + machine.length))
                        items.update(numbers)
                ids = sorted({names[i] for i in items if i is not None} | set(before))
                n_hit = 0
                if hits or mask is not None:
                    inside = (np.zeros(len(words), bool) if mask is None else
                              np.unpackbits(np.frombuffer(mask, np.uint8), count=len(words)).astype(bool))
                    for a, b in hits:
                        inside[a:b] = True
                    mask, n_hit = np.packbits(inside).tobytes(), int(inside.sum())
                out.append((len(words), n_hit, mask, ids))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "mask", "items"])
    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10,
         max_patterns: int = 200_000) -> DataFrame:
    """All columns of ``docs`` plus ``hit`` struct(n_words, n_hit, mask, items).

    ``mask`` has one bit per word (set: inside an occurrence; null: no
    occurrence), ``items`` the ids of the items found, sorted as strings."""
    windows = item_windows(benchmark, window).distinct()
    n = windows.count()
    blocks = max(1, -(-n // max_patterns))
    kind = "n_words long, n_hit long, mask binary, items array<string>"
    out = docs.withColumn("hit", F.lit(None).cast("struct<n_words:bigint,n_hit:bigint,mask:binary,items:array<string>>"))
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()
        names = sorted({r["item_id"] for r in part if r["item_id"] is not None})
        number = {name: i for i, name in enumerate(names)} | {None: None}
        shared = docs.sparkSession.sparkContext.broadcast(
            (names, [(number[r["item_id"]], [bytes(w) for w in r["words"]]) for r in part]))
        search = F.pandas_udf(_scanner(shared), kind).asNondeterministic()
        out = out.withColumn("hit", search(
            utf8(text_col), F.col("hit.mask"), F.coalesce(F.col("hit.items"), F.array().cast("array<string>"))))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    kept = scan(docs.select(F.struct("*").alias("row"), F.col(params.pop("text_col", "text")).alias("text")), benchmark, **params)
    return kept.where(F.col("hit.mask").isNull()).select("row.*")


def op4_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("hit.n_words").alias("n_words"),
        F.col("hit.n_hit").alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        F.col("hit.mask").isNotNull().alias("contaminated"))

