"""Mixing sources to target weights by a low-discrepancy schedule.

1. Every source gets a weight by its rank and a share of the mix.  A share
   stops at ``most`` times the source's size; the excess is dealt out again
   by weight until no share is above (rounds of scalars over the table of
   sources, which is never collected).
2. A source's documents are laid end to end in shuffled order, and this
   stream, repeated as often as its target needs, is cut into blocks of
   ``block`` words.  A source owes one slot for each of its blocks.
3. Slot t of the mix is the golden-ratio point frac(t * 0.618...), mapped
   through the cumulative numbers of owed slots to a source.  The slots of a
   source are ranked; its k-th slot takes its k-th block.  A source that has
   all its blocks skips further points; what a source is still owed after
   the last point (the discrepancy, a few slots) follows at the end.

The last block of a source is cut at its target, so taken words equal the
rounded target, and a word is taken at most ``most`` times (rounded up).

Skew: a source's documents are dealt into cells of about ``CELL`` documents
by a hash; positions are prefix sums within cells plus prefix sums of the
cells.  Points are made and ranked in chunks, then offset by the chunks
before them.  Rows that agree in source, id and size are one run with a
count, cut into parts of ``CELL`` copies, so a hot id is no hot key.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source (the last); a null id is an id like any other; rows that
repeat an id are each a document; other columns are ignored; an empty table
gives an empty result.  The order of documents comes from hashes of id and
size, so reruns agree whatever the partitions.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.plans.ranking import prefix_sums, row_number

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK = 1024            # words of a block
CELL = 1024             # documents of a shuffled cell, copies of a part
CHUNK = 1 << 16         # points made and ranked at a time
BOUNDS = 100_000        # sources whose boundaries a task holds at a time; a larger table is no broadcast
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(source, doc_id, size, copies): equal rows counted."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("source", "doc_id", size.alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (number from 1, source_size) with weight and target."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", w).withColumn("most", F.col("source_size").cast("double") * most)
    size, weight = out.agg(F.sum("source_size"), F.sum("weight")).first()
    if not size:
        return out.withColumn("target", F.lit(0.0)).drop("most")
    level, capped = share * size / weight, 0
    while True:
        above = F.col("most") < F.col("weight") * level
        n, taken, rest = out.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, level = n, (share * size - taken) / rest
    return out.withColumn("target", F.least("most", F.col("weight") * level)).drop("most")


class Sources:
    """The table of sources, written, and joined to others by a checked broadcast."""

    def __init__(self, runs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK):
        sums = (runs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                           F.count("*").alias("n_runs")))
        numbered = row_number(sums, [F.col("source").asc_nulls_last()], out="number")
        need = F.least(F.round("target"), F.col("source_size") * most).cast("long")
        owed = (with_targets(numbered, weights, share, most).withColumn("need", need)
                .withColumn("owed", F.ceil(F.col("need") / block).cast("long")))
        self.rows = written(prefix_sums(owed, ["number"], ["owed"], out_cols=["until"], rank_col=None), "sources")
        self.block, self.spark = block, runs.sparkSession
        self.count, self.slots = self.rows.agg(F.count("*"), F.coalesce(F.sum("owed"), F.lit(0))).first()

    def join(self, df: DataFrame, key: str, *cols: str) -> DataFrame:
        """``df`` with columns of its source."""
        other = self.rows.select(F.col(key).alias("_key"), *cols)
        other = F.broadcast(other) if self.count <= BOUNDS else other
        return df.join(other, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def placed(runs: DataFrame, sources: Sources, seed: int = 0) -> DataFrame:
    """(number, doc_id, size, start): one row per document, ``start`` its place in its
    source's shuffled stream."""
    parts = (sources.join(runs, "source", "number", "n_runs")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CELL))))
             .withColumn("m", F.least(F.lit(CELL), F.col("copies") - F.col("part") * CELL))
             .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "part", F.lit(seed), F.lit("cell")),
                                        F.ceil(F.col("n_runs") / CELL).cast("long")))
             .select("number", "doc_id", "size", "part", "m", "cell",
                     F.xxhash64("doc_id", "size", "part", F.lit(seed)).alias("h")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("number", "cell").orderBy("h", "doc_id", "size", "part"))
    words = F.col("size") * F.col("m")
    cells = (parts.groupBy("number", "cell").agg(F.sum(words).alias("words"))
             .select("number", "cell", F.coalesce(F.sum("words").over(before(Window.partitionBy("number").orderBy("cell"))),
                                                  F.lit(0)).alias("base")))
    return (parts.withColumn("at", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(cells, ["number", "cell"])
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
            .select("number", "doc_id", "size", (F.col("base") + F.col("at") + F.col("copy") * F.col("size")).alias("start")))


def _points(slots: int, shared):
    def run(batches):
        numbers, starts, ends = shared.value
        for pdf in batches:
            for chunk in pdf["id"]:
                t = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, slots), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    x = (t * _GOLDEN).astype(np.float64) / 2.0 ** 64
                spot = np.minimum((x * slots).astype(np.int64), slots - 1)
                t, spot = (v[(spot >= starts[0]) & (spot < ends[-1])] for v in (t.astype(np.int64), spot))
                at = np.searchsorted(ends, spot, side="right")
                order = np.argsort(at, kind="stable")
                at, t = at[order], t[order]
                first = np.searchsorted(at, at, side="left")
                yield pd.DataFrame({"chunk": np.int64(chunk), "number": numbers[at], "local": np.arange(len(at)) - first, "slot": t})
    return run


def slots(sources: Sources) -> DataFrame:
    """(slot, number, k): the place in the mix of the k-th block (from 0) of every source."""
    spark, n = sources.spark, sources.slots
    chunks, found = -(-n // CHUNK), None
    for low in range(0, sources.count, BOUNDS):
        rows = (sources.rows.where(F.col("number").between(low + 1, low + BOUNDS) & (F.col("owed") > 0))
                .select("number", "until", "owed").orderBy("number").toPandas())
        if not len(rows):
            continue
        ends = rows["until"].to_numpy(np.int64)
        shared = spark.sparkContext.broadcast((rows["number"].to_numpy(np.int64), ends - rows["owed"].to_numpy(np.int64), ends))
        part = spark.range(0, chunks, 1, min(chunks, 10_000)).mapInPandas(
            _points(n, shared), "chunk long, number long, local long, slot long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "slot long, number long, k long")
    points = written(found, "points")
    counts = written(points.groupBy("chunk", "number").agg(F.count("*").alias("n")), "hits")
    w = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("chunk", "number", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = points.join(before, ["chunk", "number"]).select("slot", "number", (F.col("before") + F.col("local")).alias("k"))
    used = sources.join(ranked, "number", "owed").where("k < owed").drop("owed")
    hits = counts.groupBy("number").agg(F.sum("n").alias("hits"))
    rest = (sources.rows.select("number", "owed", "until").join(hits, "number", "left")
            .withColumn("hits", F.coalesce("hits", F.lit(0))).where("hits < owed")
            .withColumn("k", F.explode(F.sequence(F.col("hits"), F.col("owed") - 1)))
            .select((F.lit(n) + F.col("until") - F.col("owed") + F.col("k")).alias("slot"), "number", "k"))
    return used.unionByName(rest)


def pieces(placed: DataFrame, sources: Sources) -> DataFrame:
    """(number, k, doc_id, size, start, from_word, to_word): the parts of documents in every owed block."""
    b = sources.block
    lo = F.col("epoch") * F.col("source_size") + F.col("start")
    return (sources.join(placed.where("size > 0"), "number", "source_size", "need").where("start < need")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.expr("(need - 1 - start) div source_size"))))
            .withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("need")))
            .withColumn("k", F.explode(F.sequence(F.expr(f"lo div {b}"), F.expr(f"(hi - 1) div {b}"))))
            .select("number", "k", "doc_id", "size", "start",
                    (F.greatest("lo", F.col("k") * b) - F.col("lo")).alias("from_word"),
                    (F.least("hi", (F.col("k") + 1) * b) - F.col("lo")).alias("to_word")))


def schedule(placed: DataFrame, sources: Sources) -> DataFrame:
    """The mix: (slot, number, k, doc_id, size, start, from_word, to_word).

    Ordered by slot (and ``start`` within it) its rows are the training
    stream; words are counted from 0, ``to_word`` is exclusive."""
    return pieces(placed, sources).join(slots(sources), ["number", "k"])


def taken(mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """(number, doc_id, size, taken) of every document of ``placed``."""
    key = ["number", "doc_id", "size", "start"]
    got = (placed.where("size > 0").select(*key, F.lit(0).cast("long").alias("words"))
           .union(mixed.select(*key, F.col("to_word") - F.col("from_word"))))
    none = placed.where("size = 0").select("number", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return got.groupBy(*key).agg(F.sum("words").alias("taken")).drop("start").union(none)


def mix(docs: DataFrame, text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST,
        block: int = BLOCK, seed: int = 0):
    """(sources, documents in stream order, schedule) of a mix of ``docs``."""
    counted = written(runs(docs, text_col), "runs")
    sources = Sources(counted, weights, share, most, block)
    stream = written(placed(counted, sources, seed), "placed")
    return sources, stream, schedule(stream, sources)


def op11_mixing(spark, sf_dir):
    sources, stream, mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return sources.join(taken(mixed, stream), "number", "source", "source_size", "target").select(
        "doc_id", "source", "size", "source_size", "target", "taken")
