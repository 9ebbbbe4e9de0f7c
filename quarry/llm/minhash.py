"""Near-duplicate groups: MinHash with banding, verification and components.

1. Every document's set of word shingles gets ``bands * rows`` minima of
   universal hashes (a * x + b mod 2^64) and a fingerprint.  Documents with
   one set form a class; from here on a class is one node, its smallest id.
2. A node falls into one bucket per band.  Buckets of one node are dropped.
3. In every bucket each node is paired with the bucket's smallest node.  A
   pair must pass the size bound and agree in enough minima.  In each of a few
   rounds a node is confirmed on the full sets against the one candidate that
   agrees best and is still in another component.  Links give components
   (large-star, small-star).
4. Buckets that still hold several components are cut into cells of two
   blocks.  A cell keeps the nodes whose minima agree enough with a node of
   another component; their full sets are brought to the cell, compared there,
   and only links that join two components of the cell leave it.

So no bucket is listed as pairs and no member is left out: two nodes of a
bucket end in one component, or their minima were compared; what leaves a
step is at most one pair a node and cell.

Defined results: documents without words (null or empty texts) and rows with
a null id link with nothing; rows that repeat an id are one document, which
links by any of its texts (n_shingles is the row's own); a null id has no
component and is kept; ties go to the smaller id; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_CACHE, space_words, table, utf8, written
from quarry.llm.components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
SIMILARITY = 75         # percent
AGREE = 0.57            # share of equal minima below which a pair at 0.75 is out of reach (4.7 deviations)
STAR_ROUNDS = 2         # rounds of one candidate a node, before open buckets are compared
BLOCK = 512             # nodes of a bucket compared with as many others at a time
BLOCK_SHINGLES = 2 << 20    # their shingles, about; a bucket of longer texts has more blocks
FILTER_BITS = 1 << 23

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text's bytes."""

    def __init__(self, shingle: int = SHINGLE):
        self.k, self.known = shingle, {}

    def word(self, w: bytes) -> int:
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        found = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return found

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = space_words(raw) if raw else []
        if not words:
            return np.zeros(0, np.uint64)
        known, word = self.known, self.word
        h = np.fromiter([known[w] if w in known else word(w) for w in words], np.uint64, len(words))
        k = min(self.k, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                out = out * _MIX + h[i:len(h) - k + 1 + i]
                out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            return np.unique(out ^ (out >> np.uint64(32)))


class Minima:
    """Minima of universal hashes; the high half of each."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda: rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a, self.b = draw()[:, None], draw()[:, None]
        self.room = np.empty((count, 1024), np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 1024):
            part = x[None, i:i + 1024]
            room = self.room[:, :part.shape[1]]
            np.multiply(self.a, part, out=room)
            np.add(room, self.b, out=room)
            np.minimum(best, room.min(1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)


def _signatures(shingle: int, count: int):
    def run(batches):
        shingles, minima = Shingler(shingle), Minima(count)
        for pdf in batches:
            out = []
            for i, raw in zip(pdf["doc_id"], pdf["raw"]):
                x = shingles(raw)
                out.append((i, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None,
                            minima(x).tobytes() if len(x) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "print", "minima"]).astype({"doc_id": "Int64"})
    return run


def signatures(docs: DataFrame, shingle: int = SHINGLE, count: int = BANDS * ROWS, text_col: str = "text") -> DataFrame:
    """(doc_id, n, print, minima) of every row; print and minima are null without words."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
            .mapInPandas(_signatures(shingle, count), "doc_id long, n long, print binary, minima binary"))


def id_field(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit field for (perhaps) belonging to ``ids``, of fixed size whatever the number of ids.
    It lets through some others, never drops one."""
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    rows = (ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("m")).toPandas())
    field = np.zeros(bits >> 5, np.int64)
    field[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return field.astype(np.uint32)


def _sets(shingle: int, field):
    """Sets of the rows in the broadcast bit field: test and sets in one worker a task."""
    def run(batches):
        shingles, held = Shingler(shingle), field.value
        for pdf in batches:
            slot = pdf["slot"].to_numpy()
            pdf = pdf[(held[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1]
            yield pd.DataFrame({"node": pdf["node"].to_numpy(np.int64), "members": [shingles(raw).tobytes() for raw in pdf["raw"]]})
    return run


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(node, members): the distinct full sets of the documents in ``nodes``; others hardly leave the scan."""
    field = id_field(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    node = F.col("doc_id").cast("long")
    found = (docs.select(node.alias("node"), F.pmod(F.xxhash64(node), F.lit(32 * len(field))).alias("slot"), utf8(text_col).alias("raw"))
             .where(F.col("node").isNotNull() & F.col("raw").isNotNull())
             .mapInPandas(_sets(shingle, shared), "node long, members binary"))
    return written(found.where(F.length("members") > 0).join(nodes, "node", "left_semi").dropDuplicates(["node", "members"]), "sets")


def _confirm(batches):
    for pdf in batches:
        keep = []
        for a, b in zip(pdf["x"], pdf["y"]):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
        yield pdf.loc[keep, ["u", "v"]]


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """The pairs (u, v) that reach the similarity on the full sets.

    Only texts of documents in a pair are moved and cut into sets again."""
    nodes = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "paired")
    sets = sets_of(docs, nodes, shingle, text_col)
    return (pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("x")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("members").alias("y")), "v")
            .mapInPandas(_confirm, "u long, v long"))


def _agreeing(batches):
    for pdf in batches:
        agree = np.zeros(len(pdf), np.int64)
        if len(pdf):
            a = np.frombuffer(b"".join(pdf["x"]), np.uint32).reshape(len(pdf), -1)
            b = np.frombuffer(b"".join(pdf["y"]), np.uint32).reshape(len(pdf), -1)
            agree = (a == b).sum(1)
            pdf = pdf.assign(agree=agree).loc[agree >= AGREE * a.shape[1]]
        else:
            pdf = pdf.assign(agree=agree)
        yield pdf[["u", "v", "agree"]]


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, agree): the pairs whose minima agree often enough."""
    return (pairs.join(nodes.select(F.col("node").alias("u"), F.col("minima").alias("x")), "u")
            .join(nodes.select(F.col("node").alias("v"), F.col("minima").alias("y")), "v")
            .select("u", "v", "x", "y").mapInPandas(_agreeing, "u long, v long, agree long"))


def best_apart(likely: DataFrame, linked: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """Of each v the untested pair (u, v) across components that agrees best (ties: the smaller u)."""
    if linked is not None:
        of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        likely = (likely.join(of("u"), "u", "left").join(of("v"), "v", "left")
                  .where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).join(tested, ["u", "v"], "left_anti"))
    best = F.max(F.struct("agree", (-F.col("u")).alias("u")))
    return likely.groupBy("v").agg(best.alias("best")).select((-F.col("best.u")).alias("u"), "v")


def _asking(component: np.ndarray) -> np.ndarray:
    """Places of the nodes outside the cell's largest component: every pair across has one."""
    names, counts = np.unique(component, return_counts=True)
    return np.flatnonzero(component != names[counts.argmax()])


def _near(group: pd.DataFrame, rows: int) -> pd.DataFrame:
    """The rows of a cell whose minima agree enough with a node of another component.

    A pair belongs to the first bucket that both nodes share."""
    i, j, band = (int(group[c].iat[0]) for c in ("i", "j", "band"))
    component, n, block = (group[c].to_numpy() for c in ("component", "n", "block"))
    minima = np.frombuffer(b"".join(group["minima"]), np.uint32).reshape(len(group), -1)
    least = AGREE * minima.shape[1]
    near = np.zeros(len(group), bool)
    for k in _asking(component):
        fits = (component != component[k]) & (100 * np.minimum(n, n[k]) >= SIMILARITY * np.maximum(n, n[k]))
        if i != j:
            fits &= block != block[k]
        at = np.flatnonzero(fits)
        same = minima[at] == minima[k]
        close = same.sum(1) >= least
        at, same = at[close], same[close]
        at = at[same.reshape(len(at), same.shape[1] // rows, rows).all(2).argmax(1) == band]
        if len(at):
            near[k] = near[at] = True
    return group.loc[near, ["bucket", "i", "j", "block", "node", "component"]]


def _join_up(group: pd.DataFrame) -> pd.DataFrame:
    """Links on the full sets that join components of a cell: a spanning forest, not all pairs."""
    i, j = int(group["i"].iat[0]), int(group["j"].iat[0])
    node, block = group["node"].to_numpy(), group["block"].to_numpy()
    component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(m, np.uint64) for m in group["members"]]
    n = np.array([len(x) for x in sets])
    starts = np.cumsum(n) - n
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, out = np.zeros(len(known), np.int32), []
    for k in _asking(component):
        fits = (component != component[k]) & (100 * np.minimum(n, n[k]) >= SIMILARITY * np.maximum(n, n[k]))
        if i != j:
            fits &= block != block[k]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        own = flat[starts[k]:starts[k] + n[k]]
        held[own] = 1
        if 8 * len(at) < len(n):
            both = np.array([held[flat[starts[x]:starts[x] + n[x]]].sum() for x in at])
        else:
            both = np.add.reduceat(held[flat], starts)[at]
        held[own] = 0
        for x in at[100 * both >= SIMILARITY * (n[k] + n[at] - both)]:
            if component[x] != component[k]:
                out.append((min(node[k], node[x]), max(node[k], node[x])))
                component[component == component[x]] = component[k]
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def _cellwise(fn):
    """Cut batches sorted by (bucket, i, j) into cells and apply ``fn`` to each of two nodes or more."""
    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["bucket", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            edges = [0, *cuts]
            found = [fn(pdf.iloc[a:b]) for a, b in zip(edges, edges[1:]) if b - a > 1]
            rest = pdf.iloc[edges[-1]:] if len(pdf) else None
            if found:
                yield pd.concat(found)
        if rest is not None and len(rest) > 1:
            yield fn(rest)
    return run


def _by_cell(cells: DataFrame) -> DataFrame:
    return cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def open_buckets(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(bucket, band, blocks, node, component) of the buckets that hold several components."""
    now = (members.join(linked, "node", "left")
           .select("bucket", "band", "node", "n", F.coalesce("component", "node").alias("component")))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = (now.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), blocks.alias("blocks"))
             .where("a <> b").select("bucket", "blocks"))
    return written(now.drop("n").join(written(mixed, "mixed"), "bucket"), "open")


def links_across(opened: DataFrame, minima: DataFrame, docs: DataFrame, shingle: int, rows: int, text_col: str) -> DataFrame:
    """Links (u, v) that join the components of every open bucket wherever full sets reach the similarity."""
    cells = (opened.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "node", "component").join(minima, "node"))
    near = written(_by_cell(cells).mapInPandas(
        _cellwise(lambda cell: _near(cell, rows)),
        "bucket long, i int, j int, block int, node long, component long").distinct(), "near")
    ids = written(near.select("node").distinct(), "near-ids")
    sets = sets_of(docs, ids, shingle, text_col)
    return _by_cell(near.join(sets, "node")).mapInPandas(_cellwise(_join_up), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed = written(signatures(docs, shingle, bands * rows, text_col), "signatures")
    nodes = written(signed.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
                    .groupBy("print").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"),
                                          F.min_by("minima", "doc_id").alias("minima")), "nodes")
    width = 4 * rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("minima", 1 + width * b, width)) for b in range(bands)])
    buckets = nodes.select("node", "n", F.posexplode(keys).alias("band", "bucket"))
    firsts = written(buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("first"))
                     .where("size > 1").select("bucket", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")), "firsts")
    members = written(buckets.join(firsts, "bucket"), "members")
    stars = (members.where((F.col("node") != F.col("first"))
                           & (100 * F.least("n", "first_n") >= SIMILARITY * F.greatest("n", "first_n")))
             .select(F.col("first").alias("u"), F.col("node").alias("v")).distinct())
    minima = nodes.select("node", "n", "minima")
    likely = written(agreeing(stars, minima).groupBy("u", "v").agg(F.max("agree").alias("agree")), "likely")
    # an id with several texts is one document: its classes are linked by it
    repeated = written(signed.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
                       .agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select("doc_id"), "repeated")
    links = written(signed.join(repeated, "doc_id", "left_semi").join(nodes, "print")
                    .select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct(), "links")
    linked = tested = None
    for _ in range(STAR_ROUNDS):
        pairs = written(best_apart(likely, linked, tested), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = links.union(written(confirmed(pairs, docs, shingle, text_col), "links"))
        linked = components(links)
    more = written(links_across(open_buckets(members, linked), minima, docs, shingle, rows, text_col), "links")
    linked = components(links.union(more))
    classes = written(nodes.select("print", "node").join(linked, "node", "left")
                      .select("print", F.coalesce("component", "node").alias("component")), "classes")
    whole = signed.select("doc_id", "n", "print").join(classes, "print", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
                        F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each group (the smallest id), all columns."""
    gone = near_duplicates(docs, **params).where(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct()
    return (docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("node"))
            .join(gone, "node", "left_anti").select("row.*"))


def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
