"""Ranked lexical search with per-term geometric blocking.

1. Whole texts are cut into terms; what counts for the queries (their terms'
   occurrences) is packed into shards of at most ``SHARD`` documents and
   ``POSTINGS`` postings, in place.  Document counts, lengths and document
   frequencies cover the whole table.
2. In a shard every posting list is clustered by document similarity:
   documents are projected to ``SKETCH`` dimensions, spread representatives
   are taken from the list, each document joins the nearest one.  A cluster
   is a block; its summary holds the coordinatewise maximum of its
   documents' impacts, over the terms that occur in a query with this one,
   rounded up to a byte.
3. A query's threshold starts from the exact scores of the documents in its
   most promising blocks of every shard: the 50th best of these is at most
   the 50th best of all.
4. A block of one of the query's lists is skipped only if its summary bound
   lies below the threshold; the documents of all others are scored exactly
   from their own vectors.  A document with a score above 0 lies in the list
   of each query term it holds, so it is scored or proven out.

Lists of terms that weigh little are skipped whole: the terms of a query are
ordered by their greatest contribution, and as long as the sum of the first
ones stays below the threshold, a document that holds no other term is out.

Queries go out in batches of bounded size (``PAIRS`` (item, term) pairs);
each batch is a pass of its own.  Nothing is shuffled but hits.

Defined results: a null or empty text (of a document or an item) has no
terms; rows that repeat an item id are one item with the terms of all its
rows; a null item id is an item; documents that repeat an id, or have a null
one, are ranked each (nulls after others where scores are equal); other
columns are ignored; empty tables give an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import alnum_words, table, utf8, written

TOP = 50
SHARD, POSTINGS = 4096, 1_000_000
BLOCK, SKETCH = 64, 32
PAIRS = 200_000         # (item, term) pairs of a batch: the bound of what is broadcast
_NULL = np.iinfo(np.int64).max
_SHARD = "ids binary, nulls binary, lens binary, ptr binary, term binary, tf binary, docs long, words long"
_INDEX = "ids binary, nulls binary, ptr binary, term binary, impact binary, lists binary, blocks binary, members binary, edges binary, coords binary, high binary"


def _cut(batches):
    for pdf in batches:
        out = [(i, w.decode("utf-8", "replace")) for i, raw in zip(pdf["item_id"], pdf["raw"]) if raw
               for w in set(alnum_words(raw))]
        yield pd.DataFrame(out, columns=["item_id", "word"]).astype({"item_id": "Int64"})


def item_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(item_id, word): the distinct terms of every item."""
    return (items.select(F.col("item_id").cast("long").alias("item_id"), utf8(text_col).alias("raw"))
            .mapInPandas(_cut, "item_id long, word string").distinct())


def _pack(words_shared):
    number = None

    def run(batches):
        nonlocal number
        number = number or {w.encode(): i for i, w in enumerate(words_shared.value)}
        ids, nulls, lens, counts, terms, tfs = [], [], [], [], [], []
        docs = total = held = 0

        def flush():
            return pd.DataFrame([(np.array(ids, np.int64).tobytes(), np.array(nulls, bool).tobytes(), np.array(lens, np.int64).tobytes(),
                                  np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes(),
                                  np.array(terms, np.int32).tobytes(), np.array(tfs, np.int64).tobytes(), docs, total)],
                                columns=["ids", "nulls", "lens", "ptr", "term", "tf", "docs", "words"])

        for pdf in batches:
            for i, raw in zip(pdf["doc_id"], pdf["raw"]):
                words = alnum_words(raw) if raw else []
                if not words:
                    continue
                docs, total = docs + 1, total + len(words)
                tf: dict[int, int] = {}
                for t in map(number.get, words):
                    if t is not None:
                        tf[t] = tf.get(t, 0) + 1
                if tf:
                    ids.append(_NULL if pd.isna(i) else int(i))
                    nulls.append(pd.isna(i))
                    lens.append(len(words))
                    counts.append(len(tf))
                    terms += tf.keys()
                    tfs += tf.values()
                    held += len(tf)
                if len(ids) >= SHARD or held >= POSTINGS:
                    yield flush()
                    ids, nulls, lens, counts, terms, tfs = [], [], [], [], [], []
                    docs = total = held = 0
        if docs:
            yield flush()
    return run


def shards(docs: DataFrame, words, text_col: str = "text") -> DataFrame:
    """Packed shards: ids, lengths and (term, tf) vectors of documents that hold a query term;
    ``docs`` and ``words`` count all documents read with them."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
            .mapInPandas(_pack(words), _SHARD))


def _frequencies(batches):
    for pdf in batches:
        term = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["term"]] or [np.zeros(0, np.int32)])
        at, n = np.unique(term, return_counts=True)
        yield pd.DataFrame({"term": at.astype(np.int64), "n": n.astype(np.int64)})


class Queries:
    """A batch of queries in arrays: terms, weights, and which terms occur in a query with which."""

    def __init__(self, pairs: list[tuple], words: list[str], df: np.ndarray, n_docs: int, n_words: int):
        number = {w: i for i, w in enumerate(words)}
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        place = {i: k for k, i in enumerate(self.items)}
        self.terms: list = [[] for _ in self.items]
        for i, w in pairs:
            self.terms[place[i]].append(number[w])
        self.terms = [np.array(sorted(t), np.int64) for t in self.terms]
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.queries: list = [[] for _ in words]
        for q, t in enumerate(self.terms):
            for x in t:
                self.queries[x].append(q)

    def partners(self, term: int) -> np.ndarray:
        """Terms that some query holds beside ``term`` (itself included), sorted."""
        return np.unique(np.concatenate([self.terms[q] for q in self.queries[term]]))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // n_words
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def geometric_blocks(sketch: np.ndarray) -> list[np.ndarray]:
    """Positions of a posting list, clustered by similarity to spread representatives."""
    n = len(sketch)
    if n <= BLOCK:
        return [np.arange(n)]
    heads = sketch[np.arange(-(-n // BLOCK)) * n // (-(-n // BLOCK))]
    near = np.concatenate([(sketch[i:i + 1024] @ heads.T).argmax(1) for i in range(0, n, 1024)])
    order = np.argsort(near, kind="stable")
    cuts = np.flatnonzero(np.diff(near[order])) + 1
    return [part[i:i + 2 * BLOCK] for part in np.split(order, cuts) for i in range(0, len(part), 2 * BLOCK)]


_SCALE = 4096           # impacts stay below 10^6: a byte holds impact / 4096, rounded up


def _build(shared):
    """Shards into indexes: impacts, and per term its blocks with members and summaries."""
    def run(batches):
        q: Queries = shared.value
        partners: dict[int, np.ndarray] = {}
        signs = np.random.default_rng(13).standard_normal((len(q.weight), SKETCH)).astype(np.float32)
        for pdf in batches:
            for row in pdf.itertuples():
                n, ptr = np.frombuffer(row.lens, np.int64), np.frombuffer(row.ptr, np.int64)
                term, tf = np.frombuffer(row.term, np.int32).astype(np.int64), np.frombuffer(row.tf, np.int64)
                if not len(term):
                    continue
                doc = np.repeat(np.arange(len(n)), np.diff(ptr))
                impact = impacts(tf, n[doc], q.n_docs, q.n_words)
                value = (impact * q.weight[term]).astype(np.float32)
                sketch = np.add.reduceat(value[:, None] * signs[term], ptr[:-1])
                sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
                high = (-(-impact // _SCALE)).astype(np.uint8)
                order = np.argsort(term, kind="stable")
                lists, starts = np.unique(term[order], return_index=True)
                by_term = np.split(doc[order], starts[1:])
                members, sizes, per_list, coords, highs, widths = [], [], [], [], [], []
                column = np.full(len(q.weight), -1, np.int64)
                for t, holders in zip(lists.tolist(), by_term):
                    if t not in partners:
                        partners[t] = q.partners(t)
                    mine = partners[t]
                    column[mine] = np.arange(len(mine))
                    blocks = geometric_blocks(sketch[holders])
                    flat = holders[np.concatenate(blocks)]
                    size = np.array([len(b) for b in blocks])
                    # the vectors of the members, block by block
                    width = ptr[flat + 1] - ptr[flat]
                    at = np.repeat(ptr[flat] - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
                    col = column[term[at]]
                    keep = col >= 0
                    cell = np.repeat(np.repeat(np.arange(len(blocks)), size), width)[keep] * len(mine) + col[keep]
                    room = np.zeros(len(blocks) * len(mine), np.uint8)
                    np.maximum.at(room, cell, high[at[keep]])
                    held = np.flatnonzero(room)
                    coords.append(mine[held % len(mine)].astype(np.int32))
                    highs.append(room[held])
                    widths.append(np.bincount(held // len(mine), minlength=len(blocks)))
                    members.append(flat.astype(np.int32))
                    sizes.append(size)
                    per_list.append(len(blocks))
                    column[mine] = -1
                cat = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
                edges = lambda parts: np.append(0, np.cumsum(np.concatenate(parts))).astype(np.int64)
                yield pd.DataFrame([(row.ids, row.nulls, row.ptr, row.term, impact.astype(np.int32).tobytes(), lists.astype(np.int64).tobytes(),
                                     np.append(0, np.cumsum(per_list)).astype(np.int64).tobytes(), cat(members, np.int32),
                                     np.stack([edges(sizes), edges(widths)]).tobytes(), cat(coords, np.int32), cat(highs, np.uint8))],
                                   columns=[c.split()[0] for c in _INDEX.split(", ")])
    return run


class Index:
    """One shard's index."""

    def __init__(self, row, q: Queries):
        read = lambda raw, kind: np.frombuffer(raw, kind)
        self.q, self.ids, self.nulls = q, read(row.ids, np.int64), read(row.nulls, bool)
        self.ptr, self.term, self.impact = read(row.ptr, np.int64), read(row.term, np.int32), read(row.impact, np.int32)
        self.lists, self.blocks = read(row.lists, np.int64), read(row.blocks, np.int64)
        self.members = read(row.members, np.int32)
        self.sizes, self.widths = read(row.edges, np.int64).reshape(2, -1)
        self.coords, self.high = read(row.coords, np.int32), read(row.high, np.uint8)
        self.place = np.full(len(q.weight), -1, np.int64)
        self.place[self.lists] = np.arange(len(self.lists))
        self.weights = np.zeros(len(q.weight), np.int64)
        most = np.zeros(len(q.weight), np.int64)
        np.maximum.at(most, self.term, self.impact.astype(np.int64))
        self.most = most * q.weight

    def ranges(self, lo, hi):
        """All positions lo[i] .. hi[i] - 1, one range after another, and each one's range."""
        n = hi - lo
        owner = np.repeat(np.arange(len(n)), n)
        return np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()), owner

    def bounds(self, query: int, threshold: int):
        """(blocks, bounds) of the query's lists, without lists that are out as a whole."""
        terms = self.q.terms[query]
        terms = terms[(self.place[terms] >= 0) & (self.q.weight[terms] > 0)]
        terms = terms[np.argsort(self.most[terms], kind="stable")]
        terms = terms[np.searchsorted(np.cumsum(self.most[terms]), threshold, side="left"):]
        at = self.place[terms]
        blocks, _ = self.ranges(self.blocks[at], self.blocks[at + 1])
        if not len(blocks):
            return blocks, blocks
        self.weights[self.q.terms[query]] = np.maximum(self.q.weight[self.q.terms[query]], 0)
        spots, owner = self.ranges(self.widths[blocks], self.widths[blocks + 1])
        part = self.weights[self.coords[spots]] * self.high[spots]
        bound = np.add.reduceat(part, np.flatnonzero(np.diff(owner, prepend=-1))) * _SCALE
        self.weights[self.q.terms[query]] = 0
        return blocks, bound

    def score(self, query: int, blocks: np.ndarray):
        """(documents, exact scores) of the blocks' members, each once."""
        spots, _ = self.ranges(self.sizes[blocks], self.sizes[blocks + 1])
        docs = np.unique(self.members[spots])
        if not len(docs):
            return docs, np.zeros(0, np.int64)
        mine = self.q.terms[query]
        self.weights[mine] = self.q.weight[mine]
        at, owner = self.ranges(self.ptr[docs], self.ptr[docs + 1])
        part = self.weights[self.term[at]] * self.impact[at]
        self.weights[mine] = 0
        return docs, np.add.reduceat(part, np.flatnonzero(np.diff(owner, prepend=-1)))

    def search(self, query: int, threshold: int, top: int):
        """(documents, scores): the ``top`` best of at least ``threshold`` (ties by id)."""
        blocks, bound = self.bounds(query, threshold)
        docs, scores = self.score(query, blocks[bound >= threshold])
        keep = (scores >= threshold) & (scores > 0)
        docs, scores = docs[keep], scores[keep]
        order = np.lexsort((self.ids[docs], -scores))[:top]
        return docs[order], scores[order]

    def promising(self, query: int, top: int):
        """Scores of documents in the blocks of highest bounds, ``top`` at most."""
        blocks, bound = self.bounds(query, 0)
        order = np.argsort(-bound, kind="stable")
        enough = np.searchsorted(np.cumsum(np.diff(self.sizes)[blocks[order]]), 2 * top) + 1
        _, scores = self.score(query, blocks[order[:enough]])
        return np.sort(scores[scores > 0])[::-1][:top]


def _first(shared, top):
    def run(batches):
        q: Queries = shared.value
        for pdf in batches:
            for row in pdf.itertuples():
                index = Index(row, q)
                found = [index.promising(k, top) for k in range(len(q.items))]
                yield pd.DataFrame({"query": np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64),
                                    "score": np.concatenate(found).astype(np.int64)})
    return run


def _search(shared, thresholds, top):
    def run(batches):
        q: Queries = shared.value
        for pdf in batches:
            for row in pdf.itertuples():
                index, out = Index(row, q), []
                for k in range(len(q.items)):
                    docs, scores = index.search(k, int(thresholds.value[k]), top)
                    out.append(pd.DataFrame({"query": np.full(len(docs), k), "doc_id": pd.array(index.ids[docs], "Int64"),
                                             "score": scores, "missing": index.nulls[docs]}))
                hits = pd.concat(out)
                hits.loc[hits.pop("missing"), "doc_id"] = pd.NA
                yield hits
    return run


def _batch(docs: DataFrame, pairs: list[tuple], top: int, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    words = sorted({w for _, w in pairs})
    packed = written(shards(docs, sc.broadcast(words), text_col), "shards")
    n_docs, n_words = packed.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in packed.select("term").mapInPandas(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    q = Queries(pairs, words, df, n_docs, n_words)
    shared = sc.broadcast(q)
    index = written(packed.mapInPandas(_build(shared), _INDEX), "index")
    place = Window.partitionBy("query").orderBy(F.desc("score"))
    first = (index.mapInPandas(_first(shared, top), "query long, score long")
             .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
             .groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= top).collect())
    thresholds = np.zeros(len(q.items), np.int64)
    for r in first:
        thresholds[r["query"]] = r["score"]
    hits = index.mapInPandas(_search(shared, sc.broadcast(thresholds), top), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame(list(enumerate(q.items)), "query long, item_id long")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    terms = written(item_terms(items, text_col), "terms")
    batches, out = max(1, -(-terms.count() // PAIRS)), None
    for k in range(batches):
        pairs = [(r["item_id"], r["word"]) for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == k).collect()]
        if pairs:
            found = _batch(docs, pairs, top, text_col)
            out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_lexical(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY ALL),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
         sum(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM items JOIN df USING (term) JOIN tf USING (term) CROSS JOIN total GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
