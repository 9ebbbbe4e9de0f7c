"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece of text starts a suffix; only its first ``DEPTH``
words matter.  Words are 64-bit hashes of (language, word), so phrases of
different languages never meet.

1. Words are counted.  A bit field of fixed size says which words may reach
   ``least`` occurrences (it lets through some others, never drops one); any
   other word ends a suffix, as no candidate holds it.
2. Suffixes are routed by their two leading words: slots of a hash of these
   are gathered into bins of bounded weight.  A slot too heavy for one bin (a
   hot pair) is split by the third word.  Suffixes are counted before they
   move, in packed blocks.
3. In a bin, pointers are sorted by three-way partitions: less, equal,
   greater than a pivot word; the equal part goes on with the next word.  A
   part lighter than ``least`` is abandoned.  What is equal to the last word
   is a phrase, its weight the count.  Small parts are finished by one sort.
   In a split slot counts of pairs are parts of the whole, so pairs are
   abandoned only after these are added up.
4. Counts of parts join candidates by hash; the top of each language gets
   its words.

Exactness: scores are decimals of 38 digits (right while 1000000 * a * a
stays below 10^38).  Two words of a language share a hash with probability
about v^2 / 2^65 for v distinct words; ``clashes`` lists these, and
``collocations`` raises where it finds one, as counts would be wrong.

Defined results: a null or empty text has no words; a null language is
``und`` (joined with one of that name); repeated rows count each; words and
pieces of any length count whole; ties go to the phrase of smaller bytes; an
empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_CACHE, table, utf8, written

DEPTH, LEAST, TOP, INSIDE = 3, 10, 2000, 50
SLOT_BITS = 14          # slots of leading words
BIN = (250_000, 4_000_000)      # suffixes of a bin: at least, at most, by the size of the corpus
FLUSH = 2_000_000       # words whose suffixes a task holds at a time
SMALL = 512             # pointers of a part that one sort finishes
FIELD_BITS = 25
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A-Z lower-cased, ends of pieces a full stop, tab a blank.
_CUTS = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces_and_words(raw: bytes) -> list[bytes]:
    """The words of a text, and a full stop (which no word holds) between pieces."""
    return raw.translate(_CUTS).replace(b".", b" . ").split()


def word_hash(lang: bytes, word: bytes) -> int:
    """64-bit hash, never 0 (which ends a suffix)."""
    return xxhash.xxh3_64_intdigest(lang + b"\x00" + word) or 1


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((first ^ (first >> np.uint64(31))) * _MIX + second) * _MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_words(batches):
    """Rows (lang, word, hash, n) of words and (null, null, slot, n) of slots of leading words."""
    slots = np.zeros(1 << SLOT_BITS, np.int64)
    known, names, counts = {}, [None], []      # words' numbers by language; 0 is the end of a piece

    def flush():
        n = np.bincount(np.concatenate(counts), minlength=len(names))
        lang, word = zip(*names[1:]) if len(names) > 1 else ((), ())
        return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "word": pd.Series(word, dtype=object), "hash": hashes[1:len(names)].view(np.int64), "n": n[1:len(names)]})

    hashes, held = np.zeros(1 << 16, np.uint64), 0
    for pdf in batches:
        for lang, raw in zip(pdf["lang"], pdf["raw"]):
            words = pieces_and_words(raw) if raw else []
            if not words:
                continue
            code = lang.encode()
            mine = known.setdefault(code, {b".": 0})
            ids = np.fromiter([mine.get(w, -1) for w in words], np.int64, len(words))
            for i in np.flatnonzero(ids < 0):
                w = words[i]
                at = mine.get(w)
                if at is None:
                    at = mine[w] = len(names)
                    names.append((lang, w))
                    if at >= len(hashes):
                        hashes = np.concatenate([hashes, np.zeros(len(hashes), np.uint64)])
                    hashes[at] = word_hash(code, w)
                ids[i] = at
            counts.append(ids)
            held += len(ids)
            h = hashes[ids]
            pair = (h[:-1] != 0) & (h[1:] != 0)
            slots += np.bincount(_slots(h[:-1][pair], h[1:][pair]), minlength=len(slots))
            if len(names) > 4 * WORD_CACHE or held > FLUSH:
                yield flush()
                known, names, counts, held = {}, [None], [], 0
    if counts:
        yield flush()
    at = np.flatnonzero(slots)
    yield pd.DataFrame({"lang": None, "word": None, "hash": at, "n": slots[at]})


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, word binary, hash, n): words with their counts; and rows with null ``lang``:
    ``hash`` a slot of leading words and ``n`` the suffixes in it."""
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8(text_col).alias("raw"))
    return (cut.mapInPandas(_count_words, "lang string, word binary, hash long, n long")
            .groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")))


def clashes(counted: DataFrame) -> DataFrame:
    """Hashes that two words share."""
    return counted.where("lang is not null").groupBy("hash").agg(F.count("*").alias("words")).where("words > 1")


def bit_field(words: DataFrame) -> np.ndarray:
    """Bits at the hashes of ``words``; 2^FIELD_BITS bits whatever their number."""
    rows = (words.select(F.shiftrightunsigned("hash", 64 - FIELD_BITS).alias("s"))
            .groupBy(F.shiftright("s", 5).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("m")).toPandas())
    field = np.zeros(1 << (FIELD_BITS - 5), np.int64)
    field[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64)
    return field.astype(np.uint32)


def bins_of(slots: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bin of each slot, bins it is split into, whether each bin holds whole slots)."""
    weight = np.zeros(1 << SLOT_BITS, np.int64)
    weight[slots["hash"].to_numpy(np.int64)] = slots["n"].to_numpy(np.int64)
    room = int(np.clip(weight.sum() // 4096, *BIN))
    first, parts, whole, load = np.zeros(len(weight), np.int64), np.ones(len(weight), np.int64), [], room
    for s, w in enumerate(weight):
        if w > room:
            parts[s] = -(-w // room)
            first[s], load = len(whole), room
            whole += [False] * int(parts[s])
        else:
            if load + w > room:
                whole.append(True)
                load = 0
            first[s], load = len(whole) - 1, load + w
    return first, parts, np.array(whole)


def _blocks(shared):
    """Packed suffixes (three columns of hashes and their counts) by bin."""
    def run(batches):
        field, first, parts, _ = shared.value
        known: dict[bytes, dict] = {}

        def find(code, mine, w):
            h = word_hash(code, w)
            s = h >> (64 - FIELD_BITS)
            h = h if int(field[s >> 5]) >> (s & 31) & 1 else 0
            if len(mine) >= WORD_CACHE:
                mine.clear()
                mine[b"."] = 0
            mine[w] = h
            return h

        def flush(held):
            flat = np.concatenate(held + [np.zeros(2, np.uint64)])
            at = np.flatnonzero((flat[:-2] != 0) & (flat[1:-1] != 0))
            a, b, c = flat[at], flat[at + 1], flat[at + 2]
            slot = _slots(a, b)
            bins = first[slot] + (c % parts[slot].astype(np.uint64)).astype(np.int64)
            with np.errstate(over="ignore"):
                key = ((a * _MIX ^ b) * _MIX + c) * _MIX
            order = np.lexsort((key, bins))
            a, b, c, bins = a[order], b[order], c[order], bins[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (bins[1:] != bins[:-1])
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, len(a)))
            a, b, c, bins = a[starts], b[starts], c[starts], bins[starts]
            edges = np.flatnonzero(np.diff(bins, prepend=-1, append=-1)) if len(bins) else []
            return pd.DataFrame([(int(bins[i]), a[i:j].tobytes(), b[i:j].tobytes(), c[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes())
                                 for i, j in zip(edges, edges[1:])], columns=["bin", "a", "b", "c", "n"])

        held, words_held = [], 0
        gap = np.zeros(1, np.uint64)
        for pdf in batches:
            for lang, raw in zip(pdf["lang"], pdf["raw"]):
                words = pieces_and_words(raw) if raw else []
                if len(words) < 2:
                    continue
                code = lang.encode()
                mine = known.setdefault(code, {b".": 0})
                held += [np.fromiter([mine[w] if w in mine else find(code, mine, w) for w in words], np.uint64, len(words)), gap]
                words_held += len(words)
                if words_held >= FLUSH:
                    yield flush(held)
                    held, words_held = [], 0
        if held:
            yield flush(held)
    return run


def multikey_counts(keys: list[np.ndarray], weights: np.ndarray, least: int, whole: bool):
    """Yield (depth, representative pointers, counts) of the equal parts at depths 2 and 3.

    ``keys`` are the suffixes' words by depth, 0 past the end.  Pointers are
    partitioned by a pivot word; parts below ``least`` are abandoned (where
    ``whole`` is false, only below the second word)."""
    depth_max, found = len(keys), [([], []) for _ in keys]
    small: list[tuple[int, np.ndarray]] = []
    todo = [(0, np.arange(len(weights)))]
    while todo:
        depth, ptr = todo.pop()
        weight = int(weights[ptr].sum())
        if not len(ptr) or (weight < least and (whole or depth >= 2)):
            continue
        if len(ptr) <= SMALL:
            small.append((depth, ptr))
            continue
        v = keys[depth][ptr]
        pivot = np.sort(v[:: max(1, len(v) // 9)])[4]
        less, more = v < pivot, v > pivot
        same = ptr[~(less | more)]
        todo += [(depth, ptr[less]), (depth, ptr[more])]
        if pivot:
            _found(found, depth, same[:1], np.array([weights[same].sum()]))
            if depth + 1 < depth_max:
                todo.append((depth + 1, same))
    if small:
        ptr = np.concatenate([p for _, p in small])
        part = np.repeat(np.arange(len(small)), [len(p) for _, p in small])
        done = np.repeat([d for d, _ in small], [len(p) for _, p in small])
        order = np.lexsort([k[ptr] for k in reversed(keys)] + [part])
        ptr, part, done = ptr[order], part[order], done[order]
        change = np.append(True, part[1:] != part[:-1])
        for depth in range(depth_max):
            v = keys[depth][ptr]
            change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            n = np.add.reduceat(weights[ptr], starts)
            ok = (done[starts] <= depth) & (v[starts] != 0)
            _found(found, depth, ptr[starts[ok]], n[ok])
    for depth in range(1, depth_max):
        at, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found[depth])
        keep = n >= least if whole or depth >= 2 else n > 0
        yield depth + 1, at[keep], n[keep]


def _found(found, depth, at, n):
    found[depth][0].append(at)
    found[depth][1].append(n)


def _sorter(shared, least):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = bool(shared.value[3][int(pdf["bin"].iat[0])])
        a, b, c = (np.frombuffer(b"".join(pdf[x]), np.uint64) for x in "abc")
        n = np.frombuffer(b"".join(pdf["n"]), np.uint32).astype(np.int64)
        out = []
        for depth, at, count in multikey_counts([a, b, c], n, least, whole):
            third = c[at] if depth == 3 else np.zeros(len(at), np.uint64)
            out.append(pd.DataFrame({"h1": a[at].view(np.int64), "h2": b[at].view(np.int64), "h3": third.view(np.int64), "n": count}))
        return pd.concat(out)
    return run


def phrase_counts(docs: DataFrame, counted: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """(h1, h2, h3, n): phrases of two (h3 = 0) and three words with ``least`` occurrences or more."""
    spark = docs.sparkSession
    slots = counted.where("lang is null").select("hash", "n").toPandas()
    first, parts, whole = bins_of(slots)
    shared = spark.sparkContext.broadcast((bit_field(counted.where(f"lang is not null and n >= {least}")), first, parts, whole))
    blocks = (docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8(text_col).alias("raw"))
              .mapInPandas(_blocks(shared), "bin long, a binary, b binary, c binary, n binary"))
    return (blocks.groupBy("bin").applyInPandas(_sorter(shared, least), "h1 long, h2 long, h3 long, n long")
            .groupBy("h1", "h2", "h3").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _score(a, left, right):
    d = lambda c: c.cast("decimal(38,0)")
    top = (F.lit(1000000).cast("decimal(38,0)") * d(a)).cast("decimal(38,0)") * d(a)
    return F.call_function("div", top.cast("decimal(38,0)"), (d(left) * d(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    counted = written(word_counts(docs, text_col), "words")
    if not clashes(counted).isEmpty():
        raise ValueError("two words of a language share a hash")
    words = counted.where(f"lang is not null and n >= {least}").select("lang", "hash", "word", F.col("n").alias("f"))
    found = written(phrase_counts(docs, counted, least, text_col), "phrases")
    pairs = found.where("h3 = 0").select("h1", "h2", F.col("n").alias("a"))
    threes = found.where("h3 <> 0").withColumnRenamed("n", "a")

    def word(df, key, name):
        return df.join(words.select(F.col("hash").alias(key), F.col("f").alias(name)), key)

    longer = (threes.select("h1", "h2", "a").union(threes.select("h2", "h3", "a"))
              .groupBy("h1", "h2").agg(F.max("a").alias("longer")))
    two = (word(word(pairs, "h1", "l"), "h2", "r").join(longer, ["h1", "h2"], "left")
           .where(f"longer is null or 100 * longer < {inside} * a")
           .select("h1", "h2", F.lit(0).cast("long").alias("h3"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    cut = lambda l, r: F.struct(_score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))
    three = (word(word(threes, "h1", "f1"), "h3", "f3")
             .join(pairs.select("h1", "h2", F.col("a").alias("f12")), ["h1", "h2"])
             .join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23")), ["h2", "h3"])
             .withColumn("k1", cut("f1", "f23")).withColumn("k2", cut("f12", "f3"))
             .withColumn("best", F.when(F.col("k2.score") < F.col("k1.score"), F.col("k2")).otherwise(F.col("k1")))
             .select("h1", "h2", "h3", "a", "best.l", "best.r", "best.score"))
    lang = words.select(F.col("hash").alias("h1"), "lang")
    scored = written(two.unionByName(three).join(lang, "h1"), "scored")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top)     # with all ties
    for h in ("h1", "h2", "h3"):
        best = best.join(words.select(F.col("hash").alias(h), F.col("word").alias(f"w{h[1]}")), h, "left")
    total = counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    blank = F.lit(b" ")
    phrase = F.when(F.col("h3") == 0, F.concat("w1", blank, "w2")).otherwise(F.concat("w1", blank, "w2", blank, "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top).join(total, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
suffixes AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists)),
u AS (SELECT lang, w1, count(*) AS f FROM suffixes GROUP BY ALL),
b AS (SELECT lang, w1, w2, count(*) AS f FROM suffixes WHERE w2 IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, w1, w2, w3, count(*) AS f FROM suffixes WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM t UNION ALL SELECT lang, w2, w3, f FROM t) GROUP BY ALL),
cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM b JOIN u x ON x.lang = b.lang AND x.w1 = b.w1 JOIN u y ON y.lang = b.lang AND y.w1 = b.w2
  LEFT JOIN longer g ON g.lang = b.lang AND g.w1 = b.w1 AND g.w2 = b.w2
  WHERE b.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * b.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM t JOIN u x ON x.lang = t.lang AND x.w1 = t.w1 JOIN b y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM t JOIN b x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN u y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM scored)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY lang) c ON c.lang = ranked.lang WHERE rank <= 2000
"""
