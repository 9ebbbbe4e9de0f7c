"""Language-model scoring: deleted interpolation of n-gram estimates.

Tokens are words, then one end per text.  The probability of a token after a
context word h mixes three maximum-likelihood estimates,

    P(w | h) = l2 * c(h w) / c(h) + l1 * c(w) / N + l0 / (V + 1),

with weights that depend on the frequency of the context (bucket: number of
binary digits of c(h); an unseen h has l2 = 0).  The weights are learned by
expectation-maximisation on held-out counts: part of the training texts is
held out, the estimates come from the rest, and the held-out tokens, counted
by bucket and by the two estimates on a fine logarithmic grid, say which
weights predict them best.  Scores then use the counts of all training texts.

Work is laid out so that a token is never shuffled by itself.  Texts lie in
blocks (some ten thousand tokens and more).  A block sends each of its
distinct words and word pairs once, as a sorted array of 64-bit hashes cut
by hash range, with its own counts; a range sums the counts of all blocks and
answers each block in the order it asked.  Frequent words are thus counted
before the shuffle and cannot make a hot key.

Defined results: a null or empty text is the end token alone; a null id
counts as the empty text for the split; a bucket without held-out tokens
weighs its estimates evenly; repeated rows count as often as they
occur and are scored each; with no training text every estimate is zero and
every token gets 1 / (V + 1); other columns are ignored.
"""
from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_CACHE, crc_mod, space_words, table, utf8, written

BLOCK_BYTES = 12 << 20      # text bytes of a block
BUCKETS = 64                # context-frequency buckets: binary digits of a long
GRID = 8                    # cells of a held-out estimate per factor of two
RANGE_BYTES = 64 << 20      # text bytes whose keys make one hash range, at most
BEGIN, END = np.uint64(0x1234567), np.uint64(0x7654321)
BEGIN_KEY = np.array([BEGIN & ~np.uint64(1)])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What a text is for: scored only, counted in the estimates, counted and held out for the weights.
SCORED, COUNTED, HELD = 0, 1, 2


class Tokens:
    """Hashes of a block's tokens and of the pairs they end, text after text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        found = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return found

    def __call__(self, texts: list[bytes]):
        known, word, parts = self.known, self.word, []
        sizes = np.empty(len(texts), np.int64)
        for i, raw in enumerate(texts):
            words = space_words(raw) if raw else []
            own = np.empty(len(words) + 1, np.uint64)
            own[:-1] = np.fromiter([known[w] if w in known else word(w) for w in words], np.uint64, len(words))
            own[-1] = END
            parts.append(own)
            sizes[i] = len(own)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        contexts = np.empty_like(tokens)
        contexts[1:] = tokens[:-1]
        contexts[np.cumsum(sizes) - sizes] = BEGIN
        with np.errstate(over="ignore"):
            pairs = (contexts * _A) ^ ((tokens + _B) * _B)
            pairs ^= pairs >> np.uint64(31)
            pairs *= _A
        return tokens, contexts, pairs, sizes


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences in as few bytes as the largest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = next((w for w in (3, 4, 5, 6, 7) if not len(gaps) or int(gaps[1:].max(initial=0)) < 1 << 8 * w), 8)
    head = gaps[:1].astype("<u8").tobytes()
    return bytes([width]) + head + gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    gaps[1:, :width] = body
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _blocks(size: int):
    """Rows to blocks: texts of one part of a file, held-out ones apart, about ``size`` bytes each."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        open_: dict[bool, list] = {False: [], True: []}
        filled = {False: 0, True: 0}

        def close(held):
            nonlocal number
            own = open_[held]
            out = {"block": [f"{part}-{number}"], "held": [held], "bytes": [filled[held]],
                   "texts": [zlib.compress(pickle.dumps(own, 5), 1)]}
            number, open_[held], filled[held] = number + 1, [], 0
            return pd.DataFrame(out)

        for pdf in batches:
            for i, use, raw in zip(pdf["doc_id"], pdf["use"], pdf["raw"]):
                held = use == HELD
                open_[held].append((None if pd.isna(i) else int(i), int(use), raw or b""))
                filled[held] += len(raw or b"")
                if filled[held] >= size:
                    yield close(held)
        for held in (False, True):
            if open_[held]:
                yield close(held)
    return run


def _load(texts: bytes):
    rows = pickle.loads(zlib.decompress(texts))
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.int8), [r[2] for r in rows]


def _key_table(block) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys (sorted): words and contexts even, pairs odd; and each token's."""
    tokens, contexts, pairs, _ = block
    return (tokens & ~np.uint64(1)), (contexts & ~np.uint64(1)), (pairs | np.uint64(1))


def _ask(ranges: int):
    """Blocks to requests: (range, block, keys, counted, held)."""
    def run(batches):
        read = Tokens()
        for pdf in batches:
            for block, texts in zip(pdf["block"], pdf["texts"]):
                _, use, raws = _load(texts)
                own = read(raws)
                words, contexts, pairs = _key_table(own)
                use_at = np.repeat(use, own[3])
                starts = np.flatnonzero(contexts == (BEGIN & ~np.uint64(1)))
                every = np.concatenate([words, pairs, contexts[starts]])
                of = np.concatenate([use_at, use_at, use_at[starts]])
                keys, at = np.unique(every, return_inverse=True)
                counted = np.bincount(at[of != SCORED], minlength=len(keys))
                held = np.bincount(at[of == HELD], minlength=len(keys))
                bounds = np.searchsorted(keys, (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64))
                cuts = [0, *bounds.tolist(), len(keys)]
                rows = [(i, block, _pack_keys(keys[a:b]), _pack_counts(counted[a:b]), _pack_counts(held[a:b]))
                        for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["range", "block", "keys", "counted", "held"])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of the keys: sums over all blocks, in the order each block asked."""
    keys = [_unpack_keys(k) for k in pdf["keys"]]
    sizes = [len(k) for k in keys]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([_unpack_counts(c) for c in pdf["counted"]]), len(every)).astype(np.int64)
    held = np.bincount(at, np.concatenate([_unpack_counts(c) for c in pdf["held"]]), len(every)).astype(np.int64)
    word = (every & np.uint64(1) == 0) & (every != (BEGIN & ~np.uint64(1)))
    facts = [int(x) for x in (total[word].sum(), (total[word] > 0).sum(), (total - held)[word].sum(), ((total - held)[word] > 0).sum())]
    out, end = [], 0
    for block, n in zip(pdf["block"], sizes):
        own = at[end:end + n]
        end += n
        out.append((pdf["range"].iat[0], block, _pack_counts(total[own]), _pack_counts(held[own]), *(facts if not out else [0] * 4)))
    return pd.DataFrame(out, columns=["range", "block", "total", "held", "n", "v", "n_rest", "v_rest"])


def _counts(texts: bytes, answers: pd.DataFrame, rest: bool):
    """A block again with the counts it asked for, of all training texts or of the ``rest``
    without the held-out ones: (ids, use, sizes, counts of words, contexts, pairs)."""
    ids, use, raws = _load(texts)
    words, _, pairs, sizes = Tokens()(raws)
    del raws, _
    n = len(words)
    every = np.concatenate([words & ~np.uint64(1), pairs | np.uint64(1), BEGIN_KEY])
    del words, pairs
    at = np.unique(every, return_inverse=True)[1]
    del every
    answers = answers.sort_values("range")
    counts = np.concatenate([_unpack_counts(c) for c in answers["total"]])
    if rest:
        counts = counts - np.concatenate([_unpack_counts(c) for c in answers["held"]])
    word, pair, begin = counts[at[:n]], counts[at[n:-1]], counts[at[-1]]
    context = np.empty_like(word)
    context[1:] = word[:-1]         # a token's context is the word before it
    context[np.cumsum(sizes) - sizes] = begin
    return ids, use, sizes, [word, context, pair]


def estimates(word, context, pair, n):
    """Bucket, pair estimate and word estimate of each token."""
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)
    return bucket, pair / np.maximum(context, 1), word / max(n, 1)


def _grid(n: int):
    def run(key, texts, answers):
        if not len(texts):
            return pd.DataFrame({"bucket": [], "pair": [], "word": [], "tokens": []}, dtype=np.int64)
        _, _, _, (w, c, p) = _counts(texts["texts"].iat[0], answers, rest=True)
        bucket, p2, p1 = estimates(w, c, p, n)
        cell = lambda x: np.where(x > 0, np.round(GRID * np.log2(np.maximum(x, 1e-300))), 1).astype(np.int64)
        out = pd.DataFrame({"bucket": bucket, "pair": cell(p2), "word": cell(p1), "tokens": 1})
        return out.groupby(["bucket", "pair", "word"], as_index=False)["tokens"].sum()
    return run


def learn_weights(cells: pd.DataFrame, v: int, rounds: int = 60) -> np.ndarray:
    """EM over the held-out cells: weights (pair, word, uniform) of each bucket."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    if len(cells):
        value = lambda x: np.where(x > 0, 0.0, 2.0 ** (x / GRID))
        p = np.stack([value(cells["pair"].to_numpy()), value(cells["word"].to_numpy()),
                      np.full(len(cells), 1 / (v + 1))], 1)
        bucket, tokens = cells["bucket"].to_numpy(), cells["tokens"].to_numpy(float)
        for _ in range(rounds):
            share = weights[bucket] * p
            share *= (tokens / share.sum(1))[:, None]
            mass = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], 1)
            mass += np.where(weights > 0, 1e-3, 0)      # no estimate is ever ruled out
            weights = mass / mass.sum(1, keepdims=True)
    return weights


def _score(n: int, v: int, weights: np.ndarray):
    def run(key, texts, answers):
        if not len(texts):
            return pd.DataFrame(columns=["doc_id", "use", "n_tokens", "n_known", "base_score", "score"])
        ids, use, sizes, (w, c, p) = _counts(texts["texts"].iat[0], answers, rest=False)
        bucket, p2, p1 = estimates(w, c, p, n)
        mixed = weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] / (v + 1)
        base = np.log10((w + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.cumsum(sizes) - sizes
        by_text = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "use": use.astype(int), "n_tokens": sizes,
                             "n_known": by_text((w > 0).astype(np.int64)), "base_score": by_text(base),
                             "score": by_text(np.log10(mixed))})
    return run


def score(docs: DataFrame, use: Column, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, use, n_tokens, n_known, train_tokens, base_score, score.

    ``use``: SCORED, COUNTED or HELD for each row (the last two are the training texts)."""
    spark = docs.sparkSession
    blocks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), use.cast("int").alias("use"), utf8(text_col).alias("raw"))
                     .mapInPandas(_blocks(block_bytes), "block string, held boolean, bytes long, texts binary"), "lm-blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    ranges = max(tasks, -(-size // RANGE_BYTES))
    asked = blocks.select("block", "texts").repartition(max(1, min(n_blocks, tasks * 4)), "block").mapInPandas(
        _ask(ranges), "range int, block string, keys binary, counted binary, held binary")
    answers = written(asked.groupBy("range").applyInPandas(
        _answer, "range int, block string, total binary, held binary, n long, v long, n_rest long, v_rest long"), "lm-counts")
    n, v, n_rest, v_rest = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n", "v", "n_rest", "v_rest")]).first())
    told = answers.select("range", "block", "total", "held")

    def meet(some: DataFrame, fn, schema: str) -> DataFrame:
        return (some.select("block", "texts").groupBy("block")
                .cogroup(told.join(some.select("block"), "block", "left_semi").groupBy("block")).applyInPandas(fn, schema))

    # buckets x grid cells: bounded by the number of digits of a count, whatever the corpus
    cells = (meet(blocks.where("held"), _grid(n_rest), "bucket long, pair long, word long, tokens long")
             .groupBy("bucket", "pair", "word").agg(F.sum("tokens").alias("tokens")).toPandas())
    weights = learn_weights(cells, v_rest)
    return meet(blocks, _score(n, v, weights), "doc_id long, use int, n_tokens long, n_known long, base_score double, score double"
                ).withColumn("train_tokens", F.lit(n).cast("long"))


def op7_lm_score(spark, sf_dir):
    fold = crc_mod("doc_id", 10)
    use = F.when(fold == 0, SCORED).when(fold == 1, HELD).otherwise(COUNTED)
    found = score(table(spark, sf_dir, "documents"), use)
    return found.select("doc_id", (F.col("use") == SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")
