"""Mixing, collocations and lexical search against plain Python on small tables."""
import collections
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from quarry.llm import collocations, lexical, mixing

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets of sources named by ``sizes``, by dealing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while len(fixed) < len(names):
        left = share * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        got = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s: most * sizes[s] for s in open_ if got[s] > most * sizes[s]}
        if not above:
            return fixed | got
        fixed |= above
    return fixed


@pytest.fixture(scope="module")
def uneven(spark):
    """A hot source, a hot id, sources without words, null source and id."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n)), "en", f"s{0 if i % 3 else i % 7}", None) for i, n in enumerate(rng.integers(0, 90, 400))]
    rows += [(7, "one hot id here", "en", "s1", None)] * 3000 + [(None, "a b", None, None, None), (None, None, None, None, 1)]
    rows += [(500, "", "en", "zz", None), (501, "long " * 20000, "en", "y", None), (502, "É x", "en", "É", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


def test_mix(uneven):
    sources, stream, mixed = mixing.mix(uneven, block=64)
    docs = [(r.doc_id, r.source, len(SPACE.findall(r.text or ""))) for r in uneven.collect()]
    sizes = collections.Counter()
    for _, s, n in docs:
        sizes[s] += n
    want = targets(dict(sizes))
    rows = sources.join(mixing.taken(mixed, stream), "number", "source", "source_size", "target").collect()
    assert collections.Counter((r.doc_id, r.source, r.size) for r in rows) == collections.Counter(docs)
    got = collections.Counter()
    for r in rows:
        got[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)


def test_schedule_is_even_and_whole(uneven):
    sources, stream, mixed = mixing.mix(uneven, block=64)
    rows = mixed.orderBy("slot", "start").collect()
    owed = {r.number: (r.owed, r.need) for r in sources.rows.collect()}
    words, order = collections.Counter(), {}
    for r in rows:
        words[r.number, r.k] += r.to_word - r.from_word
        order[r.slot] = r.number
        assert 0 <= r.from_word < r.to_word <= r.size
    for number, (n, need) in owed.items():
        assert [words[number, k] for k in range(n)] == [min(64, need - 64 * k) for k in range(n)]
    total, seen = sum(n for n, _ in owed.values()), collections.Counter()
    assert len(order) == total
    for place, slot in enumerate(sorted(order), 1):
        seen[order[slot]] += 1
        # the discrepancy of golden-ratio points grows with the logarithm of their number
        assert all(abs(seen[s] - place * owed[s][0] / total) < 4 + math.log2(total) for s in owed)


def test_mix_does_not_depend_on_partitions(uneven):
    once, again = (sorted(map(repr, mixing.taken(m, p).drop("number").collect()))
                   for _, p, m in (mixing.mix(uneven.repartition(n)) for n in (1, 7)))
    assert once == again


def test_mix_odd(spark, odd_docs, no_docs):
    assert mixing.taken(*reversed(mixing.mix(no_docs)[1:])).count() == 0
    _, stream, mixed = mixing.mix(odd_docs)
    assert mixing.taken(mixed, stream).count() == odd_docs.count()
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    sources, stream, mixed = mixing.mix(none)
    assert [r.taken for r in mixing.taken(mixed, stream).collect()] == [0, 0]
    assert {r.target for r in sources.rows.collect()} == {0.0}


def phrases(docs, least=10, top=2000):
    """docs: (lang, text)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out, longer = collections.defaultdict(list), collections.Counter()
    for (lang, *w), a in f.items():
        if len(w) == 3 and a >= least:
            for part in ((lang, *w[:2]), (lang, *w[1:])):
                longer[part] = max(longer[part], a)
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least and not 100 * longer[(lang, *w)] >= 50 * a:
            cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def test_collocations(spark, odd_docs, no_docs):
    assert collocations.collocations(no_docs).count() == 0
    docs = odd_docs
    for _ in range(4):
        docs = docs.union(docs)
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == phrases([(r.lang, r.text) for r in docs.collect()])


def test_collocations_with_split_slots(spark, monkeypatch):
    """A pair so frequent that its slot is dealt to several bins by the third word."""
    rng = np.random.default_rng(3)
    texts = [" ".join(x for w in rng.zipf(1.4, 60) for x in (("of", "the") if w < 3 else (f"w{w % 500}",))) + ("." if i % 2 else " É\t!")
             for i in range(600)]
    docs = spark.createDataFrame([(("en", None, "und")[i % 3], t, "x") for i, t in enumerate(texts)], "lang string, text string, score string")
    monkeypatch.setattr(collocations, "BIN", (300, 300))
    first, parts, whole = collocations.bins_of(collocations.word_counts(docs).where("lang is null").select("hash", "n").toPandas())
    assert parts.max() > 3 and not whole.all()
    assert {tuple(r) for r in collocations.collocations(docs, top=50).collect()} == phrases([(r.lang, r.text) for r in docs.collect()], top=50)


@pytest.mark.parametrize("whole", [True, False])
def test_multikey_counts(whole):
    rng = np.random.default_rng(8)
    a, b, c = (np.minimum(rng.zipf(1.3, 30000), 900).astype(np.uint64) for _ in range(3))
    c[rng.random(len(c)) < 0.2] = 0
    n = rng.integers(1, 4, len(a))
    two, three = collections.Counter(), collections.Counter()
    for x, y, z, w in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist()):
        two[x, y] += w
        if z:
            three[x, y, z] += w
    for depth, at, count in collocations.multikey_counts([a, b, c], n, 10, whole):
        keys = list(zip(*(k[at].tolist() for k in (a, b, c)[:depth])))
        assert len(set(keys)) == len(keys)
        want = {k: v for k, v in (two if depth == 2 else three).items() if v >= 10 or (depth == 2 and not whole)}
        assert dict(zip(keys, count.tolist())) == want


def search(docs, items, top=50):
    """docs: (id, text); items: (id, text)."""
    cut = [(i, collections.Counter(ALNUM.findall((t or "").translate(FOLD)))) for i, t in docs]
    cut = [(i, tf) for i, tf in cut if tf]
    total, out = sum(sum(tf.values()) for _, tf in cut), set()
    df = collections.Counter(t for _, tf in cut for t in tf)
    terms = collections.defaultdict(set)
    for i, t in items:
        terms[i] |= set(ALNUM.findall((t or "").translate(FOLD)))
    for item, words in terms.items():
        scores = []
        for i, tf in cut:
            m = 100 - 50 + (50 * sum(tf.values()) * len(cut)) // total
            s = sum(math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
                    for t in words if tf[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)}
    return out


def test_search_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "The SAME text; twice", "s"), (2, None, "s"), (3, "", "s"), (None, "É x a", "s"), (4, "a", "s"),
                                   (4, "row without", "s"), (5, "the same text twice here", "s")], "item_id long, text string, score string")
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(odd_docs, items.where("item_id = 2")).count() == 0
    want = search([(r.doc_id, r.text) for r in odd_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and {tuple(r) for r in lexical.ranked(odd_docs, items).collect()} == want


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    """The kernels of one shard: many blocks, thresholds that rule most of them out."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 400, 40) for _ in range(12)]
    texts = [" ".join(f"t{w}" for w in np.append(rng.choice(topics[i % 12], 20), rng.zipf(1.5, 15) % 400)) for i in range(900)]
    items = [(q, " ".join(f"t{w}" for w in rng.choice(topics[q], 6))) for q in range(12)]

    class Shared:
        def __init__(self, value):
            self.value = value

    pairs = [(i, w) for i, t in items for w in set(t.split())]
    words = sorted({w for _, w in pairs})
    docs = pd.DataFrame({"doc_id": np.arange(900), "raw": [t.encode() for t in texts]})
    shard = pd.concat(lexical._pack(Shared(words))([docs]))
    df = np.array([sum(w in t.split() for t in texts) for w in words])
    q = lexical.Queries(pairs, words, df, int(shard["docs"].sum()), int(shard["words"].sum()))
    (row,) = itertools.chain.from_iterable(p.itertuples() for p in lexical._build(Shared(q))([shard]))
    index = lexical.Index(row, q)
    want, skipped, met = search(list(enumerate(texts)), items, 10), 0, 0
    for k, item in enumerate(q.items):
        mine = sorted((x for x in want if x[0] == item), key=lambda x: x[1])
        tenth = int(index.promising(k, 10)[-1])
        assert tenth <= mine[-1][3]
        for threshold in (0, tenth, mine[-1][3]):
            docs_found, scores = index.search(k, threshold, 10)
            assert [(int(index.ids[d]), int(s)) for d, s in zip(docs_found, scores)] == [(x[2], x[3]) for x in mine]
        blocks, bound = index.bounds(k, mine[-1][3])
        every, _ = index.bounds(k, 0)
        met, skipped = met + len(every), skipped + len(every) - int((bound >= mine[-1][3]).sum())
        # a bound is never below a member's score
        for b, high in zip(every, index.bounds(k, 0)[1]):
            assert high >= index.score(k, np.array([b]))[1].max()
    assert skipped > met / 2
