"""Queries against brute force on the small tables."""
import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from llm_fixtures import SF_SMALL

from quarry.llm.registry import Q, SQL


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def alnum(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return Q[name](spark, SF_SMALL).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = Q[name](spark, SF_SMALL)
    cur = con.execute(SQL[name])
    place = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in cur.fetchall())


def test_op1(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    last = collections.defaultdict(int)
    for p in pages:
        last[p.html] = max(last[p.html], p.page_id)
    want = set()
    for p in pages:
        raw, first = (p.html or "").encode(), last[p.html]
        same = first == p.page_id
        want.add((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else first))
    assert {tuple(r) for r in rows(spark, "op1_warc")} == want


def test_op4(spark, docs):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    windows = collections.defaultdict(set)
    for r in items:
        w = alnum(r.text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i:i + 10])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: tuple(r)[1:] for r in rows(spark, "op4_decontaminate")}
    hit_any = 0
    for i, text in docs.items():
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= own
        hit_any += bool(hit)
        assert got[i] == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    assert hit_any


def test_op5(spark, docs):
    phrases = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
    for r in rows(spark, "op5_licenses"):
        w, places, labels = alnum(docs[r.doc_id]), [], set()
        for p, label in phrases.items():
            p = p.split()
            for i in range(len(w)):
                if w[i:i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op6(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, "op6_bpe"):
        ids = own.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))


def test_op7(spark, docs):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = collections.Counter(itertools.chain.from_iterable(w for i, w in tokens.items() if not held[i]))
    n, v = sum(count.values()), len(count)
    base = model = 0
    for r in rows(spark, "op7_lm_score"):
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_op7_score(spark, docs):
    """Deleted interpolation in plain Python: dictionaries of counts, EM by hand on the documented grid."""
    def tokens(text):
        return [None, *re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), b"\n"]
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in docs}

    def counted(ids):
        single, pair = collections.Counter(), collections.Counter()
        for i in ids:
            t = tokens(docs[i])
            single.update(t)
            pair.update(itertools.pairwise(t))
        n = sum(single.values()) - single[None]
        return single, pair, n, len(single) - (None in single)

    def parts(t, model):
        single, pair, n, v = model
        for h, w in itertools.pairwise(t):
            yield single[h].bit_length(), pair[h, w] / max(single[h], 1), single[w] / n

    rest = counted([i for i in docs if fold[i] > 1])
    cells = collections.Counter()
    for i in docs:
        if fold[i] == 1:
            for bucket, p2, p1 in parts(tokens(docs[i]), rest):
                cells[bucket, *(round(8 * math.log2(p)) if p else None for p in (p2, p1))] += 1
    weights = collections.defaultdict(lambda: [0.4, 0.5, 0.1], {0: [0, 0.9, 0.1]})
    value = lambda cell: 0.0 if cell is None else 2.0 ** (cell / 8)
    for _ in range(60):
        mass = {}
        for (bucket, c2, c1), k in cells.items():
            terms = [l * p for l, p in zip(weights[bucket], (value(c2), value(c1), 1 / (rest[3] + 1)))]
            own = mass.setdefault(bucket, [1e-3 if l > 0 else 0 for l in weights[bucket]])
            for j in range(3):
                own[j] += k * terms[j] / sum(terms)
        for bucket, own in mass.items():
            weights[bucket] = [x / sum(own) for x in own]
    even = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(64) if b not in mass}     # nothing held out there
    weights.update(even)
    whole = counted([i for i in docs if fold[i] > 0])
    found = {r.doc_id: r.score for r in rows(spark, "op7_lm_score")}
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        want = sum(math.log10(l2 * p2 + l1 * p1 + l0 / (whole[3] + 1))
                   for bucket, p2, p1 in parts(tokens(text), whole) for l2, l1, l0 in [weights[bucket]])
        assert found[i] == pytest.approx(want, rel=1e-6)



@pytest.mark.parametrize("name,label,modulus,rest", [("op8_toxicity", "toxic", 5, 0), ("op10_quality", "quality", 3, 1)])
def test_classifiers(spark, docs, name, label, modulus, rest):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    found = rows(spark, name)
    assert {r.doc_id for r in found} == set(docs)
    right = total = 0
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in known:
            right, total = right + (known[r.doc_id] == r.predicted), total + 1
    assert right / total > 0.9


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(sets):
    ids = sorted(sets)
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            part[y] = x
    return {i: find(i) for i in ids}


def test_op9(spark, docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    part = groups(sets)
    found = rows(spark, "op9_near_duplicates")
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {
        (i, len(s), part[i], part[i] == i) for i, s in sets.items()}
    assert any(not r.kept for r in found)


def test_op9_chain_of_near_copies(spark):
    """Variants that reach the similarity only along a chain form one group."""
    from quarry.llm.minhash import near_duplicates
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(40):
        texts.append(" ".join(words))
        for i in rng.choice(200, 3 if k % 2 else 6, replace=False):
            words[i] = f"n{k}x{i}"
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    part = groups({i: shingles(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in near_duplicates(frame).collect()} == part


def _borderline(count):
    """Variants of one text with three words changed each: most pairs lie just under the similarity."""
    rng = np.random.default_rng(count)
    words = [f"w{i}" for i in range(150)]
    for k in range(count):
        own = list(words)
        for i in rng.choice(150, 3, replace=False):
            own[i] = f"n{k}x{i}"
        yield " ".join(own)


def test_op9_borderline_variants(spark, monkeypatch):
    """Components equal brute force; what is confirmed or leaves a cell grows with the nodes."""
    from quarry.llm import minhash
    pairs, spanning = [], []
    confirmed, across = minhash.confirmed, minhash.links_across

    def counted(found, *rest):
        pairs.append(found.count())
        return confirmed(found, *rest)

    def counted_across(*args):
        found = minhash.written(across(*args), "links")
        spanning.append(found.count())
        return found

    monkeypatch.setattr(minhash, "confirmed", counted)
    monkeypatch.setattr(minhash, "links_across", counted_across)
    for count in (150, 300, 600):
        texts = dict(enumerate(_borderline(count)))
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        pairs.clear(), spanning.clear()
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
        assert found == groups({i: shingles(t) for i, t in texts.items()})
        assert max(pairs) <= count
        assert sum(spanning) <= count * minhash.BANDS


def test_op9_id_with_two_texts(spark):
    """A repeated id is one document that links by any of its texts."""
    from quarry.llm.minhash import near_duplicates
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows_ = [(1, two), (4, one), (4, two + " more"), (6, one + " tail"), (9, "alone here"), (3, None), (None, one)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect()}
    assert found == {(1, 1, True), (4, 1, False), (6, 1, False), (9, 9, True), (3, 3, True), (None, None, True)}
