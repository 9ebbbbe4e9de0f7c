"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import no_docs, odd_docs  # noqa: F401
from quarry.llm import bpe, chat, decontaminate, licenses, minhash, ngram_lm, quality, toxicity, voronoi, warc

LABELS = "doc_id long, toxic int, quality int"


def labels(spark, rows=((0, 0, 1), (9, 1, 0), (None, 1, 1), (10, None, None))):
    return spark.createDataFrame(list(rows), LABELS)


def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("which", ["odd", "none"])
def test_every_text_operator_keeps_every_row(spark, odd_docs, no_docs, which):
    docs = odd_docs if which == "odd" else no_docs
    bench = spark.createDataFrame([(1, "one two three four five"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    n = docs.count()
    assert decontaminate.scan(docs.select("doc_id", "text"), bench).count() == n
    assert licenses.scan(docs).count() == n
    assert bpe.digests(docs, vocabulary()).count() == n
    assert ngram_lm.score(docs, F.lit(ngram_lm.COUNTED)).count() == n
    assert minhash.near_duplicates(docs).count() == n
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        for rows in (labels(spark), labels(spark, [])):
            scores = [r.score for r in module.scored(docs.select("doc_id", "text"), module.fit(docs, rows, label)).collect()]
            assert len(scores) == n and all(0 <= s <= 1 for s in scores)


def test_decontaminate_values(spark, odd_docs):
    bench = spark.createDataFrame([(7, "One, two three"), (8, "text twice"), (9, "zzz")], "item_id long, text string")
    for limit in (1, 200_000):     # one pattern per pass gives the same as one pass
        got = decontaminate.scan(odd_docs.select("doc_id", "text"), bench, max_patterns=limit).collect()
        by = {r.doc_id: r.hit for r in got}
        assert (by[5].n_words, by[5].n_hit, by[5]["items"]) == (5, 3, ["7"])
        assert (by[12].n_hit, by[12]["items"]) == (2, ["8"])
        assert (by[0].n_words, by[0].n_hit, by[0].mask) == (0, 0, None)
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 5


def test_licenses_merge_diagonals(spark):
    text = ("Permission is hereby granted, free of charge, to really any person obtaining a copy of this software and "
            "associated documentation files")
    frame = spark.createDataFrame([(1, text), (1, text), (2, "the mit license, MIT License"), (None, "cc-by")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.scan(frame).collect())
    assert got == [(0, 1, 0, 0, "cc-by"), (1, 0, None, None, "mit"), (1, 0, None, None, "mit"), (2, 2, 1, 3, "mit")]


def test_near_duplicates_values(spark, odd_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd_docs).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (4, 1, 4, True), (12, 2, 12, True), (13, 2, 12, False)} <= got
    assert any(i is None and c is None and k for i, _, c, k in got)
    kept = minhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_counterfactual_penalty_keeps_neutral_mentions(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        text = list(rng.choice(plain, 12))
        if toxic:
            text += ["idiot"] if i % 8 else ["scum"]
            text += ["muslim"] * (rng.random() < 0.6)      # frequent in toxic rows only
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(a, c, 1) for a, _, c in rows], LABELS)
    ask = spark.createDataFrame([(0, "w1 w2 w3 muslim"), (1, "w1 w2 w3 scum")], "doc_id long, text string")
    score = lambda f: [r.score for r in toxicity.scored(ask, toxicity.fit(docs, known, fairness=f)).orderBy("doc_id").collect()]
    (free, bad), (fair, still) = score(0.0), score(50.0)
    assert fair < 0.5 * free and fair < 0.3 and bad > 0.5 and still > 0.5


def test_factorisation_machine_identity():
    rng = np.random.default_rng(1)
    size = len(quality.STATISTICS) + (1 << quality.HASH_BITS)
    model = quality.Model(0.3, rng.normal(0, .1, size), rng.normal(0, .1, (size, quality.RANK)), np.zeros(len(quality.STATISTICS)),
                          np.full(len(quality.STATISTICS), 2.0))
    raw = b"Some words, some more words | and 12 bars!"
    stats, bucket, value = quality.Reader()(raw)
    x = np.concatenate([np.clip(np.array(stats) / 2, -4, 4), value])
    at = np.concatenate([np.arange(len(stats)), bucket + len(stats)])
    z = 0.3 + x @ model.linear[at] + sum(
        model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert model.scorer()(raw) == pytest.approx(1 / (1 + np.exp(-z)))


def test_warc(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\né"
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://b/\r\n", odd * 40), (4, "u", None), (5, "u", ""), (None, "u", "same"),
            (6, "u", "tiny"), (7, "u", "tiny"), (3, "http://b/\r\n", odd * 40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string")
    for n, (least, size) in enumerate([(0, 64), (5, 1 << 16)]):
        path = f"{tmp_path}/{n}"
        warc.write_archive(pages, path, min_bytes=least, segment_bytes=size, chunk_bytes=7, records_per_file=5)
        got = warc.read_archive(spark, path).collect()
        assert len(got) == len(rows)
        kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
        assert kinds[1] == (("revisit", 2) if least == 0 else ("response", None))
        assert kinds[4] == (("revisit", 5) if least == 0 else ("response", None))
        assert kinds[None] == ("response", None) and kinds[3] == ("response", None)
        assert [r.payload.decode() for r in got if r.page_id == 3] == [odd * 40] * 2
        assert all(r.payload_digest == warc.digest(b"same") and r.payload_bytes == 4 for r in got if r.page_id in (1, 2))
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), f"{tmp_path}/empty")).count() == 0


def test_warc_damage(spark):
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.dechunk(b"5\r\nabc") is None and warc.dechunk(b"zz\r\n") is None


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok <|end|>\n <\\|user|> \\\\ <|"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (2, 0, "assistant", "x"), (None, None, None, None),
            (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 1, "assistant", "a|>"), (4, 0, "system", "only")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("system", hard), ("user", ""), ("assistant", hard)]
    assert got[1].loss_text == hard and got[1].valid and got[1].first_invalid is None
    assert (got[2].valid, got[2].first_invalid) == (False, 0)
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[3].turns] == [("assistant", "a|>"), ("user", "b"), ("user", "b")]
    assert (got[4].valid, got[4].first_invalid) == (False, 1)
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-20, 20, 3 if i % 7 else 2).astype(float).tolist()) for i in range(400)]
    rows += [(1000, [float("nan"), 1.0, 2.0]), (1001, None), (1002, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0]), rows[3], (1003, []), (50, rows[50][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cell int")
    vectors = {i: tuple(int(np.floor(256 * x)) for x in v) for i, v in rows[:400]}
    want = []
    for q in range(0, 400, 50):
        scored = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    for pivots in (1, 16):
        got = voronoi.top_k(voronoi.whole_vectors(frame), F.col("id") % 50 == 0, pivots=pivots).collect()
        assert sorted(map(tuple, got)) == want
    assert voronoi.top_k(voronoi.whole_vectors(frame.limit(0)), F.col("id") % 50 == 0).count() == 0


def test_automaton_follows_the_merges():
    """Token sequences of the automaton equal those of the merges applied one after another."""
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "aa"), ("c", "ab"), ("ab", "ab")]
    automaton = bpe.MergeAutomaton(["a", "b", "c"], merges)
    rng = np.random.default_rng(2)
    for _ in range(500):
        parts = list(rng.choice(["a", "b", "c"], rng.integers(1, 12)))
        want = list(map(str, parts))
        for x, y in merges:
            i = 0
            while i + 1 < len(want):
                if (want[i], want[i + 1]) == (x, y):
                    want[i:i + 2] = [x + y]
                i += 1
        assert [automaton.label[t] for t in automaton.encode(list(map(str, parts)))] == want


def test_bpe_round_trip_of_words(spark, odd_docs):
    own = bpe.encode(odd_docs, vocabulary())
    text = {r.doc_id: r.decoded for r in bpe.decode(own, vocabulary()).collect()}
    assert text[0] == text[1] == ""
    assert text[4] == "one</w>" and "<|endoftext|>" in text[11]


def test_lm_weights_form_distributions():
    import pandas as pd
    cells = pd.DataFrame({"bucket": [0, 3, 3], "pair": [1, -8, 1], "word": [-40, -60, 1], "tokens": [5, 100, 7]})
    weights = ngram_lm.learn_weights(cells, 10)
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0 and weights[3, 0] > 0.5


def test_lm_keys_round_trip():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (ngram_lm._unpack_keys(ngram_lm._pack_keys(keys)) == keys).all()
        counts = rng.integers(0, 100000, n)
        assert (ngram_lm._unpack_counts(ngram_lm._pack_counts(counts)) == counts).all()


def test_digest_is_of_whole_text():
    assert warc.chunked(b"", 4) == b"0\r\n\r\n"
    assert hashlib.sha1(b"").digest()[:1] == b"\xda"


def test_decontaminate_counts_items_without_id(spark):
    docs = spark.createDataFrame([(1, "say one two three now"), (2, "clean"), (3, "one two three four five six")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five")], "item_id long, text string")
    for limit in (1, 100):
        got = {r.doc_id: (r.hit.n_hit, r.hit["items"], r.hit.mask is not None)
               for r in decontaminate.scan(docs, bench, max_patterns=limit).collect()}
        assert got == {1: (3, [], True), 2: (0, [], False), 3: (5, ["7"], True)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]


def test_toxicity_keeps_every_qualifying_feature(spark):
    # 5 pairs of toxic texts with 80 words of their own each
    texts = [(i, " ".join(f"{chr(97 + i // 2)}{j:03d}zz" for j in range(80)), 1) for i in range(10)]
    texts += [(i, "plain words", 0) for i in range(10, 200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    words = set().union(*(toxicity.word_features(w.encode()) for t in texts[:10] for w in t[1].split()))
    assert len(words) > 300 and words <= set(model.weights)


def test_quality_fits_on_6000_rows(monkeypatch):
    seen = []

    def sample(docs, labels, label, train, max_rows):
        seen.append(max_rows)
        raise StopIteration
    monkeypatch.setattr(quality, "labelled_sample", sample)
    with pytest.raises(StopIteration):
        quality.fit(None, None, train=True)
    assert seen == [6000]


def test_sets_of_paired_documents_take_one_python_worker(spark, monkeypatch):
    """Ids are tested where the sets are made; other documents yield none."""
    from quarry.llm import minhash
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x"), (None, "x y")], "doc_id long, text string")
    nodes = spark.createDataFrame([(1,), (3,), (4,), (5,)], "node long")
    kept = []
    monkeypatch.setattr(minhash, "written", lambda df, name: kept.append(df) or df)
    got = {r["node"]: len(r["members"]) // 8 for r in minhash.sets_of(docs, nodes, 5, "text").collect()}
    assert got == {1: 2, 5: 1}
    plan = kept[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1
