"""The pipeline against its stages' rules, worked out beside them."""
import corpus_pipeline
from llm_fixtures import SF_SMALL
from quarry.llm import decontaminate, minhash, quality, toxicity
from quarry.llm.common import crc_mod, table

from test_brute_force import groups, shingles


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    labels = table(spark, SF_SMALL, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, labels, "toxic", crc_mod("doc_id", 5) != 0)).collect() if r.score >= 0.5}
    first = corpus_pipeline.drop_toxic(spark, docs, SF_SMALL)
    kept = {r.doc_id for r in first.collect()}
    assert bad and kept == set(text) - bad and first.columns == docs.columns
    good = {r.doc_id for r in quality.scored(first, quality.fit(first, labels, "quality", crc_mod("doc_id", 3) != 1)).collect() if r.score >= 0.5}
    second = corpus_pipeline.drop_low_quality(spark, first, SF_SMALL)
    assert {r.doc_id for r in second.collect()} == good < kept
    part = groups({i: shingles(text[i]) for i in good})
    third = corpus_pipeline.drop_near_duplicates(spark, second, SF_SMALL)
    one = {r.doc_id for r in third.collect()}
    assert one == set(part.values()) and third.columns == docs.columns
    clean = {r.doc_id for r in decontaminate.scan(third, table(spark, SF_SMALL, "benchmark")).collect() if r.hit.n_hit == 0}
    result = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert set(result) == clean and len(clean) < len(one)
    assert minhash.deduplicated(third).count() == len(one)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `__toxic` double, `__quality` double, `__gone` long, score string, node long, `row` string"


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, SF_SMALL, "documents")
    extra = {"__toxic": 0.25, "__quality": 0.75, "__gone": 7, "score": "s", "node": 9, "row": "r"}
    rows = [(*r, *extra.values()) for r in docs.limit(60).collect()]
    rows += [(10_000, None, None, None, None, *extra.values()), (10_001, "", None, None, None, *extra.values()),
             (None, rows[0][1], None, None, None, *extra.values()), rows[0], (10_002, "long words here " * 20000, None, None, None, *extra.values())]
    for n in (len(rows), 0):
        given = spark.createDataFrame(rows[:n], CLASHING)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, SF_SMALL)
            kept = out.collect()
            assert out.columns == given.columns, name
            assert {tuple(r) for r in kept} <= set(rows)
            assert all(tuple(r[c] for c in extra) == tuple(extra.values()) for r in kept)
        assert corpus_pipeline.to_tokens(spark, given, SF_SMALL).count() == n
