"""Lemmas from a table."""
from pyspark.sql import functions as F

from quarry.operators import text as T


def test_lemma_table_by_join(spark):
    docs = spark.createDataFrame([(1, ["cats", "run", "cats"]), (1, ["ran"]), (None, ["cats", None]), (4, []), (5, None)],
                                 "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "dog"), ("ran", "run"), (None, "x"), ("run", None)],
                                   "token string, lemma string")
    got = T.lemmatize_by(docs, "id", "tokens", lemmas, out="l").select("id", "tokens", "l").collect()
    assert sorted(((r.id, r.l) for r in got), key=repr) == sorted(
        [(1, ["cat", "run", "cat"]), (1, ["run"]), (None, ["cat", None]), (4, []), (5, None)], key=repr)
    assert T.lemmatize_by(docs, "id", "tokens", lemmas.limit(0)).columns == ["id", "tokens"]
    assert T.lemmatize_by(docs.limit(0), "id", "tokens", lemmas).count() == 0


def test_suffix_lemmas_need_the_stem(spark):
    words = spark.createDataFrame([("walk",), ("walks",), ("walking",), ("sing",), ("s",), ("walkings",)], "term string")
    got = {tuple(r) for r in T.suffix_lemmas(words, ("ing", "s")).collect()}
    assert got == {("walks", "walk"), ("walking", "walk"), ("sing", "s"), ("walkings", "walking")}
