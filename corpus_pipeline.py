"""Corpus pipeline: five stages from raw documents to token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

toxicity        documents scored 0.5 or more go
quality         documents scored below 0.5 go
near_duplicates one document of each group of near copies stays (smallest id)
decontamination documents that hold a benchmark window go
bpe             token ids of the whole texts, with digests of ids and decoding

Nulls, repeated ids and empty tables: a null or empty text is scored by the
models' biases, is near to nothing and holds no benchmark window; a null id is
never dropped as a duplicate; rows that repeat an id are scored each and stay
or go together as duplicates; columns of any name and number come through the
first four stages unchanged; a stage over no rows returns none.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, minhash, quality, toxicity
from quarry.llm.common import crc_mod, prepared, scratch_dir, table


def _nested(docs):
    """Whole rows beside their text: whatever columns the table has, none meets a score's name."""
    return docs.select(F.struct("*").alias("row"), F.col("text"))


@prepared
def drop_toxic(spark, docs, sf_dir):
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 5) != 0)
    return toxicity.scored(_nested(docs), model, into="score").where("score < 0.5").select("row.*")


@prepared
def drop_low_quality(spark, docs, sf_dir):
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 3) != 1)
    return quality.scored(_nested(docs), model, into="score").where("score >= 0.5").select("row.*")


@prepared
def drop_near_duplicates(spark, docs, sf_dir):
    return minhash.deduplicated(docs)


@prepared
def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@prepared
def to_tokens(spark, docs, sf_dir):
    import public_tokenizers
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: Learned models, connected components and tokens have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex[:8]}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
