"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text (k = 2 for short phrases, 4 for longer
templates) are hashed and joined with the templates' k-gram positions.  A hit
at word ``pos`` for template position ``tpos`` votes for the diagonal
``pos - tpos``.  Votes are summed per diagonal; neighbouring diagonals of a
template (a word more or less in a copy) are merged into one span; a span is
verified by comparing the words themselves: the join keeps a hit only where
its k-gram's words equal the template's, and a span must hold enough of the
template's k-grams within its length.

Phrases are templates that must match whole on one diagonal.  Templates are a
fixed list of a few hundred k-grams, so that side is broadcast.

Defined results: null texts are empty texts; a text without words has no
places; rows that repeat an id and text are given each; rows with one id and
different texts are kept apart by a hash of the text; ids may be null; other
columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_GAP, table, written

#: Phrase -> label. A place is a run of exactly these words.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The opening words of license texts and notices -> label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license": "lgpl",
    "released under the mit license": "mit",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}

SHORT, LONG = 2, 4
ANCHOR = "\u0000"       # one pseudo k-gram per text, so that every text passes the join once


def template_rows(phrases=None, templates=None) -> list[tuple]:
    """(gram, template, tpos, grams of the template, k, label, base): one row per k-gram."""
    out, number = [(ANCHOR, -1, 0, 1, 0, None, False)], 0
    for texts, k, base in ((PHRASES if phrases is None else phrases, SHORT, True),
                           (TEMPLATES if templates is None else templates, LONG, False)):
        for text, label in texts.items():
            words = text.split()
            if len(words) < k:
                raise ValueError(f"template shorter than {k} words: {text!r}")
            grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
            out += [(g, number, i, len(grams), k, label, base) for i, g in enumerate(grams)]
            number += 1
    return out


def _pairs(words: Column, step: int) -> Column:
    """words[i] + ' ' + words[i + step] for every i that has both."""
    n = F.greatest(F.size(words) - step, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, step + 1, n), lambda a, b: F.concat(a, F.lit(" "), b))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per k-gram hit and one anchor row (template -1) per text:
    doc_id, print, n_words, template, tpos, grams, k, label, base, pos."""
    # lower() changes letters beyond A-Z too, but no word's bounds, and of those letters only
    # the Kelvin sign becomes a letter of A-Z (k, in no phrase)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")
    cut = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("print"), words.alias("words"))
    two = cut.select("doc_id", "print", F.size("words").cast("long").alias("n_words"), _pairs(F.col("words"), 1).alias("two"))
    grams = two.select("doc_id", "print", "n_words", F.size("two").alias("n_two"),
                       F.concat(F.array(F.lit(ANCHOR)), F.col("two"), _pairs(F.col("two"), 2)).alias("grams"))
    rolled = (grams.select("doc_id", "print", "n_words", "n_two", F.posexplode_outer("grams").alias("at", "gram"))
              .withColumn("hash", F.xxhash64("gram")))
    own = templates.withColumnRenamed("gram", "template_gram").withColumn("template_hash", F.xxhash64("template_gram"))
    # the words of each hit are compared too: equal hashes alone do not count
    joined = rolled.join(F.broadcast(own), (F.col("hash") == F.col("template_hash"))
                         & (F.col("gram") == F.col("template_gram")))
    pos = F.when(F.col("at") > F.col("n_two"), F.col("at") - 1 - F.col("n_two")).otherwise(F.col("at") - 1).cast("long")
    right_k = (F.col("k") == 0) | ((F.col("k") == LONG) == (F.col("at") > F.col("n_two")))
    return joined.where(right_k).select("doc_id", "print", "n_words", "template", "tpos", F.col("grams"), "k", "label", "base",
                                        pos.alias("pos"))


def spans(found: DataFrame, drift: int = 3, coverage: float = 0.6) -> DataFrame:
    """Verified spans: doc_id, print, template, label, base, start, covered (0 to 1).

    ``drift``: how far apart neighbouring diagonals may be to be one span;
    ``coverage``: the least share of a template's k-grams in a span."""
    key = ["doc_id", "print", "template"]
    votes = (found.where("template >= 0").dropDuplicates([*key, "tpos", "pos"])
             .withColumn("diagonal", F.col("pos") - F.col("tpos"))
             .groupBy(*key, "grams", "k", "label", "base", "diagonal")
             .agg(F.count("*").alias("votes"), F.min("pos").alias("start"), F.max("pos").alias("stop")))
    whole = (votes.where(F.col("base") & (F.col("votes") == F.col("grams")))
             .select(*key, "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("covered")))
    line = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > drift).cast("int"), F.lit(1))
    merged = (votes.where(~F.col("base")).withColumn("span", F.sum(apart).over(line.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*key, "label", "base", "grams", "k", "span")
              .agg(F.least(F.sum("votes"), F.first("grams")).alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop")))
    near = (merged.withColumn("covered", F.col("votes") / F.col("grams"))
            .where((F.col("covered") >= coverage)
                   & (F.col("stop") - F.col("start") < 2 * F.col("grams") + 2 * drift))
            .select(*key, "label", "base", "start", "covered"))
    return whole.unionByName(near)


def scan(docs: DataFrame, phrases=None, templates=None, **params) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(
        template_rows(phrases, templates),
        "gram string, template int, tpos int, grams int, k int, label string, base boolean")
    found = written(hits(docs, rows), "license-hits")
    key = ["doc_id", "print"]
    placed = spans(found, **params).select(*key, F.lit(0).alias("rows"), F.lit(None).cast("long").alias("n_words"),
                                           "label", "base", "start", "covered")
    texts = found.where("template = -1").select(*key, F.lit(1).alias("rows"), "n_words", F.lit(None).cast("string").alias("label"),
                                                F.lit(False).alias("base"), F.lit(None).cast("long").alias("start"),
                                                F.lit(0.0).alias("covered"))
    base = F.col("base")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = (texts.unionByName(placed).groupBy(*key)
           .agg(F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"),
                F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
                F.max(F.when(base, F.col("start"))).alias("last_word"),
                names(F.when(base, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"),
                F.max("covered").cast("double").alias("score")))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def op5_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
