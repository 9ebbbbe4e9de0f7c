"""Text mining on whole documents.

Tokenising, stop-word filtering and encoding are JVM expressions over
arrays (``regexp_extract_all``, ``filter``, ``transform``) — no Python per
row.  Corpus-level statistics use the *long* form ``(doc, term, tf)``:
document frequencies are partial aggregates, checkpointed before they are
joined back, so that AQE can split the side of a term present in every
document (it cannot where an aggregate stands between shuffle and join).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.ranking import row_number
from quarry.session import cut_lineage

# The standard English stop-word list (179 words) used by the
# reference's NLP toolkit.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very
s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't
won won't wouldn wouldn't
""".split()

LETTERS = r"\p{L}+"


def explode_tokens(df: DataFrame, tokens, *keep, alias: str = "term", pos: str | None = None) -> DataFrame:
    """One row per array element.  ``explode_outer`` + a null filter instead
    of ``explode``: a plain explode makes Catalyst infer ``size(array) > 0``
    below the projection, which would evaluate the whole tokeniser twice."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    if pos:
        out = df.select(*keep, F.posexplode_outer(col).alias(pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(col).alias(alias))
    return out.where(F.col(alias).isNotNull())


def whitespace_tokens(c: Column, lower: bool = True) -> Column:
    """``text.split()`` (optionally lower-cased) with empty edge pieces removed."""
    s = F.lower(c) if lower else c
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def letter_tokens(c: Column) -> Column:
    """Lower-cased runs of letters in any script (``\\p{L}+``)."""
    return F.regexp_extract_all(F.lower(c), F.lit(LETTERS), 0)


def drop_words(tokens: Column, stop=STOP_WORDS, min_len: int = 0) -> Column:
    """Filter an array of tokens, keeping order and duplicates (C6).  The
    stop list becomes a hash-set membership test (``INSET``), not a scan."""
    stop = sorted(set(stop)) if stop else []

    def keep(x):
        cond = F.length(x) > min_len
        if stop:
            cond = cond & ~x.isin(stop)
        return cond
    return F.filter(tokens, keep)


def lemmatize(tokens: Column, lemmas: dict | None) -> Column:
    """Map tokens through a lemma dictionary; unknown tokens stay as they are."""
    if not lemmas:
        return tokens
    m = F.create_map(*[F.lit(x) for kv in sorted(lemmas.items()) for x in kv])
    return F.transform(tokens, lambda x: F.coalesce(F.try_element_at(m, x), x))


def lemmatize_by(df: DataFrame, id_col: str, tokens: str, lemmas: DataFrame, out: str | None = None) -> DataFrame:
    """Replace tokens by a lemma table (token, lemma) of any size; unknown tokens stay.

    Only distinct words of a text travel: they meet the table in one join, and
    each text gets back a map of just its own words that change.  A token that
    the table names more than once has its smallest lemma; null tokens or
    lemmas in the table are ignored; null token arrays stay null; rows that
    repeat an id, or have none, are mapped alike."""
    out = out or tokens
    table = (lemmas.where("token IS NOT NULL AND lemma IS NOT NULL AND token <> lemma")
             .groupBy("token").agg(F.min("lemma").alias("__lemma")))
    words = df.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(tokens)).alias("token"))
    changed = (words.join(table, "token").groupBy("__id")
               .agg(F.map_from_entries(F.collect_set(F.struct("token", "__lemma"))).alias("__map")))
    met = df.join(changed, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    swapped = F.transform(tokens, lambda x: F.coalesce(F.try_element_at("__map", x), x))
    return met.withColumn(out, swapped).drop("__id", "__map")


def suffix_lemmas(words: DataFrame, suffixes) -> DataFrame:
    """A lemma table (token, lemma) from a vocabulary (term): a word with one of the
    suffixes whose stem is a word too has the shortest such stem as its lemma."""
    stems = F.filter(F.array(*[F.when(F.col("term").endswith(s), F.expr(f"left(term, length(term) - {len(s)})")) for s in suffixes]),
                     lambda x: x.isNotNull() & (F.length(x) > 0))
    cut = words.select(F.col("term").alias("token"), F.explode(stems).alias("lemma"))
    known = words.select(F.col("term").alias("lemma")).distinct()
    return (cut.join(known, "lemma", "left_semi").groupBy("token")
            .agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("s")).select("token", "s.lemma"))


def preprocess(df: DataFrame, col: str, out: str = "tokens", stop=STOP_WORDS,
               min_len: int = 2, lemmas: dict | None = None, joined: str | None = None) -> DataFrame:
    """lower → letter tokens → stop words and short tokens out → lemmas (G6/G7);
    optionally also the space-joined clean text."""
    toks = lemmatize(drop_words(letter_tokens(F.col(col)), stop, min_len), lemmas)
    df = df.withColumn(out, toks)
    if joined:
        df = df.withColumn(joined, F.array_join(F.col(out), " "))
    return df


def term_counts(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """Bag of words in long form (doc, term, tf).

    Token arrays are hash-partitioned by document *before* exploding: one
    shuffle of compact arrays, after which the per-(doc, term) count and any
    later per-document window need no further exchange."""
    return (explode_tokens(df.select(doc, tokens).repartition(doc), tokens, doc)
            .groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")))


def dictionary(counts: DataFrame) -> DataFrame:
    """(term, term_id, df): ids 0.. in term order, plus document frequency."""
    d = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    r = row_number(d, ["term"], out="_rn")
    return r.select("term", (F.col("_rn") - 1).alias("term_id"), "df")


def tfidf(counts: DataFrame, doc: str, n_docs: int | None = None) -> DataFrame:
    """tf · log2(N/df), L2-normalised per document; zero weights dropped."""
    N = n_docs if n_docs is not None else counts.select(doc).distinct().count()
    dfreq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    w = counts.join(cut_lineage(dfreq), "term").withColumn(
        "_w", F.col("tf") * F.log2(F.lit(float(N)) / F.col("_df")))
    w = w.where(F.abs(F.col("_w")) > 1e-12)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return w.select(doc, "term", (F.col("_w") / norm).alias("tfidf"))


def top_words(df: DataFrame, col: str, n: int = 200, stop=STOP_WORDS, ignore=()) -> DataFrame:
    """Most common lower-cased whitespace words not in ``stop`` / ``ignore``
    (E13, C5).  Ties are broken by word so the cut is deterministic."""
    excluded = sorted(set(stop) | {str(w) for w in ignore})
    toks = whitespace_tokens(F.col(col))
    if excluded:   # literal list of known size: hash-set test inside the array, no join
        toks = F.filter(toks, lambda x: ~x.isin(excluded))
    words = explode_tokens(df, toks, alias="word")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(n)


def vocabulary(df: DataFrame, tokens: str, reserved=("[PAD]", "[UNK]", "[CLS]", "[SEP]")) -> DataFrame:
    """(term, id): reserved symbols first (pad = 0), then terms in order."""
    terms = explode_tokens(df, tokens).distinct()
    r = row_number(terms, ["term"], out="_rn")
    voc = r.select("term", (F.col("_rn") - 1 + len(reserved)).alias("id"))
    res = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(reserved)], voc.schema)
    return res.unionByName(voc)


def encode_pad(df: DataFrame, doc: str, tokens: str, vocab: DataFrame, max_len: int = 512,
               out: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """Token ids with [CLS]/[SEP], truncated to ``max_len`` and right-padded
    with 0; the mask is 1 where the id is not 0 (G8).  Ids are attached with
    a join on (term) over exploded positions, then re-assembled per document
    in position order."""
    # truncation to max_len is the feature: later positions never get an id
    cut = df.withColumn(tokens, F.slice(tokens, 1, max_len - 2))
    ex = explode_tokens(cut, tokens, doc, pos="pos")
    ids = ex.join(vocab, "term", "left").select(doc, "pos", F.coalesce("id", F.lit(1)).alias("id"))
    per = ids.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_p"))
    body = F.slice(F.transform(F.col("_p"), lambda s: s["id"]), 1, max_len - 2)
    seq = F.concat(F.array(F.lit(2)), body, F.array(F.lit(3)))
    padded = F.concat(seq, F.array_repeat(F.lit(0), F.lit(max_len) - F.size(seq)))
    base = df.select(doc).join(per, doc, "left")
    seq_all = F.when(F.col("_p").isNull(), F.concat(F.array(F.lit(2), F.lit(3)),
                                                    F.array_repeat(F.lit(0), max_len - 2))
                     ).otherwise(padded)
    return base.select(doc, seq_all.alias(out)).withColumn(
        mask, F.transform(F.col(out), lambda x: (x != 0).cast("int")))


def lexicon_sentiment(df: DataFrame, doc: str, tokens: str, lexicon) -> DataFrame:
    """Average polarity and subjectivity of the lexicon words found in each
    document; 0.0 when none is found (K15).

    ``lexicon`` is either a DataFrame (word, polarity, subjectivity) — joined
    after exploding, broadcast only if AQE finds it small — or a list of
    (word, polarity, subjectivity) tuples: then its size is known, each token
    array is first filtered to lexicon words with a hash-set test, and only
    the hits are exploded and joined."""
    if isinstance(lexicon, DataFrame):
        lex = lexicon
        toks = F.col(tokens)
    else:
        entries = list(lexicon)
        lex = df.sparkSession.createDataFrame(
            entries, "word string, polarity double, subjectivity double")
        words = sorted({w for w, _, _ in entries})
        toks = F.filter(F.col(tokens), lambda x: x.isin(words))
        lex = F.broadcast(lex)     # literal list: size known
    ex = explode_tokens(df, toks, doc, alias="word")
    hits = ex.join(lex, "word").groupBy(doc).agg(
        F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity"))
    return df.select(doc).join(hits, doc, "left").select(
        doc, F.coalesce("polarity", F.lit(0.0)).alias("polarity"),
        F.coalesce("subjectivity", F.lit(0.0)).alias("subjectivity"))
