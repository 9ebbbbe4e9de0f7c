"""Registered queries: text mining."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import text as T
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(T.STOP_WORDS))) + "]"
_CLEAN = (f"list_filter(regexp_extract_all(lower(content), '\\p{{L}}+'), "
          f"lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))")
IGNORE = ["one", "would", "also", "like", "get"]
# Toy lexicon for the sentiment query: (word, polarity, subjectivity).
LEXICON = [("good", 0.7, 0.6), ("great", 0.8, 0.75), ("bad", -0.7, 0.67), ("poor", -0.4, 0.6),
           ("excellent", 1.0, 1.0), ("terrible", -1.0, 1.0), ("nice", 0.6, 1.0),
           ("new", 0.14, 0.45), ("old", 0.1, 0.2), ("best", 1.0, 0.3), ("worst", -1.0, 1.0),
           ("happy", 0.8, 1.0), ("sad", -0.5, 1.0), ("simple", 0.0, 0.36)]


def _rev(spark, sf):
    return fixture(spark, sf, "fx_docs")


def _clean(spark, sf):
    return T.preprocess(_rev(spark, sf), "content", "tokens")


def g5_tokens(spark, sf):
    r = _rev(spark, sf)
    t = T.whitespace_tokens(F.col("content"))
    return r.select("doc_id", F.size(t).cast("long").alias("n_words"),
                    F.element_at(t, 1).alias("first_word"), F.try_element_at(t, F.lit(-1)).alias("last_word"))


Q["g5_tokens"] = g5_tokens
SQL["g5_tokens"] = cte("fx_docs") + """,
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS w FROM fx_docs)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, w[1] AS first_word, w[-1] AS last_word FROM t"""


def g6_preprocess(spark, sf):
    c = T.preprocess(_rev(spark, sf), "content", "tokens", joined="content_clean")
    return c.select("doc_id", "content_clean", F.size("tokens").cast("long").alias("n_tokens"))


Q["g6_preprocess"] = g6_preprocess
SQL["g6_preprocess"] = cte("fx_docs") + f"""
SELECT doc_id, array_to_string({_CLEAN}, ' ') AS content_clean, CAST(len({_CLEAN}) AS BIGINT) AS n_tokens
FROM fx_docs"""

_LONG = cte("fx_docs") + f""",
tok AS (SELECT doc_id, unnest({_CLEAN}) AS term FROM fx_docs),
tc AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY doc_id, term)"""


SUFFIXES = ("ing", "ed", "ly", "s")


def g6_lemmas(spark, sf):
    d = _clean(spark, sf)
    lemmas = T.suffix_lemmas(d.select(F.explode("tokens").alias("term")).distinct(), SUFFIXES)
    c = T.lemmatize_by(d.select("doc_id", "tokens"), "doc_id", "tokens", lemmas)
    return c.select("doc_id", F.array_join("tokens", " ").alias("content_clean"))


Q["g6_lemmas"] = g6_lemmas
SQL["g6_lemmas"] = cte("fx_docs") + f""",
txt AS (SELECT doc_id, {_CLEAN} AS w FROM fx_docs),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM txt),
voc AS (SELECT DISTINCT term FROM tok),
cut AS (SELECT v.term AS token, left(v.term, length(v.term) - length(x.s)) AS lemma
        FROM voc v JOIN (SELECT unnest({list(SUFFIXES)}) AS s) x ON ends_with(v.term, x.s) AND length(v.term) > length(x.s)),
lem AS (SELECT token, arg_min(lemma, length(lemma)) AS lemma FROM cut WHERE lemma IN (SELECT term FROM voc) GROUP BY token),
done AS (SELECT t.doc_id, string_agg(COALESCE(l.lemma, t.term), ' ' ORDER BY t.pos) AS c
         FROM tok t LEFT JOIN lem l ON l.token = t.term GROUP BY t.doc_id)
SELECT x.doc_id, CASE WHEN x.w IS NULL THEN NULL ELSE COALESCE(d.c, '') END AS content_clean
FROM txt x LEFT JOIN done d ON d.doc_id = x.doc_id"""


def j4_term_counts(spark, sf):
    return T.term_counts(_clean(spark, sf), "doc_id", "tokens").select(
        "doc_id", "term", F.col("tf").cast("long").alias("tf"))


Q["j4_term_counts"] = j4_term_counts
SQL["j4_term_counts"] = _LONG + "\nSELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tc"


def j4_dictionary(spark, sf):
    d = T.dictionary(T.term_counts(_clean(spark, sf), "doc_id", "tokens"))
    return d.select("term", F.col("term_id").cast("long").alias("term_id"),
                    F.col("df").cast("long").alias("df"))


Q["j4_dictionary"] = j4_dictionary
SQL["j4_dictionary"] = _LONG + """
SELECT term, CAST(ROW_NUMBER() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id, CAST(COUNT(*) AS BIGINT) AS df
FROM tc GROUP BY term"""


def j5_tfidf(spark, sf):
    r = _clean(spark, sf)
    n = r.count()
    t = T.tfidf(T.term_counts(r, "doc_id", "tokens"), "doc_id", n_docs=n)
    return t.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


Q["j5_tfidf"] = j5_tfidf
SQL["j5_tfidf"] = _LONG + """,
n AS (SELECT COUNT(*) AS n FROM fx_docs),
d AS (SELECT term, COUNT(*) AS df FROM tc GROUP BY term),
w AS (SELECT tc.doc_id, tc.term, tc.tf * LOG2(n.n / d.df) AS w FROM tc JOIN d USING (term), n),
w2 AS (SELECT * FROM w WHERE ABS(w) > 1e-12)
SELECT doc_id, term, ROUND(w / SQRT(SUM(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w2"""


def e13_top_words(spark, sf):
    return T.top_words(_rev(spark, sf), "content", 200, ignore=IGNORE).select(
        "word", F.col("count").cast("long").alias("count"))


Q["e13_top_words"] = e13_top_words
_IGN = "[" + ", ".join(f"'{w}'" for w in IGNORE) + "]"
SQL["e13_top_words"] = cte("fx_docs") + f""",
w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS word FROM fx_docs)
SELECT word, CAST(COUNT(*) AS BIGINT) AS count FROM w
WHERE NOT list_contains({_STOP}, word) AND NOT list_contains({_IGN}, word)
GROUP BY word ORDER BY count DESC, word LIMIT 200"""


def g8_encode_pad(spark, sf):
    c = _clean(spark, sf)
    voc = T.vocabulary(c, "tokens")
    e = T.encode_pad(c, "doc_id", "tokens", voc, max_len=512)
    return e.select("doc_id", "input_ids", "attention_mask")


Q["g8_encode_pad"] = g8_encode_pad
SQL["g8_encode_pad"] = cte("fx_docs") + f""",
c AS (SELECT doc_id, {_CLEAN} AS tokens FROM fx_docs),
voc AS (SELECT term, ROW_NUMBER() OVER (ORDER BY term) + 3 AS id
        FROM (SELECT DISTINCT unnest(tokens) AS term FROM c)),
ex AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM c),
per AS (SELECT ex.doc_id, list(voc.id ORDER BY ex.pos) AS ids FROM ex JOIN voc USING (term)
        WHERE ex.pos <= 510 GROUP BY ex.doc_id),
seq AS (SELECT c.doc_id, list_concat([2], COALESCE(per.ids, []), [3]) AS s FROM c LEFT JOIN per USING (doc_id))
SELECT doc_id, list_resize(s, 512, 0) AS input_ids,
       list_transform(list_resize(s, 512, 0), lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS attention_mask
FROM seq"""


def g9_max_len(spark, sf):
    c = _clean(spark, sf)
    return c.agg(F.max(F.size("tokens")).cast("long").alias("max_len"),
                 F.avg(F.size("tokens")).alias("mean_len")).select(
        "max_len", F.round("mean_len", 6).alias("mean_len"))


Q["g9_max_len"] = g9_max_len
SQL["g9_max_len"] = cte("fx_docs") + f"""
SELECT CAST(MAX(len({_CLEAN})) AS BIGINT) AS max_len, ROUND(AVG(len({_CLEAN})), 6) AS mean_len FROM fx_docs"""


def k15_sentiment(spark, sf):
    c = T.preprocess(_rev(spark, sf), "content", "tokens", stop=(), min_len=0)
    s = T.lexicon_sentiment(c, "doc_id", "tokens", LEXICON)
    return s.select("doc_id", F.round("polarity", 6).alias("polarity"),
                    F.round("subjectivity", 6).alias("subjectivity"))


Q["k15_sentiment"] = k15_sentiment
_LEX = ", ".join(f"('{w}', {p}, {s})" for w, p, s in LEXICON)
SQL["k15_sentiment"] = cte("fx_docs") + f""",
lex AS (SELECT * FROM (VALUES {_LEX}) v(word, polarity, subjectivity)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '\\p{{L}}+')) AS word FROM fx_docs),
h AS (SELECT doc_id, AVG(polarity) AS p, AVG(subjectivity) AS s FROM w JOIN lex USING (word) GROUP BY doc_id)
SELECT r.doc_id, ROUND(COALESCE(h.p, 0.0), 6) AS polarity, ROUND(COALESCE(h.s, 0.0), 6) AS subjectivity
FROM fx_docs r LEFT JOIN h USING (doc_id)"""
