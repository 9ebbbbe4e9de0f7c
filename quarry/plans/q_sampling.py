"""Registered queries: splits, folds, samples."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import sampling as S
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}


def _h(k, salt=""):
    inner = f"'{salt}' || CAST({k} AS VARCHAR)" if salt else f"CAST({k} AS VARCHAR)"
    return f"('0x' || substr(md5({inner}), 1, 8))::BIGINT"


def h1_hash_split(spark, sf):
    return S.assign_split(fixture(spark, sf, "fx_num"), "row_id", [0.8, 0.2], salt="s42").select(
        "row_id", "split")


Q["h1_hash_split"] = h1_hash_split
SQL["h1_hash_split"] = cte("fx_num") + f"""
SELECT row_id, CASE WHEN {_h('row_id', 's42')} / 4294967296.0 < 0.8 THEN 0 ELSE 1 END AS split FROM fx_num"""


def h2_holdout(spark, sf):
    return S.holdout(fixture(spark, sf, "fx_num"), "row_id", 0.3).select("row_id", "is_test")


Q["h2_holdout"] = h2_holdout
SQL["h2_holdout"] = cte("fx_num") + f"""
SELECT row_id, CASE WHEN ROW_NUMBER() OVER (ORDER BY {_h('row_id')}, row_id)
                         <= CEIL(COUNT(*) OVER () * 0.3) THEN 1 ELSE 0 END AS is_test FROM fx_num"""


def h3_stratified(spark, sf):
    l = spark.read.parquet(f"{sf}/labels.parquet")
    return S.holdout(l, "doc_id", 0.2, by="quality").select("doc_id", "quality", "is_test")


Q["h3_stratified"] = h3_stratified
SQL["h3_stratified"] = f"""
SELECT doc_id, quality,
       CASE WHEN ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id)
                 <= CEIL(COUNT(*) OVER (PARTITION BY quality) * 0.2) THEN 1 ELSE 0 END AS is_test
FROM labels"""


def h3_three_way(spark, sf):
    """Two stages, each a fifth: test, then validation rows of the rest, labels spread evenly."""
    l = spark.read.parquet(f"{sf}/labels.parquet")
    return S.three_way(l, "doc_id", 0.2, 0.2, by="quality").select("doc_id", "quality", "part")


Q["h3_three_way"] = h3_three_way
SQL["h3_three_way"] = f"""
SELECT doc_id, quality, CASE WHEN r <= t THEN 'test' WHEN r <= t + CEIL((n - t) * 0.2) THEN 'valid' ELSE 'train' END AS part
FROM (SELECT *, CEIL(n * 0.2) AS t FROM (
  SELECT doc_id, quality, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id) AS r,
         COUNT(*) OVER (PARTITION BY quality) AS n FROM labels))"""


def h4_sample(spark, sf):
    return S.sample_frac(fixture(spark, sf, "fx_sched"), "encounter_id", 0.15).select(
        "encounter_id", "or_suite", "day")


Q["h4_sample"] = h4_sample
SQL["h4_sample"] = cte("fx_sched") + f"""
SELECT encounter_id, or_suite, day FROM fx_sched
QUALIFY ROW_NUMBER() OVER (ORDER BY {_h('encounter_id')}, encounter_id) <= ROUND(COUNT(*) OVER () * 0.15)"""


def h5_kfold(spark, sf):
    l = spark.read.parquet(f"{sf}/labels.parquet")
    return S.kfold(l, "doc_id", 5, by="quality").select("doc_id", "quality", "fold")


Q["h5_kfold"] = h5_kfold
SQL["h5_kfold"] = f"""
SELECT doc_id, quality,
       CAST((ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id) - 1) % 5 AS INT) AS fold
FROM labels"""


def h7_undersample(spark, sf):
    v = fixture(spark, sf, "fx_vec")
    return S.undersample(v, "vec_id", "minority", 1, 0.8).select("vec_id", "minority")


Q["h7_undersample"] = h7_undersample
SQL["h7_undersample"] = cte("fx_vec") + f""",
m AS (SELECT COUNT(*) AS n_min FROM fx_vec WHERE minority = 1)
SELECT vec_id, minority FROM fx_vec WHERE minority = 1
UNION ALL
SELECT vec_id, minority FROM (
  SELECT vec_id, minority, ROW_NUMBER() OVER (ORDER BY {_h('vec_id')}, vec_id) AS rn FROM fx_vec WHERE minority <> 1
) x, m WHERE rn <= CAST(FLOOR(n_min / 0.8) AS BIGINT)"""


def f4_block_folds(spark, sf):
    return S.block_folds(fixture(spark, sf, "fx_num"), "row_id", 5).select("row_id", "fold")


Q["f4_block_folds"] = f4_block_folds
SQL["f4_block_folds"] = cte("fx_num") + """
SELECT row_id, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY row_id) - 1) * 5 / COUNT(*) OVER ()) AS INT) AS fold
FROM fx_num"""
