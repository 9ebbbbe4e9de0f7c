"""Derived fixtures: SQL that runs unchanged on Spark SQL and DuckDB.

A Spark query builds its input with :func:`fixture`; the DuckDB oracle for
the same query embeds the identical text as a CTE via :func:`cte`.  All
fixtures read whole tables (no row subsets).
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import load

FX = {
    # event log; 'error' opens, 'purchase' resolves, the rest is noise
    "fx_log": """
SELECT user_id AS document,
       CASE WHEN event_id % 7 = 0 THEN 'TableB' ELSE 'TableA' END AS table_name,
       CASE WHEN event_type IN ('error','purchase') THEN 'TargetEvent' ELSE 'Other' END AS field_name,
       CASE WHEN event_type = 'purchase' THEN 'open' WHEN event_id % 3 = 0 THEN '' END AS old_value,
       CASE WHEN event_type = 'error' THEN 'open' WHEN event_id % 2 = 0 THEN '' END AS new_value,
       ts AS change_date
FROM events""",
    # main entity table
    "fx_main": """
SELECT c_custkey AS id, c_mktsegment AS category_a, CAST(c_nationkey AS STRING) AS category_b,
       c_acctbal AS numeric_feature,
       'code' || CAST(1 + c_custkey % 3 AS STRING) AS operation_code,
       CASE WHEN c_custkey % 10 = 0 THEN 'Inactive' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'Active' END AS status,
       DATE '2021-12-01' + CAST(c_custkey % 60 AS INT) AS record_date
FROM customer""",
    # one row per id for the inner join
    "fx_aux": """
SELECT o_custkey AS id, COUNT(*) AS additional_column FROM orders GROUP BY o_custkey""",
    # cluster-randomised trial, store = supplier
    "fx_rct": """
SELECT l_suppkey AS store_id, l_suppkey % 2 AS treatment, l_extendedprice AS sale FROM lineitem""",
    # three-arm trial with take-up
    "fx_arms": """
SELECT c_custkey AS unit_id, c_custkey % 3 AS arm,
       CASE WHEN c_custkey % 5 < 2 * (c_custkey % 3) THEN 1 ELSE 0 END AS took_up,
       CASE WHEN c_acctbal > 3000 THEN 1 ELSE 0 END AS outcome
FROM customer""",
    # reviews; business = source, stars 1-5, label where known
    "fx_rev": """
SELECT d.doc_id, d.text AS content, d.source AS business_id, 1 + d.doc_id % 5 AS score, l.quality AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # reviews without the label join, for text queries that never read the
    # label (labels.doc_id is unique, so rows are the same as fx_rev's)
    "fx_docs": """
SELECT d.doc_id, d.text AS content, d.source AS business_id, 1 + d.doc_id % 5 AS score
FROM documents d""",
    # passenger-like rows with nulls, composite strings, groups of 3 and 1
    "fx_pax": """
SELECT c_custkey AS row_id,
       LPAD(CAST(CASE WHEN c_custkey % 4 = 3 THEN 500000 + c_custkey
                      ELSE CAST((c_custkey - c_custkey % 4) / 4 AS BIGINT) END AS STRING), 6, '0')
         || '_0' || CAST(1 + c_custkey % 4 AS STRING) AS passenger_id,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS home_planet,
       CASE WHEN c_custkey % 13 = 0 THEN NULL
            ELSE SUBSTR('ABCDEFG', CAST(1 + c_custkey % 7 AS INT), 1) || '/' || CAST(c_custkey % 1800 AS STRING)
                 || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'S' END END AS cabin,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(1 + c_custkey % 79 AS DOUBLE) END AS age,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE ABS(c_acctbal) END AS room_service,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(c_custkey % 500 AS DOUBLE) END AS spa,
       CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE LOWER(c_mktsegment) || '  ' || c_name END AS name,
       CASE WHEN c_custkey % 37 = 0 THEN 'n/a' ELSE CAST(c_custkey % 90 AS STRING) END AS raw_number,
       CAST(NULL AS STRING) AS all_null,
       c_acctbal > 4000 AS transported
FROM customer""",
    # unique key, four numeric features, binary label
    "fx_num": """
SELECT o_orderkey AS row_id, o_totalprice AS x1, CAST(o_custkey AS DOUBLE) AS x2,
       CAST(o_orderkey % 97 AS DOUBLE) AS x3, CAST((o_orderkey * 31) % 53 AS DOUBLE) AS x4,
       CASE WHEN o_totalprice + 1000.0E0 * (o_orderkey % 97) > 200000.0E0 THEN 1 ELSE 0 END AS label
FROM orders""",
    # vectors for kNN, SMOTE, clustering, PCA
    "fx_vec": """
SELECT vec_id, embedding, label, CASE WHEN label = 0 THEN 1 ELSE 0 END AS minority FROM embeddings""",
    # label, tied scores, three voters
    "fx_pred": """
SELECT doc_id AS id, quality AS label,
       CAST((doc_id * 7919) % 100 AS DOUBLE) / 100 AS score,
       CASE WHEN (doc_id * 7919) % 100 >= 50 THEN 1 ELSE 0 END AS prediction,
       CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS vote1,
       CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS vote2,
       CASE WHEN doc_id % 5 < 3 THEN 1 ELSE 0 END AS vote3
FROM labels""",
    # schedule rows over the whole orders table (collisions on purpose so the
    # audit finds violations)
    "fx_sched": """
SELECT o_orderkey AS encounter_id, 1 + o_custkey % 3 AS or_suite, 1 + o_orderkey % 7 AS day,
       8 + (o_orderkey * 13) % 9 AS hour, o_custkey % 32 AS cpt_code,
       CAST(30 + 15 * ((o_custkey % 32) % 4) AS DOUBLE) AS booked_min
FROM orders""",
}

_TABLE_RE = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.IGNORECASE)


def tables_of(sql: str) -> list[str]:
    return sorted({m for m in _TABLE_RE.findall(sql)})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture DataFrame over the tables in ``sf_dir``.

    The shared SQL text is run with its tables passed as DataFrame arguments
    (``spark.sql("... FROM {customer}", customer=df)``), so no temp view is
    created or replaced in the caller's session."""
    sql = FX[name]
    names = tables_of(sql)
    templ = _TABLE_RE.sub(lambda m: m.group(0).replace(m.group(1), "{" + m.group(1) + "}"), sql)
    return spark.sql(templ, **{n: load(spark, sf_dir, n) for n in names})


def cte(*names: str) -> str:
    """``WITH`` clause for DuckDB oracles that defines the given fixtures."""
    return "WITH " + ",\n".join(f"{n} AS ({FX[n]}\n)" for n in names) + "\n"
