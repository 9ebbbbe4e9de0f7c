"""Registered queries: experiments (E2-E6), schedules (M1-M4, D5, D6),
generic table ops (E8, F3, F5-F7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import experiment as ex
from quarry.operators import schedule as sc
from quarry.operators import tables as tb
from quarry.plans.fixtures import cte, fixture
from quarry.sources.tables import load

Q, SQL = {}, {}


def _r(c, d=6):
    return F.round(c, d).alias(c)


def e2_group_means(spark, sf):
    g = ex.group_means(fixture(spark, sf, "fx_rct"), "treatment")
    return g.select("treatment", _r("store_id"), _r("sale", 4))


Q["e2_group_means"] = e2_group_means
SQL["e2_group_means"] = cte("fx_rct") + """
SELECT treatment, ROUND(AVG(store_id), 6) AS store_id, ROUND(AVG(sale), 4) AS sale
FROM fx_rct GROUP BY treatment"""


def e3_group_shares(spark, sf):
    g = ex.group_shares(fixture(spark, sf, "fx_rct"), "treatment")
    return g.select("treatment", "n", _r("share"))


Q["e3_group_shares"] = e3_group_shares
SQL["e3_group_shares"] = cte("fx_rct") + """
SELECT treatment, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM fx_rct GROUP BY treatment"""


def e4_cluster_means(spark, sf):
    g = ex.group_means(fixture(spark, sf, "fx_rct"), ["store_id", "treatment"])
    return g.select("store_id", "treatment", _r("sale", 4))


Q["e4_cluster_means"] = e4_cluster_means
SQL["e4_cluster_means"] = cte("fx_rct") + """
SELECT store_id, treatment, ROUND(AVG(sale), 4) AS sale FROM fx_rct GROUP BY store_id, treatment"""

_ATE_COLS = ["mean_t", "mean_c", "ate", "se", "ci_low", "ci_high"]


def _ate_sql(src):
    return f"""
, a AS (SELECT AVG(CASE WHEN treatment = 1 THEN sale END) AS mean_t,
              AVG(CASE WHEN treatment = 0 THEN sale END) AS mean_c,
              VAR_SAMP(CASE WHEN treatment = 1 THEN sale END) AS var_t,
              VAR_SAMP(CASE WHEN treatment = 0 THEN sale END) AS var_c,
              COUNT(CASE WHEN treatment = 1 THEN sale END) AS n_t,
              COUNT(CASE WHEN treatment = 0 THEN sale END) AS n_c FROM {src})
SELECT CAST(n_t AS BIGINT) AS n_t, CAST(n_c AS BIGINT) AS n_c,
       ROUND(mean_t, 4) AS mean_t, ROUND(mean_c, 4) AS mean_c, ROUND(mean_t - mean_c, 4) AS ate,
       ROUND(SQRT(var_t / n_t + var_c / n_c), 4) AS se,
       ROUND(mean_t - mean_c - 1.96 * SQRT(var_t / n_t + var_c / n_c), 4) AS ci_low,
       ROUND(mean_t - mean_c + 1.96 * SQRT(var_t / n_t + var_c / n_c), 4) AS ci_high FROM a"""


def e5_ate_rows(spark, sf):
    a = ex.ate(fixture(spark, sf, "fx_rct"))
    return a.select("n_t", "n_c", *[_r(c, 4) for c in _ATE_COLS])


Q["e5_ate_rows"] = e5_ate_rows
SQL["e5_ate_rows"] = cte("fx_rct")[:-1] + _ate_sql("fx_rct")


def e5_ate_clusters(spark, sf):
    a = ex.cluster_ate(fixture(spark, sf, "fx_rct"))
    return a.select("n_t", "n_c", *[_r(c, 4) for c in _ATE_COLS])


Q["e5_ate_clusters"] = e5_ate_clusters
SQL["e5_ate_clusters"] = cte("fx_rct")[:-1] + """,
cl AS (SELECT store_id, treatment, AVG(sale) AS sale FROM fx_rct GROUP BY store_id, treatment)
""" + _ate_sql("cl")


def _itt(control):
    def q(spark, sf):
        r = ex.itt_tot(fixture(spark, sf, "fx_arms"), control=control)
        return r.select("arm", F.col("reference_arm").cast("long").alias("reference_arm"), "n",
                        *[_r(c) for c in ["outcome_rate", "take_up", "itt", "tot"]])
    return q


def _itt_sql(control):
    return cte("fx_arms") + f""",
per AS (SELECT arm, AVG(outcome) AS outcome_rate, AVG(took_up) AS take_up, COUNT(*) AS n
        FROM fx_arms GROUP BY arm),
ref AS (SELECT outcome_rate AS ro, take_up AS rt FROM per WHERE arm = {control})
SELECT arm, CAST({control} AS BIGINT) AS reference_arm, CAST(n AS BIGINT) AS n,
       ROUND(outcome_rate, 6) AS outcome_rate, ROUND(take_up, 6) AS take_up,
       ROUND(outcome_rate - ro, 6) AS itt,
       ROUND(CASE WHEN take_up - rt <> 0 THEN (outcome_rate - ro) / (take_up - rt) END, 6) AS tot
FROM per, ref WHERE arm <> {control}"""


Q["e6_itt_tot"] = _itt(0)
SQL["e6_itt_tot"] = _itt_sql(0)
Q["e6_itt_tot_arm_vs_arm"] = _itt(1)
SQL["e6_itt_tot_arm_vs_arm"] = _itt_sql(1)

_SCHED_HR = "booked_min / 60.0"


def _sched(spark, sf):
    return fixture(spark, sf, "fx_sched").withColumn("booked_hr", F.col("booked_min") / 60.0)


def m1_audit(spark, sf):
    a = sc.audit(_sched(spark, sf))
    return a.select("rule", "or_suite", "day", "hour", "encounter_id", _r("value"), "cap")


Q["m1_audit"] = m1_audit
SQL["m1_audit"] = cte("fx_sched") + f""",
s AS (SELECT *, {_SCHED_HR} AS booked_hr FROM fx_sched)
SELECT 'day_hours' AS rule, NULL::INT AS or_suite, day, NULL::BIGINT AS hour, NULL::BIGINT AS encounter_id,
       ROUND(SUM(booked_hr), 6) AS value, CAST(24.0 AS DOUBLE) AS cap FROM s GROUP BY day HAVING SUM(booked_hr) > 24
UNION ALL
SELECT 'room_one_at_a_time', or_suite, day, hour, NULL, COUNT(*), 1.0 FROM s
  GROUP BY or_suite, day, hour HAVING COUNT(*) > 1
UNION ALL
SELECT 'encounter_one_room', NULL, day, hour, encounter_id, COUNT(DISTINCT or_suite), 1.0 FROM s
  GROUP BY encounter_id, day, hour HAVING COUNT(DISTINCT or_suite) > 1
UNION ALL
SELECT 'encounter_once', NULL, NULL, NULL, encounter_id, COUNT(*), 1.0 FROM s
  GROUP BY encounter_id HAVING COUNT(*) > 1
UNION ALL
SELECT 'room_hours', or_suite, NULL, NULL, NULL, ROUND(SUM(booked_hr), 6), 56.0 FROM s
  GROUP BY or_suite HAVING SUM(booked_hr) > 56
UNION ALL
SELECT 'room_day_hours', or_suite, day, NULL, NULL, ROUND(SUM(booked_hr), 6), 8.0 FROM s
  GROUP BY or_suite, day HAVING SUM(booked_hr) > 8"""


def m2_utilisation(spark, sf):
    u = sc.utilisation(_sched(spark, sf))
    return u.select("level", "or_suite", "day", _r("hours"), "capacity", _r("utilisation"))


Q["m2_utilisation"] = m2_utilisation
SQL["m2_utilisation"] = cte("fx_sched") + f""",
s AS (SELECT *, {_SCHED_HR} AS booked_hr FROM fx_sched)
SELECT 'room' AS level, or_suite, NULL::BIGINT AS day, ROUND(SUM(booked_hr), 6) AS hours, CAST(56.0 AS DOUBLE) AS capacity,
       ROUND(SUM(booked_hr) / 56.0, 6) AS utilisation FROM s GROUP BY or_suite
UNION ALL
SELECT 'day', NULL, day, ROUND(SUM(booked_hr), 6), 24.0, ROUND(SUM(booked_hr) / 24.0, 6) FROM s GROUP BY day
UNION ALL
SELECT 'room_day', or_suite, day, ROUND(SUM(booked_hr), 6), 8.0, ROUND(SUM(booked_hr) / 8.0, 6)
FROM s GROUP BY or_suite, day"""


def m3_demand(spark, sf):
    d = sc.demand_vs_capacity(_sched(spark, sf))
    return d.select(_r("booked_hours"), "capacity", _r("ratio"))


Q["m3_demand"] = m3_demand
SQL["m3_demand"] = cte("fx_sched") + f"""
SELECT ROUND(SUM({_SCHED_HR}), 6) AS booked_hours, CAST(168.0 AS DOUBLE) AS capacity,
       ROUND(SUM({_SCHED_HR}) / 168.0, 6) AS ratio FROM fx_sched"""


def m4_report(spark, sf):
    r = sc.report(_sched(spark, sf), only_room=1, only_day=1)
    return r.select("encounter_id", "or_suite", "day", "hour", _r("booked_hr"), _r("end_time"))


Q["m4_report"] = m4_report
SQL["m4_report"] = cte("fx_sched") + f"""
SELECT encounter_id, or_suite, day, hour, ROUND({_SCHED_HR}, 6) AS booked_hr,
       ROUND(hour + {_SCHED_HR}, 6) AS end_time
FROM fx_sched WHERE or_suite = 1 AND day = 1 ORDER BY or_suite, day, hour"""


def d5_d6_lookup(spark, sf):
    s = fixture(spark, sf, "fx_sched")
    book = sc.lookup_last(s, "cpt_code", "booked_min", "encounter_id")
    enc_cpt = sc.lookup_last(s, "encounter_id", "cpt_code", "encounter_id")
    out = enc_cpt.join(book, "cpt_code", "left")
    return out.select("encounter_id", "cpt_code", "booked_min")


Q["d5_d6_lookup"] = d5_d6_lookup
SQL["d5_d6_lookup"] = cte("fx_sched") + """,
book AS (SELECT cpt_code, arg_max(booked_min, encounter_id) AS booked_min FROM fx_sched GROUP BY cpt_code),
enc AS (SELECT encounter_id, arg_max(cpt_code, encounter_id) AS cpt_code FROM fx_sched GROUP BY encounter_id)
SELECT e.encounter_id, e.cpt_code, b.booked_min FROM enc e LEFT JOIN book b ON e.cpt_code = b.cpt_code"""


def e8_sums(spark, sf):
    s = tb.sums(_sched(spark, sf), "booked_hr", ["or_suite", "day"])
    return s.select("or_suite", "day", _r("sum_booked_hr"))


Q["e8_sums"] = e8_sums
SQL["e8_sums"] = cte("fx_sched") + f"""
SELECT or_suite, day, ROUND(SUM({_SCHED_HR}), 6) AS sum_booked_hr FROM fx_sched GROUP BY or_suite, day"""


def f3_argmin(spark, sf):
    r = fixture(spark, sf, "fx_docs")
    lo = tb.arg_extreme(r, "business_id", "doc_id", "score", out="min_doc")
    hi = tb.arg_extreme(r, "business_id", "doc_id", "score", largest=True, out="max_doc")
    return lo.select("business_id", "min_doc", F.col("score").alias("min_score")).join(
        hi.select("business_id", "max_doc", F.col("score").alias("max_score")), "business_id")


Q["f3_argmin"] = f3_argmin
SQL["f3_argmin"] = cte("fx_docs") + """
SELECT business_id, arg_min(doc_id, (score, doc_id)) AS min_doc, MIN(score) AS min_score,
       arg_max(doc_id, (score, -doc_id)) AS max_doc, MAX(score) AS max_score
FROM fx_docs GROUP BY business_id"""


def f5_f6_top_n(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return tb.top_n(o.select("o_orderkey", "o_custkey", "o_totalprice"), 10,
                    F.desc("o_totalprice"), "o_orderkey")


Q["f5_f6_top_n"] = f5_f6_top_n
SQL["f5_f6_top_n"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""


def f7_union(spark, sf):
    """Business partners of both kinds under one set of columns; what a side lacks is null."""
    buyers = load(spark, sf, "customer").select(
        F.col("c_name").alias("partner"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    sellers = load(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("partner"))
    return tb.union_all(buyers, sellers)


Q["f7_union"] = f7_union
SQL["f7_union"] = """
SELECT c_name AS partner, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS partner FROM supplier"""
