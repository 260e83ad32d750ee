"""Checked queries: aggregates, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from probengine.operators import metrics as M
from probengine.operators import profile as PR
from probengine.operators.folds import balanced_weights, positive_class_weight
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, PREDS, linspace_bin_sql, metrics_sql, model_ready_ctes
from probengine.sources import bindings as B


def _mr(spark, sf):
    return B.model_ready(spark, sf, with_history=True)


# -- A1-A3: global count / mean / sample std / min / max, flag rate -----------
@register("a1_a3_global_stats", rsql("""
SELECT count(*) AS n,
  avg(l_quantity) AS l_quantity_mean, stddev_samp(l_quantity) AS l_quantity_std,
  min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  avg(l_extendedprice) AS l_extendedprice_mean, stddev_samp(l_extendedprice) AS l_extendedprice_std,
  min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
  avg(CAST(l_returnflag = 'R' AS INTEGER)) AS rate,
  CAST(sum(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS total
FROM lineitem""", ["l_quantity_mean", "l_quantity_std", "l_quantity_min", "l_quantity_max",
                   "l_extendedprice_mean", "l_extendedprice_std", "l_extendedprice_min",
                   "l_extendedprice_max", "rate"]))
def a1_stats(spark, sf):
    li = B.table(spark, sf, "lineitem").withColumn(
        "is_r", (F.col("l_returnflag") == "R").cast("int"))
    # one pass: the A2 moments and the A3 flag rate in the same aggregate
    st = li.agg(*PR.global_stats_aggs(["l_quantity", "l_extendedprice"]),
                *PR.flag_rate_aggs("is_r"))
    return round_doubles(st)


# -- A4: value counts including NULL with % of all rows -----------------------
@register("a4_value_counts", rsql("""
WITH r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'closed'
       WHEN '3-MEDIUM' THEN 'outdoors' WHEN '4-NOT SPECIFIED' THEN 'open' END AS roof FROM orders),
c AS (SELECT roof, count(*) AS count FROM r GROUP BY roof)
SELECT roof, count, count * CAST(100 AS DOUBLE) / sum(count) OVER () AS pct FROM c""", ["pct"]))
def a4_counts(spark, sf):
    o = B.table(spark, sf, "orders").select(
        B._case(F.col("o_orderpriority"), B.ROOF_BY_PRIORITY).alias("roof"))
    return round_doubles(PR.value_counts(o, "roof"))


# -- A5: distinct counts ------------------------------------------------------
@register("a5_distinct_counts", """
SELECT count(DISTINCT l_partkey) AS l_partkey_nunique, count(DISTINCT l_suppkey) AS l_suppkey_nunique,
  count(DISTINCT l_orderkey) AS l_orderkey_nunique FROM lineitem""")
def a5_distinct(spark, sf):
    return PR.distinct_count(B.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"])


# -- A6 + A7: right-closed distance buckets, % of all rows, make rate ---------
@register("a6_a7_distance_buckets", rsql(f"""WITH {model_ready_ctes(True)},
b AS (SELECT CASE WHEN kick_distance > 0 AND kick_distance <= 29 THEN '0–29'
                  WHEN kick_distance > 29 AND kick_distance <= 39 THEN '30–39'
                  WHEN kick_distance > 39 AND kick_distance <= 49 THEN '40–49'
                  WHEN kick_distance > 49 AND kick_distance <= 100 THEN '50+' END AS bucket,
             field_goal_result_binary AS y FROM mr),
a AS (SELECT bucket, count(*) AS count, avg(CAST(y AS DOUBLE)) AS rate FROM b GROUP BY bucket),
lab(ord, bucket) AS (VALUES (0, '0–29'), (1, '30–39'), (2, '40–49'), (3, '50+'))
SELECT lab.ord, lab.bucket, CAST(coalesce(a.count, 0) AS BIGINT) AS count,
  coalesce(a.count, 0) * CAST(100 AS DOUBLE) / (SELECT sum(count) FROM a) AS pct, a.rate
FROM lab LEFT JOIN a ON lab.bucket = a.bucket""", ["pct", "rate"]))
def a6_buckets(spark, sf):
    return round_doubles(PR.bucket_profile(_mr(spark, sf), "kick_distance",
                                           "field_goal_result_binary", spark))


# -- A8: fixed-width histogram, last bin closed, empty bins listed ------------
@register("a8_unit_histogram", """
WITH b AS (SELECT CASE WHEN l_quantity >= 10 AND l_quantity < 79 THEN CAST(floor(l_quantity) AS INTEGER)
                       WHEN l_quantity = 79 THEN 78 END AS bin FROM lineitem),
a AS (SELECT bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY bin),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10, 79))
SELECT bins.bin, CAST(coalesce(a.count, 0) AS BIGINT) AS count FROM bins LEFT JOIN a ON bins.bin = a.bin""")
def a8_hist(spark, sf):
    return PR.unit_histogram(B.table(spark, sf, "lineitem"), "l_quantity", spark)


# -- A9: grouped miss rate and count ------------------------------------------
@register("a9_grouped_miss_rate", rsql(f"""WITH {model_ready_ctes(True)}
SELECT season, avg(CAST(1 - field_goal_result_binary AS DOUBLE)) AS mean, count(*) AS count
FROM mr GROUP BY season""", ["mean"]))
def a9_rate(spark, sf):
    df = _mr(spark, sf).withColumn("miss", 1 - F.col("field_goal_result_binary"))
    return round_doubles(PR.grouped_rate(df, "season", "miss"))


# -- E8 (A10 + A11): probability profile by true class ------------------------
@register("e8_class_profile", rsql(f"""WITH {PREDS}
SELECT model, y, count(*) AS count, avg(p_make) AS mean, stddev_pop(p_make) AS std,
  min(p_make) AS min, quantile_cont(p_make, 0.1) AS p10, quantile_cont(p_make, 0.25) AS p25,
  quantile_cont(p_make, 0.5) AS p50, quantile_cont(p_make, 0.75) AS p75,
  quantile_cont(p_make, 0.9) AS p90, max(p_make) AS max
FROM preds GROUP BY model, y""", ["mean", "std", "min", "p10", "p25", "p50", "p75", "p90", "max"]))
def e8_profile(spark, sf):
    return round_doubles(PR.class_profile(B.prediction_table(spark, sf), "p_make", "y", ["model"]))


# -- A12 / E9: share of misses below each threshold ---------------------------
@register("e9_miss_threshold_fractions", rsql(f"""WITH {PREDS},
t(threshold) AS (VALUES (CAST(0.6 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE)))
SELECT p.model, t.threshold, avg(CASE WHEN p.p_make < t.threshold THEN {D(1)} ELSE {D(0)} END) AS frac
FROM preds p CROSS JOIN t WHERE p.y = 0 GROUP BY p.model, t.threshold""", ["threshold", "frac"]))
def e9_thresholds(spark, sf):
    return round_doubles(M.miss_threshold_fractions(B.prediction_table(spark, sf), "p_make", "y",
                                                    ["model"]))


# -- A13 + A14: balanced class weights and the positive-class weight ----------
@register("a13_a14_class_weights", rsql(f"""WITH {model_ready_ctes(True)},
c AS (SELECT field_goal_result_binary AS y, count(*) AS nc FROM mr GROUP BY 1),
w AS (SELECT y, (SELECT sum(nc) FROM c) / (CAST(2 AS DOUBLE) * nc) AS w_balanced FROM c),
pw AS (SELECT greatest({D(1)}, sum(CASE WHEN field_goal_result_binary = 0 THEN 1 ELSE 0 END)
          / greatest(1, sum(CASE WHEN field_goal_result_binary = 1 THEN 1 ELSE 0 END))) AS pos_weight FROM mr)
SELECT mr.season, w.y, CAST(count(*) AS BIGINT) AS n, sum(w.w_balanced) AS sum_w, max(pw.pos_weight) AS pos_weight
FROM mr JOIN w ON mr.field_goal_result_binary = w.y CROSS JOIN pw GROUP BY mr.season, w.y""",
                                        ["sum_w", "pos_weight"]))
def a13_weights(spark, sf):
    mr = _mr(spark, sf).withColumnRenamed("field_goal_result_binary", "y")
    bw = balanced_weights(mr, "y")
    pw = positive_class_weight(mr, "y").withColumn("_k", F.lit(0))
    out = (bw.groupBy("season", "y").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum("w_balanced").alias("sum_w"))
           .withColumn("_k", F.lit(0)).join(F.broadcast(pw), "_k").drop("_k"))
    return round_doubles(out)


# -- E1-E6: the all-in-one metric record per model ----------------------------
@register("e6_metrics_by_model", rsql(f"""WITH {PREDS},{metrics_sql('preds', 'p_make', 'y', 'model')}
SELECT * FROM met""", ["brier", "auc", "pr_miss", "ece10"]))
def e6_metrics(spark, sf):
    return round_doubles(M.metrics(B.prediction_table(spark, sf), "p_make", "y", ["model"]))


# -- E7: reliability table ----------------------------------------------------
@register("e7_reliability", rsql(f"""WITH {PREDS},
b AS (SELECT model, {linspace_bin_sql('p_make', 10, False)} AS bin, p_make, y FROM preds)
SELECT model, bin, count(*) AS n, avg(p_make) AS mean_p, avg(CAST(y AS DOUBLE)) AS mean_y
FROM b WHERE bin IS NOT NULL GROUP BY model, bin""", ["mean_p", "mean_y"]))
def e7_reliability(spark, sf):
    return round_doubles(M.reliability(B.prediction_table(spark, sf), "p_make", "y", ["model"]))


# -- E10: probability histogram by true class (100 bins, last closed) ---------
@register("e10_probability_histogram", f"""WITH {PREDS},
b AS (SELECT model, y, {linspace_bin_sql('p_make', 100, True)} AS bin FROM preds)
SELECT model, y, bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY model, y, bin""")
def e10_hist(spark, sf):
    return PR.probability_histogram(B.prediction_table(spark, sf), "p_make", "y", ["model"])


# -- E11 + W5: normal-approximation curves, peak-normalised -------------------
@register("e11_normal_curves", rsql(f"""WITH {PREDS},
mo AS (SELECT model, y, avg(p_make) AS mean, stddev_pop(p_make) AS std FROM preds GROUP BY model, y),
pts AS (SELECT CAST(range AS INTEGER) AS i,
          CASE WHEN range = 499 THEN {D(1)} ELSE range * {D(1.0 / 499)} END AS x FROM range(500)),
c AS (SELECT mo.model, mo.y, pts.i, pts.x,
        {D(1)} / (greatest(mo.std, {D(1e-6)}) * sqrt({D(2.0 * 3.141592653589793)}))
        * exp({D(-0.5)} * power((pts.x - mo.mean) / greatest(mo.std, {D(1e-6)}), 2)) AS density
      FROM mo CROSS JOIN pts)
SELECT model, y, i, x, CASE WHEN max(density) OVER (PARTITION BY model) > 0
  THEN density / max(density) OVER (PARTITION BY model) ELSE density END AS density_norm FROM c""",
                                    ["x", "density_norm"]))
def e11_curves(spark, sf):
    pt = B.prediction_table(spark, sf)
    mo = pt.groupBy("model", "y").agg(F.avg("p_make").alias("mean"),
                                      F.stddev_pop("p_make").alias("std"))
    return round_doubles(PR.normal_curves(mo, ["model"], "y", spark))


# -- A4 + A7 over several dimensions: one GROUPING SETS pass ------------------
_DIMS = ["roof_binary", "surface_binary", "season_type_binary", "is_rain", "is_snow",
         "is_4th_qtr", "buzzer_beater_binary"]


@register("a4_a7_dimension_profile", rsql(f"""WITH {model_ready_ctes(True)},
g AS (SELECT {", ".join(_DIMS)}, GROUPING_ID({", ".join(_DIMS)}) AS gid, count(*) AS count,
        avg(CAST(field_goal_result_binary AS DOUBLE)) AS rate
      FROM mr GROUP BY GROUPING SETS ({", ".join(f"({d})" for d in _DIMS)}))
SELECT CASE {" ".join(f"WHEN gid = {(1 << len(_DIMS)) - 1 - (1 << (len(_DIMS) - 1 - i))} THEN '{d}'" for i, d in enumerate(_DIMS))} END AS dimension,
  CASE {" ".join(f"WHEN gid = {(1 << len(_DIMS)) - 1 - (1 << (len(_DIMS) - 1 - i))} THEN CAST({d} AS VARCHAR)" for i, d in enumerate(_DIMS))} END AS value,
  count, count * CAST(100 AS DOUBLE) / (SELECT count(*) FROM mr) AS pct, rate
FROM g""", ["pct", "rate"]))
def a4_a7_dims(spark, sf):
    return round_doubles(PR.dimension_profile(_mr(spark, sf), _DIMS, "field_goal_result_binary"))
