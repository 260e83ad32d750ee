"""Checked queries: isotonic calibration per range.

The score is the 'logreg' probability column rounded to one decimal: a
discrete score keeps the SQL twin of isotonic regression (max-min of
count-weighted block means, cubic in the number of distinct scores) cheap,
while every attempt row still takes part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probengine.operators import calibrate as C
from probengine.operators.clean import TARGET
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, model_ready_ctes, synthetic_p_sql
from probengine.session import cut_lineage
from probengine.sources import bindings as B


def _cal_input(spark, sf):
    mr = B.model_ready(spark, sf, with_history=True)
    y = F.col(TARGET)
    # read by the range counts, one fit per range and the apply pass
    return cut_lineage(mr.select(
        "attempt_id",
        F.col("kick_distance").alias("dist"),
        (F.col("kick_distance") + F.when(F.col("vegas_wp_effective") > 0.9, F.lit(0.5))
         .otherwise(F.lit(0.0))).alias("dist_c3"),
        B.synthetic_p("logreg", F.col("attempt_id"), y).alias("x"),
        y.alias("y")))


_INPUT = f"""WITH {model_ready_ctes(True)},
ci AS (SELECT attempt_id, kick_distance AS dist,
         kick_distance + CASE WHEN vegas_wp_effective > {D(0.9)} THEN {D(0.5)} ELSE {D(0)} END AS dist_c3,
         {synthetic_p_sql("'logreg'", 'attempt_id', 'field_goal_result_binary')} AS x,
         field_goal_result_binary AS y FROM mr)"""


def isotonic_fit_sql(pre: str, src: str) -> str:
    """Isotonic fit per key on a source with columns (key, x, y):
    fit(x_i) = max over a <= i of min over b >= i of mean(y[a..b]) on the
    distinct scores, with count weights."""
    return f"""
{pre}_pts AS (SELECT key, x, count(*) AS c, sum(y) AS s FROM {src} GROUP BY key, x),
{pre}_ord AS (SELECT key, x, c, s, row_number() OVER w AS i,
    sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS cc, sum(s) OVER (w ROWS UNBOUNDED PRECEDING) AS cs
  FROM {pre}_pts WINDOW w AS (PARTITION BY key ORDER BY x)),
{pre}_pairs AS (SELECT a.key, a.i AS ai, b.i AS bi,
    CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cc - a.cc + a.c AS DOUBLE) AS m
  FROM {pre}_ord a JOIN {pre}_ord b ON a.key = b.key AND a.i <= b.i),
{pre}_mins AS (SELECT key, ai, bi, min(m) OVER (PARTITION BY key, ai ORDER BY bi DESC ROWS UNBOUNDED PRECEDING) AS mn FROM {pre}_pairs),
{pre}_fit AS (SELECT o.key, o.x, max(m.mn) AS fitted FROM {pre}_mins m
  JOIN {pre}_ord o ON m.key = o.key AND m.bi = o.i GROUP BY o.key, o.x)"""


_HALF_OPEN_KEY = " ".join(f"WHEN dist >= {lo} AND dist < {hi} THEN '[{lo},{hi})'"
                          for lo, hi in C.HALF_OPEN_RANGES)
_INCL_KEY = " ".join(f"WHEN dist_c3 >= {lo} AND dist_c3 <= {hi} THEN '{lab}'"
                     for lo, hi, lab in C.INCLUSIVE_BUCKETS)


# -- C1 + C2: half-open ranges, fitted when n > 50, else p unchanged ----------
@register("c1_c2_isotonic_by_range", rsql(f"""{_INPUT},
k AS (SELECT attempt_id, x, y, CASE {_HALF_OPEN_KEY} END AS key FROM ci),
fk AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > {C.HALF_OPEN_MIN_N}),
src AS (SELECT k.key, k.x, k.y FROM k JOIN fk ON k.key = fk.key),{isotonic_fit_sql('h', 'src')}
SELECT k.attempt_id, CASE WHEN fk.key IS NOT NULL THEN h_fit.fitted ELSE k.x END AS p_cal
FROM k LEFT JOIN fk ON k.key = fk.key LEFT JOIN h_fit ON k.key = h_fit.key AND k.x = h_fit.x""",
                                           ["p_cal"]))
def c1_c2(spark, sf):
    df = _cal_input(spark, sf)
    cal = C.fit_half_open(df, "dist", "x", "y")
    return round_doubles(C.apply_half_open(df, cal, "dist", "x", "p_cal").select("attempt_id", "p_cal"))


# -- C3 + C4: inclusive buckets (n >= 30) with a global fallback --------------
@register("c3_c4_isotonic_inclusive_global", rsql(f"""{_INPUT},
k AS (SELECT attempt_id, x, y, CASE {_INCL_KEY} END AS fit_key,
        coalesce(CASE {_INCL_KEY} END, '{C.INCLUSIVE_FALLTHROUGH}') AS apply_key FROM ci),
fk AS (SELECT fit_key AS key FROM k WHERE fit_key IS NOT NULL GROUP BY fit_key HAVING count(*) >= {C.INCLUSIVE_MIN_N}),
src AS (SELECT k.fit_key AS key, k.x, k.y FROM k JOIN fk ON k.fit_key = fk.key
        UNION ALL SELECT 'global' AS key, x, y FROM k),{isotonic_fit_sql('b', 'src')},
ak AS (SELECT k.attempt_id, k.x, CASE WHEN fk.key IS NOT NULL THEN k.apply_key ELSE 'global' END AS key
       FROM k LEFT JOIN fk ON k.apply_key = fk.key),
below AS (SELECT ak.*, f.x AS x0, f.fitted AS f0 FROM ak ASOF LEFT JOIN b_fit f ON ak.key = f.key AND ak.x >= f.x),
near AS (SELECT b.*, f.x AS x1, f.fitted AS f1 FROM below b ASOF LEFT JOIN b_fit f ON b.key = f.key AND b.x <= f.x)
SELECT attempt_id, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL OR x0 = x1 THEN f0
  ELSE f0 + (x - x0) * (f1 - f0) / (x1 - x0) END AS p_cal FROM near""",
                                                   ["p_cal"]))
def c3_c4(spark, sf):
    df = _cal_input(spark, sf)
    cal = C.fit_inclusive(df, "dist_c3", "x", "y")
    return round_doubles(C.apply_inclusive(df, cal, "dist_c3", "x", "p_cal").select("attempt_id", "p_cal"))


# -- C5: one global calibrator ------------------------------------------------
@register("c5_global_isotonic", rsql(f"""{_INPUT},
src AS (SELECT 'global' AS key, x, y FROM ci),{isotonic_fit_sql('g', 'src')}
SELECT ci.attempt_id, g_fit.fitted AS p_cal FROM ci LEFT JOIN g_fit ON g_fit.key = 'global' AND ci.x = g_fit.x""",
                                     ["p_cal"]))
def c5_global(spark, sf):
    df = _cal_input(spark, sf)
    cal = C.fit_global(df, "x", "y")
    return round_doubles(C.apply_global(df, cal, "x", "p_cal").select("attempt_id", "p_cal"))
