"""Checked queries: sources, projection/filter/expressions, lookups, history
(S1, S3, P1-P20, J1-J3, W1-W3, O1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probengine.functions.columns import (
    contains_flag,
    lenient_double,
    normalise_text,
    recode,
    rlike_flag,
)
from probengine.operators import clean
from probengine.operators.history import career_to_date
from probengine.operators.split import holdout_split
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, PREDS, RAW, model_ready_ctes
from probengine.sources import bindings as B
from probengine.sources.readers import read_table

_MR_COLS = ("attempt_id, season, kicker_player_name, score_differential, kick_distance, temp, wind, "
            "vegas_wp_effective, altitude, career_attempts, career_fg_pct, season_type_binary, "
            "roof_binary, surface_binary, is_rain, is_snow, is_4th_qtr, buzzer_beater_binary, "
            "field_goal_result_binary")
_MR_DOUBLES = ["score_differential", "kick_distance", "temp", "wind", "vegas_wp_effective",
               "career_attempts", "career_fg_pct"]


# -- S1 / P1 / P3: scan, projection, equality filter pushed to Parquet -------
@register("s1_p1_p3_scan_project_filter", rsql("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice
FROM lineitem WHERE l_returnflag = 'R'""", ["l_quantity", "l_extendedprice"]))
def s1_scan(spark, sf):
    df = B.table(spark, sf, "lineitem")
    df = clean.where_equal(df, "l_returnflag", "R")
    return round_doubles(clean.project(df, ["l_orderkey", "l_linenumber", "l_partkey",
                                            "l_quantity", "l_extendedprice"]))


# -- S3: prefer-Parquet source with CSV fallback ------------------------------
@register("s3_read_table_orders", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS sum_custkey
FROM orders GROUP BY o_orderstatus""")
def s3_read_table(spark, sf):
    df = read_table(spark, f"{sf}/orders")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum("o_custkey").alias("sum_custkey"))


# -- Entry point A: model-ready table (P2 P4 P7-P12 P15 P16 J1-J3 W1-W3) -----
@register("p_model_ready", rsql(f"WITH {model_ready_ctes(True)}\nSELECT {_MR_COLS} FROM mr",
                                _MR_DOUBLES))
def p_model_ready(spark, sf):
    return round_doubles(B.model_ready(spark, sf, with_history=True))


# -- W1-W3 without prior history, plus the exclusive makes (O1 order) --------
@register("w1_w3_career_to_date", rsql(f"""WITH {model_ready_ctes(False)}
SELECT attempt_id, kicker_player_id, game_date, career_attempts, career_makes, career_fg_pct
FROM mr""", ["career_attempts", "career_makes", "career_fg_pct"]))
def w_career(spark, sf):
    raw = B.raw_attempts(spark, sf)
    df = clean.where_not_equal_keep_null(raw, "field_goal_result", clean.BLOCKED)
    df = df.withColumn("y", (F.col("field_goal_result") == "made").cast("int"))
    out = career_to_date(df, "kicker_player_id", "game_date", ["play_id"], "y")
    return round_doubles(out.select("attempt_id", "kicker_player_id", "game_date",
                                    "career_attempts", "career_makes", "career_fg_pct"))


# -- P4: the null-keeping inequality filter, on a column that has NULLs ------
@register("p4_not_equal_keeps_null", """
WITH r AS (SELECT o_orderkey AS attempt_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'closed'
       WHEN '3-MEDIUM' THEN 'outdoors' WHEN '4-NOT SPECIFIED' THEN 'open' END AS roof
  FROM orders)
SELECT attempt_id, roof FROM r WHERE roof IS DISTINCT FROM 'dome'""")
def p4_filter(spark, sf):
    raw = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("attempt_id"),
        B._case(F.col("o_orderpriority"), B.ROOF_BY_PRIORITY).alias("roof"))
    return clean.where_not_equal_keep_null(raw, "roof", "dome")


# -- P5: temporal holdout split (latest season = test) ------------------------
@register("p5_holdout_split", """
WITH s AS (SELECT o_orderkey AS attempt_id, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders)
SELECT attempt_id, season,
  CASE WHEN season = (SELECT max(season) FROM s) THEN 'test' ELSE 'train' END AS split
FROM s""")
def p5_split(spark, sf):
    df = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"),
                                             F.year("o_orderdate").alias("season"))
    return holdout_split(df, "season").select("attempt_id", "season", "split")


# -- P6: drop rows with a NULL in any listed column ---------------------------
@register("p6_drop_null_rows", rsql(f"""WITH {RAW}
SELECT attempt_id, temp, wind, roof FROM raw
WHERE temp IS NOT NULL AND wind IS NOT NULL AND roof IS NOT NULL""", ["temp", "wind"]))
def p6_dropna(spark, sf):
    raw = B.raw_attempts(spark, sf).select("attempt_id", "temp", "wind", "roof")
    return round_doubles(clean.drop_null_rows(raw, ["temp", "wind", "roof"]))


# -- P7: per-column null fill -------------------------------------------------
@register("p7_fill_nulls", rsql(f"""WITH {RAW}
SELECT attempt_id, coalesce(temp, {D(68)}) AS temp, coalesce(wind, {D(0)}) AS wind,
  coalesce(weather, 'Unknown') AS weather FROM raw""", ["temp", "wind"]))
def p7_fill(spark, sf):
    raw = B.raw_attempts(spark, sf).select("attempt_id", "temp", "wind", "weather")
    return round_doubles(clean.fill_nulls(raw, clean.NULL_FILLS))


# -- P11-P14: text normalise, recode, substring and regex flags (part) --------
@register("p11_p14_text_ops", """
SELECT p_partkey,
  lower(regexp_replace(p_name, '^\\s+|\\s+$', '', 'g')) AS name_norm,
  CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'PROMO' THEN 'budget' WHEN 'LARGE' THEN 'big'
       ELSE p_type END AS type_recoded,
  CAST(coalesce(contains(lower(p_name), 'red'), false) AS INTEGER) AS is_red,
  CAST(coalesce(regexp_matches(lower(p_name), 'hot|cold|blizzard'), false) AS INTEGER) AS is_temp_word
FROM part""")
def p11_text(spark, sf):
    part = B.table(spark, sf, "part")
    name = normalise_text("p_name")
    return part.select(
        "p_partkey", name.alias("name_norm"),
        recode("p_type", {"ECONOMY": "budget", "PROMO": "budget", "LARGE": "big"}).alias("type_recoded"),
        contains_flag(F.lower("p_name"), "red").alias("is_red"),
        rlike_flag(F.lower("p_name"), "hot|cold|blizzard").alias("is_temp_word"))


# -- P17-P19: zero-safe ratio, clip, safe probability (all-or-nothing 0.5) ----
@register("p17_p19_probability_guards", rsql(f"""WITH {PREDS},
g AS (SELECT attempt_id, model, y,
  CASE WHEN model = 'gam' AND y = 1 AND p_make > {D(0.985)} THEN 'NaN'::DOUBLE
       ELSE (p_make - {D(0.01)}) / {D(0.98)} END AS p_raw FROM preds),
bad AS (SELECT model, bool_or(p_raw IS NULL OR isnan(p_raw) OR abs(p_raw) = 'Infinity'::DOUBLE) AS any_bad
        FROM g GROUP BY model)
SELECT g.attempt_id, g.model,
  CASE WHEN b.any_bad THEN {D(0.5)} ELSE greatest(least(g.p_raw, {D(1 - 1e-6)}), {D(1e-6)}) END AS p_safe,
  CAST(g.y AS DOUBLE) / CASE WHEN CAST(g.attempt_id % 3 AS DOUBLE) = 0 THEN {D(1)}
       ELSE CAST(g.attempt_id % 3 AS DOUBLE) END AS ratio
FROM g JOIN bad b ON g.model = b.model""", ["p_safe", "ratio"]))
def p17_guards(spark, sf):
    from probengine.functions.columns import safe_ratio
    from probengine.operators.score import safe_probability
    pt = B.prediction_table(spark, sf)
    p_raw = F.when((F.col("model") == "gam") & (F.col("y") == 1) & (F.col("p_make") > 0.985),
                   F.lit(float("nan"))).otherwise((F.col("p_make") - 0.01) / 0.98)
    pt = pt.withColumn("p_raw", p_raw)
    out = safe_probability(pt, "p_raw", "p_safe", by=["model"], models=B.MODELS)
    out = out.withColumn("ratio", safe_ratio(F.col("y").cast("double"),
                                             (F.col("attempt_id") % 3).cast("double")))
    return round_doubles(out.select("attempt_id", "model", "p_safe", "ratio"))


# -- P20: lenient numeric cast ------------------------------------------------
@register("p20_lenient_cast", rsql("""
SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS brand_raw,
  TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand_no, TRY_CAST(p_type AS DOUBLE) AS type_num
FROM part""", ["brand_raw", "brand_no", "type_num"]))
def p20_cast(spark, sf):
    part = B.table(spark, sf, "part")
    return round_doubles(part.select(
        "p_partkey", lenient_double("p_brand").alias("brand_raw"),
        lenient_double(F.expr("substring(p_brand, 7)")).alias("brand_no"),
        lenient_double("p_type").alias("type_num")))


# -- W1-W3 as a stream: stateless cleaning + keyed state per actor ------------
@register("st_streaming_career_to_date", rsql(f"""WITH {model_ready_ctes(False)}
SELECT attempt_id, kicker_player_id, game_date, career_attempts, career_makes, career_fg_pct
FROM mr""", ["career_attempts", "career_makes", "career_fg_pct"]))
def st_career(spark, sf):
    from probengine.streaming.career_stream import career_stream, run_to_table, stream_attempts
    out = run_to_table(career_stream(stream_attempts(spark, sf)))
    return round_doubles(out)
