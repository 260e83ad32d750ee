"""Checked queries that write and read back (S2-S7, S9), orders (O1, O3, O4),
column arithmetic and scenario choices (P16, P21, B4), covariates (X1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from probengine.functions.columns import flag
from probengine.operators import effects as FX
from probengine.operators import score as SC
from probengine.operators.clean import MODEL_READY_COLUMNS
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, PREDS, RAW, model_ready_ctes
from probengine.session import ensure_checkpoint_dir
from probengine.sources import bindings as B
from probengine.sources import readers, sinks


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- S4 + S2: CSV with a header, written and read back with its schema --------
_PART = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


@register("s2_s4_csv_round_trip", rsql(_PART, ["p_retailprice"]))
def s2_s4(spark, sf):
    df = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = _folder(spark, "csv")
    sinks.write_csv(df, path)
    return round_doubles(readers.read_csv(spark, path, df.schema))


# -- S3: no Parquet under the name, so the CSV is read ------------------------
@register("s3_csv_fallback", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s3_fallback(spark, sf):
    df = B.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    base = _folder(spark, "fallback")
    sinks.write_csv(df, f"{base}.csv")
    return readers.read_table(spark, base, csv_schema=df.schema)


# -- S5: partitioned by season; the filter on it prunes partitions ------------
@register("s5_partitioned_parquet", rsql(f"""WITH {model_ready_ctes(True)}
SELECT season, attempt_id, kick_distance, field_goal_result_binary FROM mr WHERE season = (SELECT max(season) FROM mr)""",
                                          ["kick_distance"]))
def s5_partitioned(spark, sf):
    df = B.model_ready(spark, sf).select("attempt_id", "kick_distance", "field_goal_result_binary", "season")
    path = _folder(spark, "by-season")
    sinks.write_parquet(df, path)
    back = readers.read_parquet(spark, path, df.schema)
    latest = back.agg(F.max("season")).first()[0]
    return round_doubles(back.where(F.col("season") == latest).select("season", "attempt_id", "kick_distance", "field_goal_result_binary"))


# -- S6: the long prediction table, by model ----------------------------------
@register("s6_prediction_table_round_trip", rsql(f"""WITH {PREDS}
SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS makes, avg(p_make) AS mean_p FROM preds GROUP BY model""", ["mean_p"]))
def s6_predictions(spark, sf):
    path = _folder(spark, "predictions")
    sinks.write_predictions(B.prediction_table(spark, sf), path)
    back = readers.read_parquet(spark, path)
    return round_doubles(back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("makes"), F.avg("p_make").alias("mean_p")))


# -- S7: a results table in both formats --------------------------------------
@register("s7_results_round_trip", """
SELECT o_orderstatus, count(*) AS n, 'parquet' AS fmt FROM orders GROUP BY o_orderstatus
UNION ALL SELECT o_orderstatus, count(*) AS n, 'csv' AS fmt FROM orders GROUP BY o_orderstatus""")
def s7_results(spark, sf):
    df = B.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for fmt in ("parquet", "csv"):
        path = _folder(spark, f"results-{fmt}")
        sinks.write_table(df, path, fmt)
        back = spark.read.schema(df.schema).parquet(path) if fmt == "parquet" else readers.read_csv(spark, path, df.schema)
        back = back.withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


# -- S9: required columns, one of them under an accepted misspelling ----------
@register("s9_required_columns", "SELECT c_custkey, c_name AS kicker_name FROM customer")
def s9_required(spark, sf):
    df = B.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("kiker_name"))
    return readers.require_columns(df, ["c_custkey", "kicker_name"], {"kiker_name": "kicker_name"})


# -- O1 + O4: order by actor and date, first rows -----------------------------
@register("o1_o4_first_attempts", f"""WITH {RAW}
SELECT attempt_id, kicker_player_id, game_date FROM raw ORDER BY kicker_player_id, game_date, attempt_id LIMIT 50""")
def o1_o4(spark, sf):
    raw = B.raw_attempts(spark, sf)
    return raw.select("attempt_id", "kicker_player_id", "game_date").orderBy("kicker_player_id", "game_date", "attempt_id").limit(50)


# -- O3: arg-min, the first candidate wins a tie ------------------------------
@register("o3_first_best_candidate", """
SELECT c_custkey % 7 AS trial_set, first(c_custkey ORDER BY round(c_acctbal, 0), c_custkey) AS candidate_id,
  min(round(c_acctbal, 0)) AS score FROM customer GROUP BY c_custkey % 7""")
def o3_first_best(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("trial_set"),
                                              F.round("c_acctbal", 0).alias("score"))
    return c.groupBy("trial_set").agg(F.min_by("c_custkey", F.struct("score", "c_custkey")).alias("candidate_id"),
                                      F.min("score").alias("score"))


# -- P16: total points and the label flip -------------------------------------
@register("p16_column_arithmetic", rsql(f"""WITH {RAW}
SELECT attempt_id, total_home_score + total_away_score AS total_points_scored,
  1 - CAST(coalesce(field_goal_result = 'made', false) AS INTEGER) AS miss FROM raw""", ["total_points_scored"]))
def p16_arithmetic(spark, sf):
    raw = B.raw_attempts(spark, sf)
    return round_doubles(raw.select("attempt_id", (F.col("total_home_score") + F.col("total_away_score")).alias("total_points_scored"),
                                    (1 - flag(F.col("field_goal_result") == "made")).alias("miss")))


# -- P21 + B4: all five choices, and inputs outside of their ranges -----------
_RULES = [c for c, *_ in SC.SCENARIO_RULES]


@register("p21_b4_scenarios_with_violations", rsql(f"""WITH {model_ready_ctes(True)},
s AS (SELECT attempt_id, {", ".join(f"CASE WHEN attempt_id % 13 = {i} THEN NULL ELSE CAST({c} AS DOUBLE) * {D(3)} END AS {c}" for i, c in enumerate(_RULES))} FROM mr),
v AS (SELECT attempt_id, {", ".join(f"coalesce({c}, {D(d)}) AS {c}" for c, _, _, d in SC.SCENARIO_RULES)} FROM s)
SELECT attempt_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} < {D(lo)} OR {c} > {D(hi)} THEN '{c}' END" for c, lo, hi, _ in SC.SCENARIO_RULES)}], lambda x: x IS NOT NULL), ',') AS violations,
  {", ".join(f"CAST(attempt_id % 3 = {i % 3} AS INTEGER) AS {flag_}" for i, flag_ in enumerate(SC.SCENARIO_CHOICES))}
FROM v""", []))
def p21_b4(spark, sf):
    mr = B.model_ready(spark, sf)
    choices = [F.when(F.col("attempt_id") % 3 == i % 3, F.lit(yes)).otherwise(F.lit("other")).alias(src)
               for i, (src, yes) in enumerate(SC.SCENARIO_CHOICES.values())]
    scaled = [F.when(F.col("attempt_id") % 13 != i, F.col(c).cast("double") * 3.0).alias(c) for i, c in enumerate(_RULES)]
    out = SC.encode_choices(SC.validate_scenarios(mr.select("attempt_id", *scaled, *choices)))
    return out.select("attempt_id", F.array_join("violations", ",").alias("violations"), *SC.SCENARIO_CHOICES)


# -- X1: covariates of every treatment ----------------------------------------
_TREATMENTS = [*FX.BINARY_TREATMENTS, *FX.CONT_TREATMENTS]
_PAIRS = [(t, c) for t in _TREATMENTS for c in MODEL_READY_COLUMNS[1:]
          if c not in (t, FX.TARGET, *FX.ID_COLS, *FX.RELATED_DROPS.get(t, ()))]
_MOMENTS = ", ".join(f"{{'treatment': '{t}', 'covariate': '{c}', 'n': count(CASE WHEN {t} IS NOT NULL AND {c} IS NOT NULL THEN 1 END), "
                     f"'mean_covariate': avg(CASE WHEN {t} IS NOT NULL THEN {c}::DOUBLE END), 'mean_product': avg({t}::DOUBLE * {c}::DOUBLE)}}" for t, c in _PAIRS)


@register("x1_covariates", rsql(f"""WITH {model_ready_ctes(True)}, x AS (SELECT unnest([{_MOMENTS}], recursive := true) FROM mr) SELECT * FROM x""",
                                ["mean_covariate", "mean_product"]))
def x1_covariates(spark, sf):
    df = B.model_ready(spark, sf, with_history=True)
    pairs = FX.covariate_table(spark, [c for c in df.columns if c != "attempt_id"], _TREATMENTS).collect()    # columns x treatments
    return round_doubles(FX.covariate_moments(df, [(p["treatment"], p["covariate"]) for p in pairs]))


# -- X4 (with X2, X3): effects by segment, nuisances by group means -----------
_KINDS = [(t, "binary") for t in FX.BINARY_TREATMENTS] + [(t, "continuous") for t in FX.CONT_TREATMENTS]
_SEGMENTS = ["distance_range", "roof_binary", "surface_binary"]
_OTHERS = ", ".join(f"(sum({c}::DOUBLE) OVER g - coalesce(sum({c}::DOUBLE) OVER f, 0)) / nullif(count({c}) OVER g - count({c}) OVER f, 0) AS m_{c}"
                    for c in ["miss", *[t for t, _ in _KINDS]])
_EFFECTS = " UNION ALL ".join(
    f"SELECT '{t}' AS treatment, '{kind}' AS type, {float(FX.DELTA.get(t, 1.0)) if kind == 'continuous' else 1.0}::DOUBLE AS delta, "
    f"miss - m_miss AS r_y, {t}::DOUBLE - m_{t} AS r_t, distance_range, roof_binary, surface_binary FROM o" for t, kind in _KINDS)


@register("x4_effects_by_segment", rsql(f"""WITH {model_ready_ctes(True)},
r AS (SELECT *, (1 - {FX.TARGET})::DOUBLE AS miss, floor(kick_distance / 10)::BIGINT AS distance_range,
  floor(('0x' || substr(md5('fold42|' || attempt_id), 1, 8))::BIGINT / 4294967296.0 * 2) AS fold FROM mr),
o AS (SELECT *, {_OTHERS} FROM r WINDOW g AS (PARTITION BY distance_range), f AS (PARTITION BY distance_range, fold)),
e AS (SELECT * FROM ({_EFFECTS}) WHERE r_y IS NOT NULL AND r_t IS NOT NULL),
s AS (SELECT NULL::VARCHAR AS segment, NULL::VARCHAR AS value, treatment, type, delta, r_y, r_t FROM e
  UNION ALL SELECT 'distance_range', distance_range::VARCHAR, treatment, type, delta, r_y, r_t FROM e
  UNION ALL SELECT 'roof_binary', roof_binary::VARCHAR, treatment, type, delta, r_y, r_t FROM e
  UNION ALL SELECT 'surface_binary', surface_binary::VARCHAR, treatment, type, delta, r_y, r_t FROM e),
a AS (SELECT segment, value, treatment, type, delta, sum(r_t * r_y) / nullif(sum(r_t * r_t), 0) AS theta, count(*) AS n FROM s GROUP BY ALL)
SELECT segment, value, treatment, type, delta, theta * delta AS ATE_delta, theta AS ATE_per_unit, n FROM a""",
                                        ["ATE_delta", "ATE_per_unit"]))
def x4_effects_by_segment(spark, sf):
    df = B.model_ready(spark, sf, with_history=True).withColumn("distance_range", F.floor(F.col("kick_distance") / 10))
    residuals = FX.group_mean_residuals(df, "attempt_id", "distance_range", _KINDS, segments=_SEGMENTS)
    return round_doubles(FX.final_stage(residuals, FX.DELTA, _SEGMENTS))
