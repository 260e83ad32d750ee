"""Checked queries: encodings, folds, resampling weights, the flagship
(F1, F2, F4, W4, V1, V6, J5, P5 + E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from probengine.operators import encode as EN
from probengine.operators import folds as FO
from probengine.operators import metrics as M
from probengine.operators.clean import TARGET
from probengine.operators.split import train_test
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, metrics_sql, model_ready_ctes, uniform_sql
from probengine.session import cut_lineage
from probengine.sources import bindings as B

_SPLIT = f"""WITH {model_ready_ctes(True)},
tr AS (SELECT * FROM mr WHERE season < (SELECT max(season) FROM mr)),
te AS (SELECT * FROM mr WHERE season = (SELECT max(season) FROM mr)),
pr AS (SELECT avg(CAST(1 - field_goal_result_binary AS DOUBLE)) AS prior FROM tr),
st AS (SELECT kicker_player_name, count(*) AS n,
         sum(CAST(1 - field_goal_result_binary AS DOUBLE)) AS misses FROM tr GROUP BY kicker_player_name),
enc AS (SELECT st.kicker_player_name,
          (st.n * (st.misses / st.n) + {D(20)} * pr.prior) / (st.n + {D(20)}) AS enc FROM st CROSS JOIN pr)"""


def _split(spark, sf):
    # the cleaned table feeds several jobs (split, encodings, moments, fits):
    # written once to the checkpoint folder instead of recomputed per job
    mr = cut_lineage(B.model_ready(spark, sf, with_history=True))
    train, test, _ = train_test(mr)
    return train, test


def flagship_holdout_metrics(spark, sf):
    """Entry flagship: P(make) = 1 - smoothed miss rate of the actor over
    earlier seasons (unseen actor -> prior), metric record on the holdout."""
    train, test = _split(spark, sf)
    enc = EN.target_encode(train, test, "kicker_player_name", TARGET, out="kicker_te")
    scored = enc.select(F.col(TARGET).alias("y"), (F.lit(1.0) - F.col("kicker_te")).alias("p"))
    return round_doubles(M.metrics(cut_lineage(scored), "p", "y"))


register("f1_e6_flagship_holdout_metrics", rsql(f"""{_SPLIT},
sc AS (SELECT 0 AS g, te.field_goal_result_binary AS y, {D(1)} - coalesce(enc.enc, pr.prior) AS p
       FROM te LEFT JOIN enc ON te.kicker_player_name = enc.kicker_player_name CROSS JOIN pr),
{metrics_sql('sc', 'p', 'y', 'g')}
SELECT n, brier, tn, fp, fn, tp, auc, pr_miss, ece10 FROM met""",
                                                 ["brier", "auc", "pr_miss", "ece10"]))(
    flagship_holdout_metrics)


# -- F1 / J5: smoothed target encoding learned on train, applied to test ------
@register("f1_target_encoding", rsql(f"""{_SPLIT}
SELECT te.attempt_id, coalesce(enc.enc, pr.prior) AS kicker_te
FROM te LEFT JOIN enc ON te.kicker_player_name = enc.kicker_player_name CROSS JOIN pr""",
                                     ["kicker_te"]))
def f1_encoding(spark, sf):
    train, test = _split(spark, sf)
    out = EN.target_encode(train, test, "kicker_player_name", TARGET, out="kicker_te")
    return round_doubles(out.select("attempt_id", "kicker_te"))


_FOLDS_SQL = (f"CAST((row_number() OVER (PARTITION BY field_goal_result_binary ORDER BY "
              f"{uniform_sql(repr('fold42'), 'attempt_id')}, attempt_id) - 1) % 5 AS INTEGER)")


# -- V1: stratified folds -----------------------------------------------------
@register("v1_stratified_folds", f"""{_SPLIT}
SELECT attempt_id, field_goal_result_binary AS y, {_FOLDS_SQL} AS fold FROM tr""")
def v1_folds(spark, sf):
    train, _ = _split(spark, sf)
    out = FO.stratified_folds(train.withColumnRenamed(TARGET, "y"), "attempt_id", "y")
    return out.select("attempt_id", "y", "fold")


# -- F2: out-of-fold target encoding in one pass ------------------------------
@register("f2_oof_target_encoding", rsql(f"""{_SPLIT},
f AS (SELECT attempt_id, kicker_player_name AS k, field_goal_result_binary AS y, {_FOLDS_SQL} AS fold FROM tr),
kf AS (SELECT k, fold, count(*) AS n, sum(CAST(1 - y AS DOUBLE)) AS misses FROM f GROUP BY k, fold),
kt AS (SELECT k, sum(n) AS kn, sum(misses) AS km FROM kf GROUP BY k),
ft AS (SELECT fold, sum(n) AS fn, sum(misses) AS fm FROM kf GROUP BY fold),
fp AS (SELECT fold, ((SELECT sum(fm) FROM ft) - fm) / ((SELECT sum(fn) FROM ft) - fn) AS prior FROM ft),
e AS (SELECT kf.k, kf.fold,
        CASE WHEN kt.kn - kf.n > 0 THEN ((kt.kn - kf.n) * ((kt.km - kf.misses) / (kt.kn - kf.n))
             + {D(20)} * fp.prior) / ((kt.kn - kf.n) + {D(20)}) END AS enc
      FROM kf JOIN kt ON kf.k = kt.k JOIN fp ON kf.fold = fp.fold)
SELECT f.attempt_id, f.fold, coalesce(e.enc, fp.prior) AS kicker_te
FROM f LEFT JOIN e ON f.k = e.k AND f.fold = e.fold LEFT JOIN fp ON f.fold = fp.fold""", ["kicker_te"]))
def f2_oof(spark, sf):
    train, _ = _split(spark, sf)
    folded = cut_lineage(FO.stratified_folds(train, "attempt_id", TARGET))
    out = EN.oof_target_encode(folded, "kicker_player_name", TARGET, "fold", "kicker_te")
    return round_doubles(out.select("attempt_id", "fold", "kicker_te"))


# -- W4: ordinal id of a category, unseen -> -1 -------------------------------
@register("w4_ordinal_ids", f"""{_SPLIT},
m AS (SELECT kicker_player_name, CAST(dense_rank() OVER (ORDER BY kicker_player_name) - 1 AS BIGINT) AS ordinal
      FROM (SELECT DISTINCT kicker_player_name FROM tr))
SELECT te.attempt_id, CAST(coalesce(m.ordinal, -1) AS BIGINT) AS kicker_id
FROM te LEFT JOIN m ON te.kicker_player_name = m.kicker_player_name""")
def w4_ordinal(spark, sf):
    train, test = _split(spark, sf)
    mapping = EN.fit_ordinal(train, "kicker_player_name")
    return EN.apply_ordinal(test, mapping, "kicker_player_name").select("attempt_id", "kicker_id")


# -- F4: standardise with the population std of the training rows -------------
_Z = ["kick_distance", "temp", "wind", "career_attempts"]


@register("f4_standardise", rsql(f"""{_SPLIT},
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _Z)} FROM tr)
SELECT te.attempt_id, {", ".join(
    f"(te.{c} - s.m_{c}) / CASE WHEN s.s_{c} > 0 THEN s.s_{c} ELSE {D(1)} END AS z_{c}" for c in _Z)}
FROM te CROSS JOIN s""", [f"z_{c}" for c in _Z]))
def f4_scale(spark, sf):
    train, test = _split(spark, sf)
    stats = EN.fit_standardiser(train, _Z)
    out = EN.apply_standardiser(test, stats, suffix="_z")
    return round_doubles(out.select("attempt_id", *[F.col(f"{c}_z").alias(f"z_{c}") for c in _Z]))


# -- V6: bootstrap multiplicities (Poisson(1) by portable uniform) ------------
def _poisson_case_sql(u: str) -> str:
    cdf = FO.poisson_cdf(1.0)
    whens = " ".join(f"WHEN {u} < {D(repr(c))} THEN {k}" for k, c in enumerate(cdf))
    return f"CAST(CASE {whens} ELSE {len(cdf)} END AS INTEGER)"


_U_BOOT = ("(CAST(('0x' || substr(md5('boot42|' || CAST(attempt_id AS VARCHAR) || '|' || "
           "CAST(replicate AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))")


@register("v6_bootstrap_multiplicities", f"""{_SPLIT},
r AS (SELECT tr.attempt_id, CAST(rp.range AS INTEGER) AS replicate FROM tr CROSS JOIN range(10) rp)
SELECT attempt_id, replicate, {_poisson_case_sql(_U_BOOT)} AS mult FROM r""")
def v6_boot(spark, sf):
    train, _ = _split(spark, sf)
    out = FO.bootstrap_weights(train, "attempt_id", 10)
    return out.select("attempt_id", "replicate", "mult")
