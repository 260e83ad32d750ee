"""Model fits, search, stacking, effects and scenario scoring
(M1-M8, V2-V5, V7, C6, N7, N8, X2-X5, B1, B4).

Iterative fits have no SQL twin: these get the driver's rows-only check and
pytest properties (planted coefficients, monotonicity, calibration) instead.
B4 is a pure expression and is oracle-checked.

Model sizes are the library defaults, which are the reference's: 600 bagged
trees and 200 outcome-forest trees of unlimited depth, 1,800 boosting
rounds, 40 search candidates.
"""

from __future__ import annotations

import uuid
from concurrent import futures

from pyspark.sql import functions as F

from probengine.operators import calibrate as CAL
from probengine.operators import effects as FX
from probengine.operators import encode as EN
from probengine.operators import ensemble as ENS
from probengine.operators import metrics as M
from probengine.operators import score as SC
from probengine.operators import stack as ST
from probengine.operators.clean import FEATURES, TARGET
from probengine.operators.folds import balanced_weights, stratified_folds
from probengine.operators.models import crossfit as CF
from probengine.operators.models import cv_bootstrap as CB
from probengine.operators.models import cv_gam as CG
from probengine.operators.models import gam as G
from probengine.operators.models import linear as L
from probengine.operators.models import saved as SV
from probengine.operators.models import search as S
from probengine.operators.models import trees as T
from probengine.operators.split import train_test
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, model_ready_ctes
from probengine.session import cut_lineage, ensure_checkpoint_dir
from probengine.sources import bindings as B
from probengine.sources.sinks import write_predictions

# model features: the 15 presentation features (kicker enters via encodings)
_CAT = "kicker_player_name"
#: P(make) falls with distance
FALLS = {"kick_distance": -1}


def _split(spark, sf):
    # the cleaned table feeds several jobs (split, encodings, moments, fits):
    # written once to the checkpoint folder instead of recomputed per job
    mr = cut_lineage(B.model_ready(spark, sf, with_history=True))
    train, test, _ = train_test(mr)
    return train, test


def _together(fits):
    """Independent fits submitted at the same time: while one waits for its
    last tasks, the others use the free slots."""
    with futures.ThreadPoolExecutor(max_workers=len(fits)) as pool:
        running = {name: pool.submit(fit) for name, fit in fits.items()}
        return {name: run.result() for name, run in running.items()}


def _out(df):
    return round_doubles(df.select("attempt_id", F.col(TARGET).alias("y"), "p_make"))


# -- M1: L2 logistic regression, balanced weights, kicker encoding ------------
@register("m1_logreg_holdout")
def m1(spark, sf):
    train, test = _split(spark, sf)
    # the balanced class weight and the balanced sample weight multiply
    m = L.fit_logistic(balanced_weights(train, TARGET), FEATURES, TARGET, L.TUNED_C, category=_CAT, sample_weight="w_balanced")
    return _out(m.transform(test))


# -- M2: L1 logistic regression -----------------------------------------------
@register("m2_l1_logreg_holdout")
def m2(spark, sf):
    train, test = _split(spark, sf)
    m = L.fit_logistic(train, FEATURES, TARGET, 0.05, penalty="l1", category=_CAT)
    return _out(m.transform(test))


# -- M3: bootstrap-averaged logistic regression --------------------------------
@register("m3_bootstrap_logreg_holdout")
def m3(spark, sf):
    train, test = _split(spark, sf)
    ms = L.fit_bootstrap_logistic(balanced_weights(train, TARGET), FEATURES, TARGET, "attempt_id", category=_CAT, sample_weight="w_balanced")
    return _out(L.predict_average(ms, test))


# -- M4: bagged trees with kicker ordinal + target encoding (F3) --------------
def _tree_frames(train, test):
    enc, prior = EN.fit_target_encoding(train, _CAT, TARGET)
    ords = EN.fit_ordinal(train, _CAT)

    def prep(df):
        df = EN.apply_target_encoding(df, enc, prior, _CAT, "kicker_te")
        return EN.apply_ordinal(df, ords, _CAT, "kicker_id").withColumn(
            "kicker_id", F.col("kicker_id").cast("double"))
    return prep(train), prep(test), FEATURES + ["kicker_te", "kicker_id"]


@register("m4_bagged_trees_holdout")
def m4(spark, sf):
    train, test = _split(spark, sf)
    tr, te, feats = _tree_frames(train, test)
    m = T.fit_bagging(balanced_weights(tr, TARGET), feats, TARGET, "attempt_id", weight="w_balanced")
    return _out(m.transform(te))


# -- M5: gradient-boosted trees -----------------------------------------------
@register("m5_boosted_trees_holdout")
def m5(spark, sf):
    train, test = _split(spark, sf)
    tr, te, feats = _tree_frames(train, test)
    m = T.fit_boosting(balanced_weights(tr, TARGET), feats, TARGET, "attempt_id", weight="w_balanced", monotone=FALLS)
    return _out(m.transform(te))


# -- M6: monotone audit + projection along distance ---------------------------
@register("m6_monotone_distance_audit")
def m6(spark, sf):
    train, test = _split(spark, sf)
    m = T.fit_boosting(train, FEATURES, TARGET, "attempt_id")   # a model that need not be monotone
    swept = m.sweep(test, "kick_distance", [18.0 + i for i in range(50)])
    miss = F.transform("sweep", lambda p: F.lit(1.0) - p)
    mono = F.transform(T.pool_increasing(miss), lambda p: F.lit(1.0) - p)
    mean = F.aggregate(mono, F.lit(0.0), lambda a, x: a + x) / F.size("sweep")
    return round_doubles(swept.select("attempt_id", T.sweep_violations(miss).alias("violations"),
                                      F.size("sweep").cast("long").alias("points"), mean.alias("mean_p_mono")))


# -- M7: additive spline logistic model ---------------------------------------
@register("m7_gam_holdout")
def m7(spark, sf):
    train, test = _split(spark, sf)
    tr, te, feats = _tree_frames(train, test)
    feats = [c for c in feats if c != "kicker_id"]
    m = G.fit_gam(balanced_weights(tr, TARGET), feats, TARGET, weight="w_balanced")
    return _out(m.transform(te))


# -- V1-V5, V7, C6: entry point B for logistic regression ---------------------
@register("v2_v7_logreg_tune_calibrate_holdout")
def v2_v7(spark, sf):
    train, test = _split(spark, sf)
    test = cut_lineage(test)
    folded = stratified_folds(train, "attempt_id", TARGET)
    cands = S.log_uniform_candidates()          # all 40: fitted together, see cv_logit
    scored, best = S.tune_calibrate_predict(cut_lineage(folded), test, FEATURES, TARGET,
                                            "kick_distance", cands, category=_CAT)
    met = M.metrics(scored.select(F.col(TARGET).alias("y"), F.col("p_cal").alias("p")), "p", "y")
    return round_doubles(met.select(F.lit(best["C"]).alias("best_C"),
                                    F.lit(best["cv_brier"]).alias("cv_brier"), "*"))


def _tuned(scores, found):
    """The calibrated holdout's metrics beside the winner of the search."""
    ci, best, brier = found
    scored = cut_lineage(CF.calibrated_holdout(scores, "kick_distance", "p_make", TARGET))
    met = M.metrics(scored.select(F.col(TARGET).alias("y"), F.col("p_cal").alias("p")), "p", "y")
    return round_doubles(met.select(F.lit(ci).alias("best_candidate"), *[F.lit(v).alias(f"best_{k}") for k, v in best.items()],
                                    F.lit(brier).alias("cv_brier"), "*"))


def _own(cv, ci):
    return cv.out_of_fold(ci).select("kick_distance", F.col("_y").cast("int").alias(TARGET), "p_make")


# -- V1-V5, V7, C6: entry point B for the spline model --------------------------
@register("v2_v7_gam_tune_calibrate_holdout")
def v2_v7_gam(spark, sf):
    """40 candidates of penalty and spline count x 5 folds in shared IRLS
    passes, the winner's out-of-fold scores calibrated, the refit scored."""
    train, test = _split(spark, sf)
    folded = stratified_folds(train, "attempt_id", TARGET)
    cv = CG.cv_gam_batched(folded, FEATURES, TARGET, S.random_grid(CG.GRID, CG.N_CANDIDATES), category=_CAT)
    found = S.select_best(cv.results())
    tr, te, _ = _tree_frames(train, test)
    m = G.fit_gam(balanced_weights(tr, TARGET), [*FEATURES, "kicker_te"], TARGET, weight="w_balanced", lam=found[1]["lam"],
                  n_basis=found[1]["n_splines"], max_iter=CG.MAX_ITER)
    return _tuned((_own(cv, found[0]), m.transform(te)), found)


# -- V1-V7, C6: entry point B for the bootstrap-averaged logistic regression ----
@register("v2_v7_bootstrap_tune_calibrate_holdout")
def v2_v7_bootstrap(spark, sf):
    """50 candidates of strength and penalty x 5 folds x 10 replicates in
    shared Newton passes, then as for the spline model."""
    train, test = _split(spark, sf)
    folded = stratified_folds(train, "attempt_id", TARGET)
    cv = CB.cv_bootstrap_batched(folded, FEATURES, TARGET, "attempt_id", S.random_grid(CB.grid(), CB.N_CANDIDATES), category=_CAT)
    found = S.select_best(cv.results())
    tr, te, _ = _tree_frames(train, test)
    m = CB.fit_bootstrap(tr, [*FEATURES, "kicker_te"], TARGET, "attempt_id", **found[1])
    return _tuned((_own(cv, found[0]), m.transform(te)), found)


# -- V2 + C6: out-of-fold calibration of the boosted trees ----------------------
@register("v2_c6_boosting_oof_calibrated_holdout")
def v2_c6_boosting(spark, sf):
    """Five fold models and the refit, 1,800 rounds each, fitted at the same time."""
    train, test = _split(spark, sf)
    folded = cut_lineage(balanced_weights(stratified_folds(train, "attempt_id", TARGET), TARGET))
    fit = lambda rows: T.fit_boosting(rows, FEATURES, TARGET, "attempt_id", weight="w_balanced", monotone=FALLS)
    scored = CF.model_scores(folded, cut_lineage(test), fit, 5)
    met = cut_lineage(CF.calibrated_holdout(scored, "kick_distance", "p_make", TARGET))
    return round_doubles(M.metrics(met.select(F.col(TARGET).alias("y"), F.col("p_cal").alias("p")), "p", "y"))


# -- V2 + C6: out-of-fold calibration of the bagged trees -----------------------
@register("v2_c6_bagging_oof_calibrated_holdout")
def v2_c6_bagging(spark, sf):
    """Five forests by folds and the refit in one run of 3,600 trees."""
    train, test = _split(spark, sf)
    folded = balanced_weights(stratified_folds(train, "attempt_id", TARGET), TARGET)
    scores = CF.bagging_scores(cut_lineage(folded), test, FEATURES, TARGET, "attempt_id", 5, weight="w_balanced")
    scored = cut_lineage(CF.calibrated_holdout(scores, "kick_distance", "p_make", TARGET))
    met = M.metrics(scored.select(F.col(TARGET).alias("y"), F.col("p_cal").alias("p")), "p", "y")
    return round_doubles(met)


# -- N8 + N7: stacked meta-logistic over context subsets ----------------------
@register("n7_stacked_meta_search")
def n7(spark, sf):
    mr = B.model_ready(spark, sf, with_history=True)
    wide = B.wide_predictions(spark, sf)
    stacked = cut_lineage(wide.join(mr.select("attempt_id", "season", *ST.CONTEXT_FEATURES),
                                    "attempt_id"))     # read by every Newton pass
    train, test, _ = train_test(stacked)
    probs = [f"p_{m}" for m in B.MODELS]
    return round_doubles(ST.meta_search(train, test, probs, "y"))


# -- N8: base models -> calibration -> prediction table -> ensembles ---------
@register("n8_base_models_to_ensembles")
def n8(spark, sf):
    """M1, M3, M4, M5 and M7 fitted on the earlier seasons, calibrated in
    sample by distance bucket, written as the long prediction table, aligned
    by attempt, and searched by weights (N3) and by stacking (N7)."""
    train, test = _split(spark, sf)
    both = cut_lineage(train.withColumn("_part", F.lit("train")).unionByName(test.withColumn("_part", F.lit("test"))))
    tr, rows, feats = _tree_frames(balanced_weights(train, TARGET), both)
    tr, rows = cut_lineage(tr), cut_lineage(rows)
    smooth = [c for c in feats if c != "kicker_id"]
    fitted = _together({
        "logreg": lambda: L.fit_logistic(tr, smooth, TARGET, L.TUNED_C, sample_weight="w_balanced"),
        "bootstrap": lambda: L.fit_bootstrap_logistic(tr, smooth, TARGET, "attempt_id", sample_weight="w_balanced"),
        "bagging": lambda: T.fit_bagging(tr, feats, TARGET, "attempt_id", weight="w_balanced"),
        "boosting": lambda: T.fit_boosting(tr, feats, TARGET, "attempt_id", weight="w_balanced", monotone=FALLS),
        "gam": lambda: G.fit_gam(tr, smooth, TARGET, weight="w_balanced"),
    })
    scored = {name: L.predict_average(m, rows) if name == "bootstrap" else m.transform(rows) for name, m in fitted.items()}
    long = None
    for name, df in scored.items():
        raw = cut_lineage(df.select("attempt_id", "_part", "kick_distance", F.col(TARGET).alias("y"), F.col("p_make").alias("p_raw")))
        cal = CAL.fit_inclusive(raw.where("_part = 'train'"), "kick_distance", "p_raw", "y")
        one = CAL.apply_inclusive(raw, cal, "kick_distance", "p_raw", "p_make").withColumn("model", F.lit(name))
        long = one if long is None else long.unionByName(one)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions-{uuid.uuid4().hex}"
    write_predictions(long, path)
    wide = ENS.align(spark.read.parquet(path), list(scored))
    stacked = cut_lineage(wide.join(both.select("attempt_id", "_part", *ST.CONTEXT_FEATURES), "attempt_id"))
    holdout = stacked.where("_part = 'test'")
    probs = [f"p_{m}" for m in scored]
    weighted = ENS.weighted_search(holdout, list(scored)).select(
        F.lit("weighted").alias("search"), "name", "brier", "auc", "pr_miss", "ece10", "tn", "fp", "fn", "tp")
    meta = ST.meta_search(stacked.where("_part = 'train'"), holdout, probs, "y").select(
        F.lit("stacked").alias("search"), F.col("ensemble_name").alias("name"), "brier", "auc", "pr_miss", "ece10", "tn", "fp", "fn", "tp")
    return round_doubles(weighted.unionByName(meta))


# -- X1-X5: treatment effects by cross-fitted DML -----------------------------
@register("x2_x5_effect_summary")
def x5(spark, sf):
    mr = B.model_ready(spark, sf, with_history=True)
    return round_doubles(FX.treatment_effects(mr, "attempt_id"))


# -- B1-B3 (+ C3/C4, N4): batch scenario scoring ------------------------------
@register("b1_scenario_batch_scoring")
def b1(spark, sf):
    train, test = _split(spark, sf)
    models = _together({
        "bagging": lambda: T.fit_bagging(train, FEATURES, TARGET, "attempt_id"),
        "boosting": lambda: T.fit_boosting(train, FEATURES, TARGET, "attempt_id"),
        "gam": lambda: G.fit_gam(train, FEATURES, TARGET),
        "logreg": lambda: L.fit_logistic(train, FEATURES, TARGET, L.TUNED_C, class_balanced=False, scale=False),
    })
    # in-sample calibrators per inclusive distance bucket (the presentation flow); the
    # ensemble is saved, and the scenarios are scored by what is read back
    fitted = SV.CalibratedEnsemble.fit_calibrators(models, train.select(TARGET, *FEATURES), TARGET, SC.PRESENTATION_WEIGHTS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ensemble-{uuid.uuid4().hex}"
    fitted.save(spark, path)
    out = SV.CalibratedEnsemble.load(spark, path).transform(SC.validate_scenarios(test.select("attempt_id", *FEATURES)))
    return round_doubles(out.select("attempt_id", *[f"p_{m}" for m in models], "p_make",
                                    "p_miss", "pred_make", "violations"))


# -- B4 + P21: scenario validation (defaults and range violations) ------------
_RULE_COLS = [c for c, *_ in SC.SCENARIO_RULES]


@register("b4_scenario_validation", rsql(f"""WITH {model_ready_ctes(True)},
s AS (SELECT attempt_id, {", ".join(f"coalesce(CAST({c} AS DOUBLE), {D(d)}) AS {c}" for c, _, _, d in SC.SCENARIO_RULES)},
      CASE WHEN season_type_binary = 1 THEN 'Postseason' ELSE 'Regular' END AS season_type FROM mr)
SELECT attempt_id, {", ".join(_RULE_COLS)},
  CAST(coalesce(season_type = 'Postseason', false) AS INTEGER) AS season_type_binary,
  list_filter([{", ".join(f"CASE WHEN {c} < {D(lo)} OR {c} > {D(hi)} THEN '{c}' END" for c, lo, hi, _ in SC.SCENARIO_RULES)}], lambda x: x IS NOT NULL) AS violations
FROM s""", _RULE_COLS))
def b4(spark, sf):
    mr = B.model_ready(spark, sf, with_history=True)
    scen = mr.select("attempt_id", *_RULE_COLS,
                     F.when(F.col("season_type_binary") == 1, "Postseason").otherwise("Regular")
                     .alias("season_type"))
    out = SC.encode_choices(SC.validate_scenarios(scen))
    return round_doubles(out.select("attempt_id", *_RULE_COLS, "season_type_binary", "violations"))


# -- F5 + F6 + M1 + S8 + B1: persisted one-hot pipeline, reloaded to score ----
@register("f5_f6_s8_onehot_pipeline_scoring")
def f5_s8(spark, sf):
    from probengine.sources.sinks import load_model, save_model
    train, test = _split(spark, sf)
    model = L.fit_scoring_pipeline(train, [_CAT], FEATURES, TARGET, L.TUNED_C)
    path = f"{ensure_checkpoint_dir(spark)}/models/onehot-{uuid.uuid4().hex[:8]}"
    save_model(model, path)
    scored = L.probability(load_model(path).transform(test))
    return _out(scored)
