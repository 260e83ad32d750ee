"""Checked queries: prediction alignment, stacking input, ensemble searches,
fixed blends and scoring outputs (J4, J6, N1-N6, B2, B3)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from probengine.operators import ensemble as EN
from probengine.operators import metrics as M
from probengine.operators import profile as PR
from probengine.operators import score as SC
from probengine.plans.catalog import register, round_doubles, rsql
from probengine.plans.oracle_base import D, PREDS, WIDE, metrics_sql, model_ready_ctes
from probengine.sources import bindings as B

MODELS = B.MODELS
_NM = len(MODELS)
_TOTAL = int(round(1.0 / EN.GRID_STEP))
_LISTED = ", ".join(f"'{m}'" for m in MODELS)
_MET = ["brier", "auc", "pr_miss", "ece10"]


def _wide(spark, sf):
    return EN.align(B.prediction_table(spark, sf), MODELS)


# -- J4: alignment contract ---------------------------------------------------
@register("j4_alignment_contract", f"""WITH {PREDS},
one AS (SELECT attempt_id, model, count(*) AS n, min(y) AS lo, max(y) AS hi FROM preds GROUP BY attempt_id, model),
per AS (SELECT attempt_id, count(*) FILTER (model IN ({_LISTED})) AS n_listed, bool_or(n > 1 AND model IN ({_LISTED})) AS doubled,
    bool_or(model NOT IN ({_LISTED})) AS unlisted,
    min(lo) FILTER (model IN ({_LISTED})) <> max(hi) FILTER (model IN ({_LISTED})) AS mm FROM one GROUP BY attempt_id)
SELECT count(*) AS n_attempts,
  CAST(sum(CASE WHEN n_listed < {_NM} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_model,
  CAST(sum(CASE WHEN doubled THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate_model,
  CAST(sum(CASE WHEN unlisted THEN 1 ELSE 0 END) AS BIGINT) AS n_unlisted_model,
  CAST(sum(CASE WHEN mm THEN 1 ELSE 0 END) AS BIGINT) AS n_label_mismatch FROM per""")
def j4_contract(spark, sf):
    return EN.align_contract(B.prediction_table(spark, sf), MODELS)


# -- J4 on predictions with missing, doubled, unlisted and disagreeing rows ----
_HOLES = """broken AS (
  SELECT attempt_id, y, CASE WHEN attempt_id % 11 = 0 AND model = 'gam' THEN 'other' ELSE model END AS model, p_make FROM preds
  WHERE NOT (attempt_id % 7 = 0 AND model = 'logreg')
  UNION ALL SELECT attempt_id, 1 - y AS y, model, p_make FROM preds WHERE attempt_id % 5 = 0 AND model = 'gam')"""


@register("j4_alignment_violations", f"""WITH {PREDS},
{_HOLES},
one AS (SELECT attempt_id, model, count(*) AS n, min(y) AS lo, max(y) AS hi FROM broken GROUP BY attempt_id, model),
per AS (SELECT attempt_id, count(*) FILTER (model IN ({_LISTED})) AS n_listed, bool_or(n > 1 AND model IN ({_LISTED})) AS doubled,
    bool_or(model NOT IN ({_LISTED})) AS unlisted,
    min(lo) FILTER (model IN ({_LISTED})) <> max(hi) FILTER (model IN ({_LISTED})) AS mm FROM one GROUP BY attempt_id)
SELECT count(*) AS n_attempts,
  CAST(sum(CASE WHEN n_listed < {_NM} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_model,
  CAST(sum(CASE WHEN doubled THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicate_model,
  CAST(sum(CASE WHEN unlisted THEN 1 ELSE 0 END) AS BIGINT) AS n_unlisted_model,
  CAST(sum(CASE WHEN mm THEN 1 ELSE 0 END) AS BIGINT) AS n_label_mismatch FROM per""")
def j4_violations(spark, sf):
    pt = B.prediction_table(spark, sf).select("attempt_id", "y", "model", "p_make")
    kept = pt.where(~((F.col("attempt_id") % 7 == 0) & (F.col("model") == "logreg")))
    renamed = kept.withColumn("model", F.when((F.col("attempt_id") % 11 == 0) & (F.col("model") == "gam"), "other")
                              .otherwise(F.col("model")))
    again = pt.where((F.col("attempt_id") % 5 == 0) & (F.col("model") == "gam")).withColumn("y", 1 - F.col("y"))
    return EN.align_contract(renamed.unionByName(again), MODELS)


_CTX = ["kick_distance", "is_snow", "is_rain", "roof_binary", "buzzer_beater_binary", "career_fg_pct"]


# -- J4 + J6: aligned wide table with context columns (stacking input) --------
@register("j6_stacked_context", rsql(f"""WITH {model_ready_ctes(True)},{WIDE}
SELECT w.attempt_id, w.y, {", ".join(f"w.p_{m}" for m in MODELS)}, {", ".join(f"mr.{c}" for c in _CTX)}
FROM wide w JOIN mr ON w.attempt_id = mr.attempt_id""",
                                     [f"p_{m}" for m in MODELS] + ["kick_distance", "career_fg_pct"]))
def j6_stack(spark, sf):
    wide = _wide(spark, sf)
    ctx = B.model_ready(spark, sf, with_history=True)
    return round_doubles(EN.stack_context(wide, ctx, _CTX))


def _w_sql(i: str) -> str:
    return f"CAST(k{i} AS DOUBLE) / {D(_TOTAL)}"


def _gram_sql() -> str:
    cols = ", ".join(f"avg((p_{a} - y) * (p_{b} - y)) AS g_{i}_{j}"
                     for i, a in enumerate(MODELS) for j, b in enumerate(MODELS) if j >= i)
    return f"gm AS (SELECT {cols} FROM wide)"


def _gram_brier_sql(w) -> str:
    terms = []
    for a in range(_NM):
        for b in range(_NM):
            i, j = min(a, b), max(a, b)
            terms.append(f"{w(a)} * {w(b)} * gm.g_{i}_{j}")
    return " + ".join(terms)


def _blend_sql(alias: str) -> str:
    return " + ".join(f"(CASE WHEN {alias}.w_{m} > 0 THEN {alias}.w_{m} * wide.p_{m} ELSE {D(0)} END)"
                      for m in MODELS)


_GRID_SQL = (
    "grid AS (SELECT " + ", ".join(f"k{i}.range AS k{i}" for i in range(_NM - 1))
    + f", {_TOTAL} - (" + " + ".join(f"k{i}.range" for i in range(_NM - 1)) + f") AS k{_NM - 1}"
    + " FROM " + ", ".join(f"range({_TOTAL + 1}) k{i}" for i in range(_NM - 1))
    + " WHERE " + " AND ".join("(" + " + ".join(f"k{j}.range" for j in range(i + 1)) + f") <= {_TOTAL}"
                               for i in range(_NM - 1)) + ")")

_WEIGHTED_TOP = f"""{_gram_sql()},
{_GRID_SQL},
sc AS (SELECT {" + ".join(f"CAST(k{i} AS BIGINT) * {(_TOTAL + 1) ** (_NM - 1 - i)}" for i in range(_NM))} AS weight_id,
         {", ".join(f"{_w_sql(str(i))} AS w_{m}" for i, m in enumerate(MODELS))},
         {_gram_brier_sql(lambda a: _w_sql(str(a)))} AS brier_gram
       FROM grid CROSS JOIN gm),
top AS (SELECT *, 'ENS[' || concat_ws('+', {", ".join(f"CASE WHEN w_{m} > 0 THEN printf('%.2f*{m}', w_{m}) END" for m in MODELS)}) || ']' AS name
        FROM sc ORDER BY round(brier_gram, 12), weight_id LIMIT {EN.TOP_K_WEIGHTED})"""


# -- N2 + N3: weighted grid search by the Gram form, exact metrics for top-20 -
@register("n3_weighted_search_top20", rsql(f"""WITH {WIDE},{_WEIGHTED_TOP},
bl AS (SELECT top.weight_id, wide.y, {_blend_sql('top')} AS p FROM wide CROSS JOIN top),
{metrics_sql('bl', 'p', 'y', 'weight_id')}
SELECT top.*, met.n, met.brier, met.tn, met.fp, met.fn, met.tp, met.auc, met.pr_miss, met.ece10,
  row_number() OVER (ORDER BY round(top.brier_gram, 12), top.weight_id) AS rank
FROM top JOIN met ON top.weight_id = met.weight_id""",
                                           [f"w_{m}" for m in MODELS] + ["brier_gram"] + _MET))
def n3_weighted(spark, sf):
    # align() already checkpointed the wide table while checking the contract
    return round_doubles(EN.weighted_search(_wide(spark, sf), MODELS, cut=False))


def _subset_rows():
    rows = []
    for k in range(2, _NM + 1):
        for combo in combinations(range(_NM), k):
            rows.append((len(rows), [1 if i in combo else 0 for i in range(_NM)]))
    return rows


_SUBSETS = ", ".join(f"({sid}, {', '.join(map(str, mem))}, {sum(mem)})" for sid, mem in _subset_rows())


# -- N1: equal-weight subsets, Brier by Gram, exact metrics for the top-10 ---
@register("n1_equal_weight_top10", rsql(f"""WITH {WIDE},{_gram_sql()},
subs(subset_id, {", ".join(f"b{i}" for i in range(_NM))}, size) AS (VALUES {_SUBSETS}),
sc AS (SELECT CAST(subset_id AS BIGINT) AS subset_id,
         {", ".join(f"CAST(b{i} AS DOUBLE) / CAST(size AS DOUBLE) AS w_{m}" for i, m in enumerate(MODELS))},
         {_gram_brier_sql(lambda a: f"(CAST(b{a} AS DOUBLE) / CAST(size AS DOUBLE))")} AS brier_gram,
         'ENS[' || concat_ws('+', {", ".join(f"CASE WHEN b{i} = 1 THEN '{m}' END" for i, m in enumerate(MODELS))}) || ']' AS name
       FROM subs CROSS JOIN gm),
top AS (SELECT * FROM sc ORDER BY round(brier_gram, 12), subset_id LIMIT {EN.TOP_K_EQUAL}),
bl AS (SELECT top.subset_id, wide.y, {_blend_sql('top')} AS p FROM wide CROSS JOIN top),
{metrics_sql('bl', 'p', 'y', 'subset_id')}
SELECT top.*, met.n, met.brier, met.tn, met.fp, met.fn, met.tp, met.auc, met.pr_miss, met.ece10,
  row_number() OVER (ORDER BY round(top.brier_gram, 12), top.subset_id) AS rank
FROM top JOIN met ON top.subset_id = met.subset_id""",
                                        [f"w_{m}" for m in MODELS] + ["brier_gram"] + _MET))
def n1_equal(spark, sf):
    return round_doubles(EN.equal_weight_search(_wide(spark, sf), MODELS, cut=False))


# -- N6: diagnostics of the best weighted blend (E8 + E9 on the winner) ------
@register("n6_best_blend_profile", rsql(f"""WITH {WIDE},{_WEIGHTED_TOP},
best AS (SELECT * FROM top ORDER BY round(brier_gram, 12), weight_id LIMIT 1),
bl AS (SELECT wide.y, {_blend_sql('best')} AS p FROM wide CROSS JOIN best),
prof AS (SELECT y, count(*) AS count, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min,
  quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS p50,
  quantile_cont(p, 0.75) AS p75, quantile_cont(p, 0.9) AS p90, max(p) AS max FROM bl GROUP BY y),
thr AS (SELECT {", ".join(f"avg(CASE WHEN p < {D(t)} THEN {D(1)} ELSE {D(0)} END) AS frac_{int(t * 100)}" for t in M.MISS_THRESHOLDS)}
        FROM bl WHERE y = 0)
SELECT prof.*, {", ".join(f"thr.frac_{int(t * 100)}" for t in M.MISS_THRESHOLDS)} FROM prof CROSS JOIN thr""",
                                        ["mean", "std", "min", "p10", "p25", "p50", "p75", "p90", "max"]
                                        + [f"frac_{int(t * 100)}" for t in M.MISS_THRESHOLDS]))
def n6_best(spark, sf):
    wide = _wide(spark, sf)
    top = EN.weighted_search(wide, MODELS, cut=False)
    best = top.orderBy("rank").first().asDict()
    bl = EN.best_blend(wide, best, MODELS)
    prof = PR.class_profile(bl, "p_make", "y")
    fr = M.miss_threshold_fractions(bl, "p_make", "y")
    fr_wide = fr.groupBy().pivot("threshold", [float(t) for t in M.MISS_THRESHOLDS]).agg(F.first("frac"))
    fr_wide = fr_wide.select(*[F.col(f"`{float(t)}`").alias(f"frac_{int(t * 100)}")
                               for t in M.MISS_THRESHOLDS]).withColumn("_k", F.lit(0))
    out = prof.withColumn("_k", F.lit(0)).join(F.broadcast(fr_wide), "_k").drop("_k")
    return round_doubles(out)


# -- N4 + N5 + B2 + B3: fixed and normalised blends, make/miss, decision -----
@register("n4_n5_b2_b3_blends", rsql(f"""WITH {WIDE},
b AS (SELECT attempt_id,
  {" + ".join(f"{D(w)} * p_{m}" for m, w in SC.PRESENTATION_WEIGHTS.items())} AS p_fixed,
  greatest(least({" + ".join(f"{D(w / sum(SC.PRESENTATION_WEIGHTS.values()))} * p_{m}" for m, w in SC.PRESENTATION_WEIGHTS.items())}, {D(1 - 1e-6)}), {D(1e-6)}) AS p_norm
  FROM wide)
SELECT attempt_id, p_fixed, p_norm, {D(1)} - p_norm AS p_miss, CAST(p_norm >= {D(0.5)} AS INTEGER) AS pred_make FROM b""",
                                     ["p_fixed", "p_norm", "p_miss"]))
def n4_n5(spark, sf):
    wide = B.wide_predictions(spark, sf)
    out = wide.select("attempt_id", SC.fixed_blend(SC.PRESENTATION_WEIGHTS).alias("p_fixed"),
                      SC.normalised_blend(SC.PRESENTATION_WEIGHTS).alias("p_norm"))
    out = SC.make_miss(out, "p_norm")
    return round_doubles(out)
