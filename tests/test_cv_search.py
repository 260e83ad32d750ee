"""The batched searches give what separate fits of their candidates give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probengine.operators.folds import balanced_weights, poisson_multiplicity
from probengine.operators.models import cv_bootstrap as CB
from probengine.operators.models import cv_gam as CG
from probengine.operators.models import gam as G
from probengine.operators.models import search as S


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(8)
    d, z = rng.integers(18, 60, 900), rng.normal(size=900)
    y = rng.random(900) < 1 / (1 + np.exp((d - 45) / 6 - z))
    rows = [(i, float(a), float(b), int(c), i % 3, f"k{i % 7}") for i, (a, b, c) in enumerate(zip(d, z, y))]
    return spark.createDataFrame(rows, "id long, kick_distance double, z double, y int, fold int, who string").cache()


FEATS = ["kick_distance", "z"]


def test_gam_search_equals_separate_fits(folded):
    cands = [{"lam": 1.0, "n_splines": 8}, {"lam": 30.0, "n_splines": 12}, {"lam": 1.0, "n_splines": 8}]
    cv = CG.cv_gam_batched(folded, FEATS, "y", cands, n_folds=3, keep=["id"])
    oof = {r["id"]: r["p"] for r in cv.out_of_fold(1, "p").collect()}
    assert len(oof) == 900
    for ci, c in enumerate(cands[:2]):
        scores = []
        for f in range(3):
            train, valid = balanced_weights(folded.where(F.col("fold") != f), "y"), folded.where(F.col("fold") == f)
            m = G.fit_gam(train, FEATS, "y", weight="w_balanced", lam=c["lam"], n_basis=c["n_splines"], max_iter=CG.MAX_ITER)
            assert np.allclose(m.beta, cv.models[ci, f].beta, atol=1e-6)
            scored = m.transform(valid)
            scores.append(S.brier_of(scored, "p_make", "y"))
            if ci == 1:
                assert all(abs(r["p_make"] - oof[r["id"]]) < 1e-8 for r in scored.collect())
        assert cv.results()[ci][2] == pytest.approx(np.mean(scores), abs=1e-9)
    assert cv.results()[2][2] == cv.results()[0][2]


def test_fold_without_a_class_scores_one(folded):
    only = folded.withColumn("y", F.when(F.col("fold") == 0, F.col("y")).otherwise(F.lit(1)))
    cv = CG.cv_gam_batched(only, FEATS, "y", [{"lam": 1.0, "n_splines": 8}], n_folds=3)
    assert cv.results()[0][2] == 1.0
    # the model without fold 0 sees one class only: constant 0.5 (M8)
    p = {(r["_f"], r["p"]) for r in cv.out_of_fold(0, "p").collect() if r["_f"] == 0}
    assert p == {(0, 0.5)}
    cb = CB.cv_bootstrap_batched(only, FEATS, "y", "id", [{"C": 1.0, "penalty": "l1"}], n_folds=3)
    assert cb.results()[0][2] == 1.0


def test_encodings_come_from_the_other_folds(folded):
    other = folded.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    runs = []
    for df in (folded, other):
        cv = CB.cv_bootstrap_batched(df, FEATS, "y", "id", [{"C": 0.1, "penalty": "l2"}], category="who", n_folds=3, replicates=3, keep=["id"])
        runs.append({r["id"]: (r["_f"], r["p"]) for r in cv.out_of_fold(0, "p").collect()})
    a, b = runs
    assert all(abs(a[i][1] - b[i][1]) < 1e-9 for i in a if a[i][0] == 1)
    assert any(abs(a[i][1] - b[i][1]) > 1e-6 for i in a if a[i][0] != 1)


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_bootstrap_models_are_at_their_optimum(folded, penalty):
    cands = [{"C": c, "penalty": penalty} for c in (0.003, 0.5, 10.0)]
    cv = CB.cv_bootstrap_batched(folded, FEATS, "y", "id", cands, n_folds=3, replicates=4)
    mults = [poisson_multiplicity(F.col("id"), F.lit(b)).alias(f"m{b}") for b in range(4)]
    rows = folded.select("*", *mults).toPandas()
    for ci, c in enumerate(cands):
        scores = []
        for f in range(3):
            tr, va = rows[rows.fold != f], rows[rows.fold == f]
            mean, sd = tr[FEATS].mean().to_numpy(), tr[FEATS].std(ddof=0).to_numpy()
            x = np.hstack([np.ones((len(tr), 1)), (tr[FEATS].to_numpy() - mean) / sd])
            y, n = tr.y.to_numpy(), len(tr)
            balanced = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
            model = cv.models[ci, f]
            assert np.allclose(model.mean, mean) and np.allclose(model.sd, sd)
            for b in range(4):
                m, beta = tr[f"m{b}"].to_numpy(), model.betas[:, b]
                n1, n0 = m[y == 1].sum(), m[y == 0].sum()
                s = m * balanced * np.where(y == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))
                grad = c["C"] * (x.T @ (s * (1 / (1 + np.exp(-(x @ beta))) - y)))
                if penalty == "l2":
                    assert np.abs(grad + beta).max() < 1e-5
                else:
                    assert np.abs(grad[beta != 0] + np.sign(beta[beta != 0])).max(initial=0) < 1e-5
                    assert np.abs(grad[beta == 0]).max(initial=0) <= 1 + 1e-6
            v = np.hstack([np.ones((len(va), 1)), (va[FEATS].to_numpy() - mean) / sd])
            p = (1 / (1 + np.exp(-(v @ model.betas)))).mean(axis=1)
            scores.append(np.mean((p - va.y.to_numpy()) ** 2))
        assert cv.results()[ci][2] == pytest.approx(np.mean(scores), abs=1e-9)
    if penalty == "l1":
        assert (cv.models[0, 0].betas == 0).any()


def test_refit_is_the_fit_on_all_rows(folded):
    m = CB.fit_bootstrap(folded, FEATS, "y", "id", 0.5, "l2", replicates=3)
    cv = CB.cv_bootstrap_batched(folded.withColumn("other", F.lit(7)), FEATS, "y", "id", [{"C": 0.5, "penalty": "l2"}], None, "other", 1, 3)
    assert np.allclose(m.betas, cv.models[0, 0].betas, atol=1e-9)
    out = m.transform(folded).collect()
    assert len(out) == 900 and all(0 < r.p_make < 1 for r in out)
