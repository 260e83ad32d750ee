"""Search of the bootstrap-averaged logistic regression, all candidates x
folds x replicates together (V2-V6 for M3).

A candidate is a strength C and a penalty (L1 or L2). A replicate is a column of
Poisson(1) multiplicities (V6), the same draws for every candidate. Newton's
method runs for all models at once: a pass over the rows forms the products of
their standardised features once per fold and multiplies them by the weights
of all the fold's points in one matrix product. The models of a fold and
replicate share the loss and differ in strength and penalty only, so those
that lie together step from one evaluated point (``cv_frame.shared_points``):
the more rows, the fewer points. Rows weigh, as in the
reference, multiplicity x balanced weight of the resample x balanced weight of the
fold's training rows.

Objective per model (liblinear's: the bias is penalised like the others):

    C * sum_i s_i * logloss_i(beta) + penalty(beta)

An L2 step solves the Newton system, an L1 step minimises the quadratic model
plus the penalty by coordinate descent, for all models side by side. A step
that raises the objective is halved. A fold without both classes cannot be
fitted; its candidate scores 1.0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probengine.operators.folds import SEED, poisson_multiplicity
from probengine.operators.models.cv_frame import CLOSE, FoldFrame, fold_frame, shared_points, summed
from probengine.operators.models.linear import BOOTSTRAP_REPLICATES

# Fixed values that must equal the reference's for equal results.
LOG10_C_GRID = (-3.0, 1.0, 30)
PENALTIES = ["l1", "l2"]
N_CANDIDATES = 50
CRASH_SCORE = 1.0


def grid() -> dict[str, list]:
    return {"C": [float(c) for c in np.logspace(*LOG10_C_GRID)], "penalty": list(PENALTIES)}


def l1_step(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, tol: float = 1e-12, sweeps: int = 1000) -> np.ndarray:
    """The minimiser b of grad'(b - beta) + (b - beta)' hess (b - beta) / 2 +
    |b|_1 for every model (last axis), by cyclic coordinate descent."""
    new, d = beta.copy(), beta.shape[0]
    diagonal = np.maximum(np.einsum("iim->im", hess), 1e-12)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(d):
            slope = grad[j] + np.einsum("km,km->m", hess[j], new - beta)
            v = diagonal[j] * new[j] - slope
            v = np.sign(v) * np.maximum(np.abs(v) - 1.0, 0.0) / diagonal[j]
            moved = max(moved, float(np.max(np.abs(v - new[j]), initial=0.0)))
            new[j] = v
        if moved < tol:
            break
    return new


@dataclass
class BootstrapModel:
    """The replicates' mean probability as a native expression."""

    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    betas: np.ndarray                # (1 + features) x replicates

    def probability(self) -> Column:
        z = F.array(F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.sd, strict=True)])
        betas = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in self.betas.T])
        eta = lambda b: F.aggregate(F.zip_with(b, z, lambda v, x: v * x), F.lit(0.0), lambda a, x: a + x)
        total = F.aggregate(betas, F.lit(0.0), lambda a, b: a + F.lit(1.0) / (F.lit(1.0) + F.exp(-eta(b))))
        return total / F.lit(float(self.betas.shape[1]))

    def transform(self, df: DataFrame, out: str = "p_make") -> DataFrame:
        return df.withColumn(out, self.probability())


@dataclass
class CvBootstrap:
    candidates: list[dict]
    frame: FoldFrame
    models: dict[tuple[int, int], BootstrapModel]    # (candidate, fold); none where the fit failed
    briers: dict[tuple[int, int], float]
    passes: int

    def results(self) -> list[tuple[int, dict, float]]:
        folds = range(self.frame.n_folds)
        return [(ci, c, float(np.mean([self.briers[ci, f] for f in folds])) if all((ci, f) in self.models for f in folds) else CRASH_SCORE)
                for ci, c in enumerate(self.candidates)]

    def out_of_fold(self, ci: int, out: str = "p_make") -> DataFrame:
        """The frame's rows with P(make) by the candidate's model that did
        not see their fold."""
        return self.frame.scored_by_fold({f: self.models.get((ci, f)) for f in range(self.frame.n_folds)}, out)


def cv_bootstrap_batched(folded: DataFrame, features: Sequence[str], label: str, key: str, candidates: Sequence[dict],
                         category: str | None = None, fold: str = "fold", n_folds: int = 5, replicates: int = BOOTSTRAP_REPLICATES,
                         seed: int = SEED, max_iter: int = 100, tol: float = CLOSE, keep: Sequence[str] = ()) -> CvBootstrap:
    """``candidates``: dicts of ``C`` and ``penalty`` ("l1" or "l2")."""
    mult = [f"_m{b}" for b in range(replicates)]
    drawn = folded.withColumns({c: poisson_multiplicity(F.col(key), F.lit(b), seed).cast("double") for b, c in enumerate(mult)})
    frame = fold_frame(drawn, features, label, category, fold, n_folds, [*keep, *mult])
    columns, moments = frame.columns, frame.moments
    kinds = list(dict.fromkeys((float(c["C"]), str(c["penalty"])) for c in candidates))
    # models of a fold stand side by side: kind major, replicate minor
    of_rep = np.tile(np.arange(replicates), len(kinds))
    strength = np.repeat([c for c, _ in kinds], replicates)
    lasso = np.repeat([p == "l1" for _, p in kinds], replicates)
    n_models, d = len(of_rep), 1 + len(columns[0])
    upper = np.triu_indices(d)
    rows = frame.rows.select(*dict.fromkeys(c for cs in columns for c in cs), *mult, "_y", "_f")

    # class sizes of every resample, by fold
    per = {(r["_f"], r["_y"]): np.array([float(r[c]) for c in mult])
           for r in rows.groupBy("_f", "_y").agg(*[F.sum(c).alias(c) for c in mult]).collect()}       # two rows a fold
    weight = {}
    for f in range(n_folds):
        n = [sum((v for (g, y), v in per.items() if g != f and y == label_), np.zeros(replicates)) for label_ in (0.0, 1.0)]
        if (n[0] > 0).all() and (n[1] > 0).all() and np.isfinite(frame.class_weights(f)).all():
            weight[f] = [w * (n[0] + n[1]) / (2 * n[i]) for i, w in enumerate(frame.class_weights(f))]

    def standardised(pdf: pd.DataFrame, f: int) -> np.ndarray:
        mean, sd = moments[f]
        return np.hstack([np.ones((len(pdf), 1)), (pdf[columns[f]].to_numpy(dtype=float) - mean) / sd])

    beta = {f: np.zeros((d, n_models)) for f in sorted(weight)}
    before = {f: np.zeros((d, n_models)) for f in beta}
    least = {f: np.full(n_models, np.inf) for f in beta}
    moved = {f: np.zeros(n_models) for f in beta}
    open_models = {f: np.arange(n_models) for f in beta}
    seen: dict[tuple[int, int], np.ndarray] = {}          # (fold, replicate): the Hessian at its last point
    block = len(upper[0]) + d + 1
    passes = 0
    while open_models and passes < max_iter:
        passes += 1
        points, steps_from, now, total = {}, {}, {}, 0
        for f, ms in open_models.items():
            chosen, of = [], np.zeros(len(ms), dtype=np.int64)
            for r in range(replicates):
                mine = np.flatnonzero(of_rep[ms] == r)
                kept, near = shared_points(beta[f][:, ms[mine]].T, moved[f][ms[mine]], seen.get((f, r)))
                of[mine] = len(chosen) + near
                chosen += ms[mine][kept].tolist()
            points[f], steps_from[f] = np.array(chosen), of
            now[f] = total, beta[f][:, chosen], of_rep[chosen]
            total += block * len(chosen)

        def part(pdf: pd.DataFrame, now=now, total=total) -> np.ndarray:
            out = np.zeros(total)
            y_all, fold_of, reps = pdf["_y"].to_numpy(), pdf["_f"].to_numpy(), pdf[mult].to_numpy()
            for f, (o, b, drawn) in now.items():
                own = fold_of != f
                if not own.any():
                    continue
                x, y = standardised(pdf[own], f), y_all[own]
                s = (reps[own] * np.where((y == 1.0)[:, None], weight[f][1], weight[f][0]))[:, drawn]
                eta = x @ b
                mu = 1.0 / (1.0 + np.exp(-eta))
                sums = out[o:o + block * len(drawn)].reshape(block, -1)
                sums[:len(upper[0])] = (x[:, upper[0]] * x[:, upper[1]]).T @ (s * mu * (1 - mu))
                sums[len(upper[0]):-1] = x.T @ (s * (mu - y[:, None]))
                sums[-1] = (s * (np.logaddexp(0.0, eta) - y[:, None] * eta)).sum(axis=0)
            return out

        got = summed(rows, part, total)
        still = {}
        for f, ms in open_models.items():
            o, at, drawn = now[f]
            sums = got[o:o + block * len(drawn)].reshape(block, -1)
            curve = np.zeros((d, d, len(drawn)))
            curve[upper] = sums[:len(upper[0])]
            curve[upper[1], upper[0]] = curve[upper]
            seen.update({(f, r): curve[:, :, j] for j, r in enumerate(drawn.tolist())})
            of, c, l1 = steps_from[f], strength[ms], lasso[ms]
            p, h = at[:, of], curve[:, :, of]
            size = np.where(l1, np.abs(p).sum(axis=0), 0.5 * (p * p).sum(axis=0))
            objective = c * sums[-1, of] + size
            worse = objective > least[f][ms] + 1e-10 * np.abs(least[f][ms])
            worse = worse[np.searchsorted(ms, points[f])][of]           # a point is judged by the model whose it is
            hess, grad = c * h, c * sums[len(upper[0]):-1, of]
            new = p.copy()
            ridge = ~l1
            if ridge.any():
                a = np.moveaxis(hess[:, :, ridge], 2, 0) + np.eye(d)
                new[:, ridge] -= np.linalg.solve(a, (grad[:, ridge] + p[:, ridge]).T[:, :, None])[:, :, 0].T
            if l1.any():
                new[:, l1] = l1_step(p[:, l1], grad[:, l1], hess[:, :, l1])
            step = np.sqrt(np.maximum(np.einsum("im,ijm,jm->m", new - p, h, new - p), 0.0) / np.maximum(h[0, 0], 1e-300))
            beta[f][:, ms] = np.where(worse, (p + before[f][:, ms]) / 2, new)
            before[f][:, ms] = np.where(worse, before[f][:, ms], p)
            least[f][ms] = np.where(worse, least[f][ms], objective)
            moved[f][ms] = np.where(worse, 0.0, step)          # after a halved step a model is evaluated at its own point
            if (worse | (step >= tol)).any():
                still[f] = ms[worse | (step >= tol)]
        open_models = still

    def errors(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((n_folds, len(kinds) + 1))
        y_all, fold_of = pdf["_y"].to_numpy(), pdf["_f"].to_numpy()
        for f in beta:
            own = fold_of == f
            if own.any():
                p = 1.0 / (1.0 + np.exp(-(standardised(pdf[own], f) @ beta[f])))
                p = p.reshape(len(p), len(kinds), replicates).mean(axis=2)
                out[f, :-1] = ((p - y_all[own][:, None]) ** 2).sum(axis=0)
                out[f, -1] = own.sum()
        return out.ravel()

    sums = summed(rows, errors, n_folds * (len(kinds) + 1)).reshape(n_folds, -1)
    of = {kind: k for k, kind in enumerate(kinds)}
    models, briers = {}, {}
    for ci, c in enumerate(candidates):
        k = of[float(c["C"]), str(c["penalty"])]
        for f in beta:
            models[ci, f] = BootstrapModel(columns[f], *moments[f], beta[f][:, k * replicates:(k + 1) * replicates])
            briers[ci, f] = float(sums[f, k] / max(sums[f, -1], 1.0))
    return CvBootstrap(list(candidates), frame, models, briers, passes)


def fit_bootstrap(train: DataFrame, features: Sequence[str], label: str, key: str, C: float, penalty: str,
                  replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> BootstrapModel:
    """The refit on all rows, by the same passes: a search of one candidate
    whose only fold holds no row."""
    alone = train.withColumn("_all", F.lit(-1))
    return cv_bootstrap_batched(alone, features, label, key, [{"C": C, "penalty": penalty}], None, "_all", 1, replicates, seed).models[0, 0]
