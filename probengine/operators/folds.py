"""Folds, resampling weights and class weights.

All randomness is md5-derived from (seed, row key), so a recomputed
partition after an executor loss yields the same folds and weights, and
DuckDB can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probengine.functions.columns import hash_uniform

# Fixed values that must equal the reference's for equal results.
N_FOLDS = 5
SEED = 42


def stratified_folds(df: DataFrame, key: str, y: str, n_folds: int = N_FOLDS,
                     seed: int = SEED, out: str = "fold", n_buckets: int | None = None) -> DataFrame:
    """V1 — class-balanced folds: within each class, rows in md5 order are
    dealt round-robin to the folds (fold sizes per class differ by <= 1).

    The window is partitioned by class *and* by a hash bucket of the row, so
    no class ever sits in one task: ``n_buckets`` buckets per class, each
    dealt round-robin, starting at an offset that continues where the
    previous bucket stopped (offsets come from the per-bucket count table,
    classes x buckets rows). The bucket count only sets the parallelism —
    the folds are the same for any value — and defaults to four buckets per
    shuffle partition, so it grows with the cluster."""
    h = hash_uniform(f"fold{seed}", F.col(key))
    if n_buckets is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n_buckets = max(64, 4 * parts)
    tagged = df.withColumns({"_h": h, "_bk": F.floor(h * F.lit(float(n_buckets))).cast("int")})
    counts = tagged.groupBy(y, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    w_prev = Window.partitionBy(y).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(y).alias("_y"), F.col("_bk").alias("_ob"),
                            F.coalesce(F.sum("_c").over(w_prev), F.lit(0)).alias("_off"))
    w = Window.partitionBy(y, "_bk").orderBy("_h", key)
    numbered = tagged.withColumn("_rn", F.row_number().over(w) - 1)
    # null-safe: rows without a label are a class of their own, no row is lost
    out_df = (numbered.join(offsets, numbered[y].eqNullSafe(offsets["_y"]) & numbered["_bk"].eqNullSafe(offsets["_ob"]))
              .withColumn(out, ((F.col("_off") + F.col("_rn")) % n_folds).cast("int")))
    return out_df.drop("_h", "_bk", "_rn", "_off", "_y", "_ob")


def hash_folds(df: DataFrame, key: str, n_folds: int = N_FOLDS, seed: int = SEED,
               out: str = "fold") -> DataFrame:
    """V1 at scale without any window: fold = floor(u * k); balanced in
    expectation."""
    return df.withColumn(out, F.floor(hash_uniform(f"fold{seed}", F.col(key))
                                      * F.lit(float(n_folds))).cast("int"))


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until a double holds no difference to 1
    any more: no 52-bit uniform reaches further, so nothing is cut off."""
    cdf, term = [math.exp(-rate)], math.exp(-rate)
    while cdf[-1] < 1.0 - 2.0 ** -52:
        term *= rate / len(cdf)
        if cdf[-1] + term == cdf[-1]:
            break
        cdf.append(cdf[-1] + term)
    return cdf


def poisson_multiplicity(key: Column, replicate: Column, seed: int = SEED, rate: float = 1.0) -> Column:
    """V6 — bootstrap multiplicity of a row in one replicate, Poisson(1)
    by inverse CDF of a portable 52-bit uniform. Resampling n of n with replacement
    is Multinomial(n, 1/n) per row ~ Poisson(1): weights instead of copied
    rows, and nothing shuffles."""
    u = hash_uniform(f"boot{seed}", F.concat_ws("|", key.cast("string"), replicate.cast("string")), bits=52)
    cdf = poisson_cdf(rate)
    expr = F.when(u < F.lit(cdf[0]), F.lit(0))
    for k, c in enumerate(cdf[1:], 1):
        expr = expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(cdf))).cast("int")


def bootstrap_weights(df: DataFrame, key: str, n_replicates: int, seed: int = SEED,
                      weight: str | None = None) -> DataFrame:
    """V6 — one row per (row, replicate) with ``mult`` and ``w_boot`` =
    weight x multiplicity. Replicates are a literal sequence, so the number
    of output rows is rows x replicates (a parameter), like the reference's
    stacked resamples, without a shuffle."""
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))))
    out = out.withColumn("mult", poisson_multiplicity(F.col(key), F.col("replicate"), seed))
    w = F.col(weight) if weight else F.lit(1.0)
    return out.withColumn("w_boot", w * F.col("mult").cast("double"))


def balanced_weights(df: DataFrame, y: str, out: str = "w_balanced") -> DataFrame:
    """A13 — w_c = N / (2 n_c). The class table has one row per class
    (two), so it is broadcast with a proven bound."""
    cls = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    tot = F.sum("_nc").over(Window.partitionBy())
    cls = cls.select(y, (tot / (F.lit(2.0) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(cls), on=y, how="left")


def positive_class_weight(df: DataFrame, y: str) -> DataFrame:
    """A14 — max(1, negatives / max(1, positives)) as a one-row table."""
    pos = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(y) == 0, 1).otherwise(0))
    return df.agg(F.greatest(F.lit(1.0), neg / F.greatest(F.lit(1), pos)).alias("pos_weight"))
