"""Proper scoring rules and ranking metrics.

Input is a long prediction table: one row per (group..., attempt) with a
probability of the positive class (``p`` = P(make)) and a 0/1 label ``y``
(1 = make). All metrics are computed per group (``by``) in a handful of
aggregations; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probengine.functions.columns import DECISION_THRESHOLD, linspace_bin
from probengine.functions.curves import auc_ap_of, score_points

# Fixed values that must equal the reference's for equal results.
ECE_BINS = 10                              # ECE@10 on numpy.linspace(0, 1, 11), bins [lo, hi)
MISS_THRESHOLDS = (0.60, 0.70, 0.80, 0.90)  # share of misses with P(make) < t


def brier(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    return df.groupBy(*by).agg(
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def confusion(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
              threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """E5: tn, fp, fn, tp at ``p >= threshold``."""
    hat = F.col(p) >= F.lit(threshold)
    pos = F.col(y) == 1

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0)).cast("long")

    return df.groupBy(*by).agg(cnt(~hat & ~pos).alias("tn"), cnt(hat & ~pos).alias("fp"),
                               cnt(~hat & pos).alias("fn"), cnt(hat & pos).alias("tp"))


def reliability(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
                n_bins: int = ECE_BINS) -> DataFrame:
    """Per bin ``[lo, hi)`` the count, mean probability and mean label.
    ``p = 1.0`` falls in no bin (reference behaviour) and is not listed."""
    return (df.select(*by, p, y, linspace_bin(p, n_bins, closed_last=False).alias("bin"))
            .where(F.col("bin").isNotNull())
            .groupBy(*by, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"),
                 F.avg(F.col(y).cast("double")).alias("mean_y")))


def ece(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = (),
        n_bins: int = ECE_BINS) -> DataFrame:
    """Sum over bins of n_bin / N * |mean_p - mean_y|; N counts every row,
    including rows in no bin (p = 1.0)."""
    binned = df.select(*by, p, y, linspace_bin(p, n_bins, closed_last=False).alias("bin"))
    per_bin = (binned.groupBy(*by, "bin")
               .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"),
                    F.avg(F.col(y).cast("double")).alias("my")))
    return per_bin.groupBy(*by).agg(
        (F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mp") - F.col("my")))
               .otherwise(F.lit(0.0)))
         / F.sum("n")).alias("ece10"))


def metrics(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """The all-in-one record per group — Brier, AUC, PR-AUC of misses,
    ECE@10 and the confusion counts at 0.5.

    One pass over the rows makes the distinct scores with their label counts
    (``score_points``, written); every figure is a sum over these."""
    by = list(by)
    if not by:
        return metrics(df.withColumn("_g", F.lit(0)), p, y, ["_g"]).drop("_g")
    points = score_points(df, p, y, by)
    hat = F.col("s") >= F.lit(DECISION_THRESHOLD)

    def cnt(c, n):
        return F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")

    labelled = F.col("n_pos") + F.col("n_neg")
    bins = (points.withColumn("_bin", linspace_bin("s", ECE_BINS, closed_last=False))
            .groupBy(*by, "_bin").agg(
                F.sum("n").alias("_n"), F.sum(labelled).alias("_l"),
                F.sum(F.col("n_pos") * F.pow(F.col("s") - 1, 2) + F.col("n_neg") * F.pow(F.col("s"), 2)).alias("_se"),
                (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("_mp"),
                F.try_divide(F.sum("n_pos").cast("double"), F.sum(labelled)).alias("_my"),
                cnt(~hat, "n_neg").alias("tn"), cnt(hat, "n_neg").alias("fp"),
                cnt(~hat, "n_pos").alias("fn"), cnt(hat, "n_pos").alias("tp")))
    base = bins.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.try_divide(F.sum("_se"), F.sum("_l")).alias("brier"),
        F.sum("tn").alias("tn"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum("tp").alias("tp"),
        (F.sum(F.when(F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_mp") - F.col("_my")))
               .otherwise(F.lit(0.0))) / F.sum("_n")).alias("ece10"))
    ranks = auc_ap_of(points, by)
    return base.join(ranks, by, "left").select(*by, "n", "brier", "tn", "fp", "fn", "tp", "auc",
                                               "pr_miss", "ece10")


def miss_threshold_fractions(df: DataFrame, p: str = "p", y: str = "y",
                             by: Sequence[str] = (),
                             thresholds: Sequence[float] = MISS_THRESHOLDS) -> DataFrame:
    """Among true misses, the share with P(make) < t, one row per
    threshold (thresholds are a literal array exploded per row of the
    aggregate, not per input row)."""
    cols = [F.avg(F.when(F.col(p) < F.lit(t), 1.0).otherwise(0.0)).alias(f"t{i}")
            for i, t in enumerate(thresholds)]
    agg = df.where(F.col(y) == 0).groupBy(*by).agg(*cols)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("frac"))
                      for i, t in enumerate(thresholds)])
    return agg.select(*by, F.inline(pairs))
