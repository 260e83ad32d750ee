"""Feature encoding.

Encoding tables have one row per category (grows with the data), so they are
joined back without a broadcast hint; AQE broadcasts them at runtime when
they turn out small. The only values sent to the driver are global scalars
(the prior miss rate, the per-fold priors, means and standard deviations).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probengine.session import materialise
# Fixed values that must equal the reference's for equal results.
SMOOTHING = 20.0   # smoothed target encoding strength
UNSEEN_ORDINAL = -1


def _miss(y_make: str) -> Column:
    return (F.lit(1) - F.col(y_make)).cast("double")


def target_stats(df: DataFrame, key: str, y_make: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-category count and miss count (map-side partial aggregation)."""
    return df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(_miss(y_make)).alias("misses"))


def smoothed(n: Column, misses: Column, prior: Column, smoothing: float = SMOOTHING) -> Column:
    """(n * mean + s * prior) / (n + s), with mean = misses / n (computed as
    the reference does, product of count and mean)."""
    return (n * (misses / n) + F.lit(smoothing) * prior) / (n + F.lit(smoothing))


def global_prior(df: DataFrame, y_make: str) -> float:
    """Miss rate of the training rows: a single scalar reaches the driver."""
    row = df.agg(F.avg(_miss(y_make)).alias("prior")).first()
    return float(row["prior"]) if row["prior"] is not None else 0.0


def fit_target_encoding(train: DataFrame, key: str, y_make: str,
                        smoothing: float = SMOOTHING) -> tuple[DataFrame, float]:
    """F1 fit: ``(key, enc)`` table and the prior. Always encodes the *miss*
    rate, whatever label polarity the model later uses."""
    prior = global_prior(train, y_make)
    enc = (target_stats(train, key, y_make)
           .select(key, smoothed(F.col("n"), F.col("misses"), F.lit(prior), smoothing).alias("enc")))
    return enc, prior


def apply_target_encoding(df: DataFrame, enc: DataFrame, prior: float, key: str,
                          out: str = "kicker_te") -> DataFrame:
    """F1 apply / J5: left join, unseen category -> prior."""
    return (df.join(enc.withColumnRenamed("enc", "_enc"), on=key, how="left")
              .withColumn(out, F.coalesce(F.col("_enc"), F.lit(prior))).drop("_enc"))


def target_encode(train: DataFrame, apply_to: DataFrame, key: str, y_make: str,
                  out: str = "kicker_te", smoothing: float = SMOOTHING) -> DataFrame:
    enc, prior = fit_target_encoding(train, key, y_make, smoothing)
    return apply_target_encoding(apply_to, enc, prior, key, out)


def oof_target_encode(df: DataFrame, key: str, y_make: str, fold: str = "fold",
                      out: str = "kicker_te", smoothing: float = SMOOTHING) -> DataFrame:
    """F2 in one pass: every row gets the encoding learned on the *other*
    folds (its fold's training part). Per-(key, fold) sums and per-key totals
    are aggregated once; ``total - own fold`` is the training part. No loop
    over folds, no re-scan per fold."""
    kf = target_stats(df, key, y_make, by=[fold])
    k_tot = kf.groupBy(key).agg(F.sum("n").alias("kn"), F.sum("misses").alias("km"))
    f_tot = kf.groupBy(fold).agg(F.sum("n").alias("fn"), F.sum("misses").alias("fm"))
    # one row per fold (bounded by the number of folds): the fold's train prior
    tot = f_tot.agg(F.sum("fn").alias("_an"), F.sum("fm").alias("_am")).withColumn("_k", F.lit(0))
    f_prior = (f_tot.withColumn("_k", F.lit(0)).join(F.broadcast(tot), "_k")
               .select(fold, F.try_divide(F.col("_am") - F.col("fm"),
                                          (F.col("_an") - F.col("fn")).cast("double")).alias("_prior")))
    enc = (kf.join(k_tot, key)
             .join(F.broadcast(f_prior), fold)
             .select(key, fold, "_prior",
                     F.when(F.col("kn") - F.col("n") > 0,
                            smoothed(F.col("kn") - F.col("n"), F.col("km") - F.col("misses"),
                                     F.col("_prior"), smoothing)).alias("_enc")))
    return (df.join(enc.drop("_prior"), on=[key, fold], how="left")
              .join(F.broadcast(f_prior), on=fold, how="left")
              .withColumn(out, F.coalesce(F.col("_enc"), F.col("_prior")))
              .drop("_enc", "_prior"))


def fit_ordinal(train: DataFrame, key: str, n_ranges: int | None = None) -> DataFrame:
    """W4 fit: sorted distinct values -> 0..k-1 (``OrdinalEncoder``).

    A dense rank needs a global order, but never in one task: the distinct
    values are range-partitioned (sampled bounds), numbered inside each range
    partition by a window on the partition id, and shifted by the counts of
    the lower partitions (a table of ``n_ranges`` rows)."""
    spark = train.sparkSession
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = train.select(key).where(F.col(key).isNotNull()).distinct()
    # written once: the counts and the numbers see the same ranges
    ranged = materialise(distinct.repartitionByRange(n, key).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_pid", F.coalesce(
        F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(key)) - 1)
    return (numbered.join(F.broadcast(offsets), "_pid")
            .select(key, (F.col("_off") + F.col("_rn")).cast("long").alias("ordinal")))


def apply_ordinal(df: DataFrame, mapping: DataFrame, key: str, out: str = "kicker_id") -> DataFrame:
    """W4 apply: unseen -> -1."""
    return (df.join(mapping.withColumnRenamed("ordinal", "_ord"), on=key, how="left")
              .withColumn(out, F.coalesce(F.col("_ord"), F.lit(UNSEEN_ORDINAL)).cast("long"))
              .drop("_ord"))


def fit_standardiser(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """F4 fit: mean and *population* std per column, one aggregate pass; the
    result is 2 x features scalars."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols}


def apply_standardiser(df: DataFrame, stats: dict[str, tuple[float, float]],
                       suffix: str = "") -> DataFrame:
    """F4 apply: (x - mean) / std; zero variance -> 0 (sklearn keeps scale 1
    and the centred value is 0 for a constant training column)."""
    out = {}
    for c, (m, s) in stats.items():
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0)
    return df.withColumns(out)
