"""Descriptive profiles.

Each profile is one or two grouped aggregations; label lists (bucket names,
histogram bins, curve points) are literal tables whose size is fixed by
parameters, joined so that empty buckets still appear with 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probengine.functions.curves import score_curve, score_points
from probengine.functions.columns import linspace_bin
from probengine.operators.lookups import literal_table

# Fixed values that must equal the reference's for equal results.
DISTANCE_EDGES = (0, 29, 39, 49, 100)          # pandas.cut, right-closed
DISTANCE_LABELS = ("0–29", "30–39", "40–49", "50+")
HIST_EDGES = (10, 80)                           # range(10, 80): 1-yard bins, last closed
PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
PROB_HIST_BINS = 100                            # numpy.linspace(0, 1, 101)
CURVE_POINTS = 500                              # numpy.linspace(0, 1, 500)
MIN_STD = 1e-6


def global_stats_aggs(cols: Sequence[str]) -> list:
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return aggs


def global_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1 + A2: count, mean, sample std (ddof=1), min, max in one pass."""
    return df.agg(*global_stats_aggs(cols))


def flag_rate_aggs(flag_col: str) -> list:
    return [F.avg(flag_col).alias("rate"), F.sum(flag_col).cast("long").alias("total")]


def flag_rate(df: DataFrame, flag_col: str, by: Sequence[str] = ()) -> DataFrame:
    """A3: mean and total of a 0/1 column."""
    return df.groupBy(*by).agg(*flag_rate_aggs(flag_col))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A4: counts per value including NULL, and % of all rows. The total is
    a one-row aggregate of the counts table, broadcast back (the counts table
    itself can be as large as the number of distinct values)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_t")).withColumn("_k", F.lit(0))
    return (counts.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")
            .select(col, "count", (F.col("count") * F.lit(100.0) / F.col("_t")).alias("pct")))


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """A5: number of distinct non-null values (``approx`` = HyperLogLog++)."""
    f = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[f(c).alias(f"{c}_nunique") for c in cols])


def distance_bucket(col: str, edges=DISTANCE_EDGES, labels=DISTANCE_LABELS):
    """``pandas.cut(right=True)``: (lo, hi]; the lowest edge itself and values
    beyond the last edge fall in no bucket."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (F.col(col) > F.lit(lo)) & (F.col(col) <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def bucket_profile(df: DataFrame, col: str, y: str, spark: SparkSession,
                   edges=DISTANCE_EDGES, labels=DISTANCE_LABELS) -> DataFrame:
    """A6 + A7: per bucket the count, % of *all* rows, and the mean of ``y``
    (NULL for an empty bucket). Every label is listed."""
    b = df.select(distance_bucket(col, edges, labels).alias("bucket"), F.col(y))
    # at most len(labels) + 1 rows (the NULL bucket counts in the total)
    agg = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"),
                                  F.avg(F.col(y).cast("double")).alias("rate"))
    lab = literal_table(spark, [(i, l) for i, l in enumerate(labels)], "ord int, bucket string")
    total = agg.agg(F.sum("count").alias("_t")).withColumn("_k", F.lit(0))
    out = (F.broadcast(lab).withColumn("_k", F.lit(0))
           .join(agg.where(F.col("bucket").isNotNull()).drop("_t"), "bucket", "left")
           .join(F.broadcast(total), "_k", "left"))
    return out.select("ord", "bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                      (F.coalesce("count", F.lit(0)) * F.lit(100.0) / F.col("_t")).alias("pct"),
                      "rate")


def unit_histogram(df: DataFrame, col: str, spark: SparkSession, lo: int = HIST_EDGES[0],
                   hi: int = HIST_EDGES[1]) -> DataFrame:
    """Bins [k, k+1) for k in lo..hi-2 (edges ``range(lo, hi)``), the last
    bin closed; values outside are dropped. Empty bins appear with 0."""
    x = F.col(col)
    last_edge = hi - 1
    b = F.when((x >= lo) & (x < last_edge), F.floor(x)).when(x == last_edge, F.lit(last_edge - 1))
    agg = df.select(b.cast("int").alias("bin")).where(F.col("bin").isNotNull()) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    bins = spark.range(lo, last_edge).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(bins).join(agg, "bin", "left")
            .select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def grouped_rate(df: DataFrame, key: str, flag_col: str) -> DataFrame:
    """Mean and count of a 0/1 column per group."""
    return df.groupBy(key).agg(F.avg(F.col(flag_col).cast("double")).alias("mean"),
                               F.count(F.lit(1)).alias("count"))


def percentiles(points: DataFrame, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation percentiles per group, from ``score_points``
    made with a constant label: the running counts tell which value stands at
    rank floor((n - 1) q) and at the next one, so no group's values ever meet
    in one task. Columns ``*by, q0, q1, ...``."""
    cur = score_curve(points, by)
    totals = points.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("n_pos").alias("_n"))
    same = F.lit(True)
    for c in by:
        same = same & cur[c].eqNullSafe(totals[f"_t_{c}"])
    first, last = F.col("pos_below"), F.col("pos_below") + F.col("n_pos") - 1
    picks = []
    for i, q in enumerate(qs):
        h = (F.col("_n") - 1) * F.lit(float(q))
        picks += [F.max(F.when((first <= F.floor(h)) & (F.floor(h) <= last), F.col("s"))).alias(f"_lo{i}"),
                  F.max(F.when((first <= F.ceil(h)) & (F.ceil(h) <= last), F.col("s"))).alias(f"_hi{i}"),
                  F.max(h - F.floor(h)).alias(f"_f{i}")]
    found = cur.join(totals, same).groupBy(*by).agg(*picks)
    return found.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
                               for i in range(len(qs))])


def class_profile(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """E8 (A10, A11): per group and true class: count, mean, population std,
    min, p10/25/50/75/90 (numpy's linear interpolation), max. One pass over
    the rows makes the distinct values; rows without a value count only."""
    keys = [*by, y]
    points = score_points(df.select(*keys, p), F.col(p), F.when(F.col(p).isNotNull(), F.lit(1)), keys)
    known = points.where("s IS NOT NULL")
    # moments around the group's own mean; the two small tables have a row per group and class
    means = points.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.sum("n_pos").alias("_n"), F.try_divide(F.sum(F.col("n_pos") * F.col("s")), F.sum("n_pos")).alias("mean"),
        F.min("s").alias("min"), F.max("s").alias("max"))
    named = means.select(*[F.col(c).alias(f"_m_{c}") for c in keys], "mean")
    same = F.lit(True)
    for c in keys:
        same = same & known[c].eqNullSafe(named[f"_m_{c}"])
    spread = (known.join(named, same).groupBy(*keys)
              .agg(F.sqrt(F.sum(F.col("n_pos") * F.pow(F.col("s") - F.col("mean"), 2)) / F.sum("n_pos")).alias("std")))
    ranks = percentiles(known, keys, PERCENTILES)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
        on = F.lit(True)
        for c in keys:
            on = on & left[c].eqNullSafe(right[f"_r_{c}"])
        return left.join(right, on, "left").drop(*[f"_r_{c}" for c in keys])

    out = beside(beside(means, spread), ranks)
    return out.select(*keys, "count", "mean", "std", "min",
                      *[F.col(f"q{i}").alias(f"p{int(round(x * 100))}") for i, x in enumerate(PERCENTILES)], "max")


def probability_histogram(df: DataFrame, p: str, y: str, by: Sequence[str] = (),
                          n_bins: int = PROB_HIST_BINS) -> DataFrame:
    """Counts per (group, class, bin) on ``linspace(0, 1, n_bins + 1)``,
    last bin closed; only non-empty bins are listed."""
    return (df.select(*by, y, linspace_bin(p, n_bins, closed_last=True).alias("bin"))
            .where(F.col("bin").isNotNull())
            .groupBy(*by, y, "bin").agg(F.count(F.lit(1)).alias("count")))


def normal_curves(moments: DataFrame, by: Sequence[str], y: str, spark: SparkSession,
                  n_points: int = CURVE_POINTS) -> DataFrame:
    """E11 + W5: normal pdf(mean, max(std, 1e-6)) on ``linspace(0, 1, n)`` for
    every (group, class) moment row, then divided by the maximum over both
    class curves of the group. Rows = groups x classes x n (parameters)."""
    i = F.col("i")
    sd = F.greatest(F.col("std"), F.lit(MIN_STD))
    # one literal sequence per moment row (groups x classes, bounded by the model list)
    curves = (moments.select(*by, y, "mean", "std")
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
              .withColumn("x", F.when(i == n_points - 1, F.lit(1.0))
                          .otherwise(i * F.lit(1.0 / (n_points - 1)))))
    pdf = (F.lit(1.0) / (sd * F.sqrt(F.lit(2.0 * 3.141592653589793)))
           * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col("mean")) / sd, 2)))
    curves = curves.withColumn("density", pdf)
    peak = F.max("density").over(Window.partitionBy(*by))
    return curves.withColumn("density_norm", F.when(peak > 0, F.col("density") / peak)
                             .otherwise(F.col("density"))).select(*by, y, "i", "x", "density_norm")


def dimension_profile(df: DataFrame, dims: Sequence[str], y: str) -> DataFrame:
    """A4 + A7 for several dimensions in one pass: a GROUPING SETS
    aggregation (one set per dimension) gives, per (dimension, value), the
    count, its % of all rows and the mean of ``y``. NULL values are their
    own group; ``grouping_id`` tells which dimension a row belongs to."""
    sets = [[d] for d in dims]
    agg = df.groupingSets(sets, *dims).agg(
        F.grouping_id(*dims).alias("_gid"), F.count(F.lit(1)).alias("count"),
        F.avg(F.col(y).cast("double")).alias("rate"))
    n = len(dims)
    # grouping_id has a 1 bit for every dimension *not* in the set
    name = None
    value = None
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        cond = F.col("_gid") == F.lit(gid)
        name = F.when(cond, F.lit(d)) if name is None else name.when(cond, F.lit(d))
        v = F.col(d).cast("string")
        value = F.when(cond, v) if value is None else value.when(cond, v)
    out = agg.select(name.alias("dimension"), value.alias("value"), "count", "rate")
    # any one dimension's groups add up to all rows: no second scan of df
    total = (out.where(F.col("dimension") == F.lit(dims[0])).agg(F.sum("count").alias("_t"))
             .withColumn("_k", F.lit(0)))
    return (out.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")
            .select("dimension", "value", "count",
                    (F.col("count") * F.lit(100.0) / F.col("_t")).alias("pct"), "rate"))
