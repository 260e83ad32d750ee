"""Global cumulative counts over sorted scores, without a one-partition window.

Exact ROC AUC and average precision need, for every distinct score, the
number of positives and negatives at or below it. A plain
``Window.orderBy(score)`` moves every row into one task. Instead:

1. ``score_points`` aggregates rows to distinct ``(group, score)`` with label
   counts (partial aggregation happens map-side, so a hot score costs one
   row), range-partitions them by ``(group, score)`` and writes them with the
   number of their partition. Range bounds come from the scores themselves, so
   the blocks are even however the scores lie, and as the table is written the
   blocks are the same for every reader;
2. a window per ``(group, block)`` counts inside a block, of the size of one
   shuffle partition;
3. block totals (one row per group and block) get their exclusive running
   offsets from a window per group;
4. offset + in-block running count = global running count.

Scores are compared as they are: two scores tie only if they are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probengine.session import materialise


def score_points(df: DataFrame, score: Column | str, label: Column | str,
                 by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score ``s``: ``n`` (rows), ``n_pos``, ``n_neg`` and the
    block ``_blk``. Rows without a label count in ``n`` only. The one pass
    over the rows that all score metrics share."""
    sc = F.col(score) if isinstance(score, str) else score
    lb = F.col(label) if isinstance(label, str) else label
    by = list(by)
    pts = (df.select(*by, sc.cast("double").alias("s"), lb.cast("long").alias("_y"))
           .groupBy(*by, "s").agg(F.count(F.lit(1)).alias("n"),
                                  F.coalesce(F.sum("_y"), F.lit(0)).alias("n_pos"),
                                  F.coalesce(F.sum(1 - F.col("_y")), F.lit(0)).alias("n_neg")))
    return materialise(pts.repartitionByRange(*by, "s").withColumn("_blk", F.spark_partition_id()))


def score_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``score_points`` with the counts of positives / negatives strictly
    below each score (``pos_below``, ``neg_below``)."""
    by = list(by)
    prev = Window.unboundedPreceding
    prev_in_block = Window.partitionBy(*by, "_blk").orderBy("s").rowsBetween(prev, -1)
    inner = points.select(
        *by, "_blk", "s", "n_pos", "n_neg",
        F.coalesce(F.sum("n_pos").over(prev_in_block), F.lit(0)).alias("_ip"),
        F.coalesce(F.sum("n_neg").over(prev_in_block), F.lit(0)).alias("_in"))
    prev_blocks = Window.partitionBy(*by).orderBy("_blk").rowsBetween(prev, -1)
    keys = [F.col(c).alias(f"_o_{c}") for c in by]
    blocks = (points.groupBy(*by, "_blk")
              .agg(F.sum("n_pos").alias("_bp"), F.sum("n_neg").alias("_bn"))
              .select(*keys, F.col("_blk").alias("_ob"),
                      F.coalesce(F.sum("_bp").over(prev_blocks), F.lit(0)).alias("_op"),
                      F.coalesce(F.sum("_bn").over(prev_blocks), F.lit(0)).alias("_on")))
    same = inner["_blk"] == blocks["_ob"]
    for c in by:
        same = same & inner[c].eqNullSafe(blocks[f"_o_{c}"])
    return (inner.join(blocks, same)
            .select(*by, "s", "n_pos", "n_neg",
                    (F.col("_op") + F.col("_ip")).alias("pos_below"),
                    (F.col("_on") + F.col("_in")).alias("neg_below")))


def auc_ap_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact tie-aware ROC AUC for ``label = 1`` and the average precision of
    the *negatives* ranked by ``1 - score`` (the "PR-AUC for misses"), per
    group, from ``score_points``.

    AUC = sum n_pos * (neg_below + n_neg / 2) / (P * N)
    AP  = sum n_neg * (neg_at_or_below / all_at_or_below) / N
    """
    cur = score_curve(points, by).where("n_pos + n_neg > 0")
    n_at = (F.col("neg_below") + F.col("n_neg"))
    all_at = n_at + F.col("pos_below") + F.col("n_pos")
    # a group with a single class has no AUC / AP: NULL (ANSI-safe division)
    return (cur.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("n_pos") * (F.col("neg_below") + F.col("n_neg") / F.lit(2.0))),
                     (F.sum("n_pos") * F.sum("n_neg")).cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("n_neg") * (n_at / all_at)),
                     F.sum("n_neg").cast("double")).alias("pr_miss")))


def auc_ap(df: DataFrame, score: Column | str, label: Column | str,
           by: Sequence[str] = ()) -> DataFrame:
    """``auc_ap_of`` the points of ``df``."""
    return auc_ap_of(score_points(df, score, label, by), by)
