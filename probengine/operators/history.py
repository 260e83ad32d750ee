"""History-to-date features.

Career attempts / makes *before* each row, per actor, in time order, plus a
prior-history offset. Rows are range-partitioned by (actor, block, tie-breakers), so
neither an actor, nor one actor's day, nor the rows without an actor or a date sit in
one task; they are numbered inside their range, and the totals of the actor's earlier
ranges (at most one row per actor and range) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probengine.functions.columns import safe_ratio
from probengine.session import materialise


def career_to_date(df: DataFrame, actor: str, block: str, tiebreak: Sequence[str], y: str,
                   prior_attempts: str | None = None, prior_makes: str | None = None,
                   out_attempts: str = "career_attempts", out_makes: str = "career_makes",
                   out_rate: str = "career_fg_pct") -> DataFrame:
    """Attempts before this row (+ prior), W2: makes before this row
    (+ prior), W3: their zero-safe ratio. Order within an actor is
    ``(block, *tiebreak)``; the tie-breakers make it deterministic. Every row
    is kept: a NULL actor is an actor, a NULL block comes before all others."""
    prev = Window.unboundedPreceding
    # written once, so that the ranges are the same for the totals and the result
    rows = materialise(df.repartitionByRange(actor, block, *tiebreak).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(actor, "_range").orderBy(block, *tiebreak)
    rows = rows.withColumns({"_in_n": F.row_number().over(inside) - 1,
                             "_in_y": F.coalesce(F.sum(y).over(inside.rowsBetween(prev, -1)), F.lit(0))})
    ranges = (rows.groupBy(F.col(actor).alias("_actor"), F.col("_range").alias("_at"))
              .agg(F.count(F.lit(1)).alias("_bn"), F.sum(y).alias("_by")))
    before = Window.partitionBy("_actor").orderBy("_at").rowsBetween(prev, -1)
    ranges = ranges.select("_actor", "_at", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off_n"),
                           F.coalesce(F.sum("_by").over(before), F.lit(0)).alias("_off_y"))
    # null-safe: rows without an actor are those of one actor
    out = rows.join(ranges, rows[actor].eqNullSafe(ranges["_actor"]) & (rows["_range"] == ranges["_at"]))
    pa = F.col(prior_attempts) if prior_attempts else F.lit(0)
    pm = F.col(prior_makes) if prior_makes else F.lit(0)
    att = (F.col("_off_n") + F.col("_in_n")).cast("double") + pa
    mk = (F.col("_off_y") + F.col("_in_y")).cast("double") + pm
    out = out.withColumns({out_attempts: att, out_makes: mk})
    out = out.withColumn(out_rate, safe_ratio(out_makes, out_attempts))
    return out.drop("_in_n", "_in_y", "_off_n", "_off_y", "_actor", "_at", "_range")
