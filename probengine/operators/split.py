"""Temporal holdout split (P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_season(df: DataFrame, season: str = "season") -> int:
    """One scalar to the driver; as a literal it lets the test-set filter
    prune ``season`` partitions of a partitioned table at planning time."""
    return int(df.agg(F.max(season)).first()[0])


def holdout_split(df: DataFrame, season: str = "season", fixed_year: int | None = None,
                  out: str = "split") -> DataFrame:
    """Latest-season variant: test = rows of max(season), train = earlier.
    Fixed-year variant: train = season < year when the year is present, else
    every row is train (and there is no test)."""
    if fixed_year is None:
        last = latest_season(df, season)
        return df.withColumn(out, F.when(F.col(season) == last, "test")
                             .when(F.col(season) < last, "train"))
    present = df.where(F.col(season) == fixed_year).limit(1).count() > 0
    if not present:
        return df.withColumn(out, F.lit("train"))
    return df.withColumn(out, F.when(F.col(season) < fixed_year, "train").otherwise("test"))


def train_test(df: DataFrame, season: str = "season") -> tuple[DataFrame, DataFrame, int]:
    last = latest_season(df, season)
    return df.where(F.col(season) < last), df.where(F.col(season) == last), last
