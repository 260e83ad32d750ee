"""Lookup joins.

Lookup tables in this domain are small dimension tables (a history sheet, a
venue list). When the caller *knows* the bound — a table built from a literal
mapping, whose row count is fixed by the code — it is broadcast explicitly.
For tables read from files or derived from data the size is unknown up
front, so no hint is given and AQE decides at runtime from the materialised
size (``spark.sql.adaptive.autoBroadcastJoinThreshold``), falling back to a
shuffle join beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LookupTable:
    """A dimension table plus what we know about its size."""

    def __init__(self, df: DataFrame, literal: bool = False):
        self.df = df
        self.literal = literal      # its rows are written in the code

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[tuple], schema: str):
        return cls(literal_table(spark, rows, schema), literal=True)

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.literal else self.df


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from literal rows, built inside Catalyst
    (``inline(array(struct(...)))``): no Python RDD, no Python worker.
    ``schema`` is a DDL string such as ``"a string, b int"``."""
    fields = [f.strip().split() for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(fields, r)]) for r in rows]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    return spark.range(1).select(F.inline(F.array(*structs)))


def _as_lookup(t: LookupTable | DataFrame) -> LookupTable:
    return t if isinstance(t, LookupTable) else LookupTable(t)


def left_lookup(df: DataFrame, lookup: LookupTable | DataFrame, on: Sequence[str],
                defaults: Mapping[str, object]) -> DataFrame:
    """Left equi-join, then NULL -> default for every looked-up
    column (a key absent from the lookup gets the default)."""
    lk = _as_lookup(lookup)
    cols = list(on) + list(defaults)
    out = df.join(lk.side().select(*cols), on=list(on), how="left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def masked_lookup(df: DataFrame, lookup: LookupTable | DataFrame, on: Sequence[str],
                  target: str, mask: Column, default: object) -> DataFrame:
    """Replace ``target`` from the lookup only on rows where ``mask`` holds;
    a masked row whose key is absent gets ``default``; unmasked rows keep
    their value even when the key is present."""
    lk = _as_lookup(lookup)
    val = f"_lk_{target}"
    side = lk.side().select(*on, F.col(target).alias(val))
    out = df.join(side, on=list(on), how="left")
    return out.withColumn(
        target,
        F.when(F.coalesce(mask, F.lit(False)), F.coalesce(F.col(val), F.lit(default)))
        .otherwise(F.col(target))).drop(val)


def encoding_lookup(df: DataFrame, enc: DataFrame, key: str, value: str,
                    prior: Column, by: Sequence[str] = ()) -> DataFrame:
    """``col.map(enc).fillna(prior)`` — left join the encoding table
    (size grows with the number of categories, so no hint), unseen -> prior."""
    keys = [*by, key]
    return (df.join(enc.select(*keys, F.col(value).alias("_enc")), on=keys, how="left")
              .withColumn(value, F.coalesce(F.col("_enc"), prior)).drop("_enc"))
