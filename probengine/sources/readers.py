"""Sources (S1-S3) and the required-column contract."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class MissingColumnsError(ValueError):
    pass


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """S1. With an explicit schema no footer inference happens; column pruning
    and filter pushdown reach the scan through Catalyst."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S2. Header row, explicit schema (no ``inferSchema`` pass over the data)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_table(spark: SparkSession, base: str, schema: StructType | None = None,
               csv_schema: StructType | None = None) -> DataFrame:
    """S3. Prefer ``base.parquet``; on absence or a read error warn and read
    ``base.csv`` with the same schema. The schema/footer is forced inside the
    ``try`` so a corrupt or missing file is detected here, not mid-job."""
    pq = base if base.endswith(".parquet") else f"{base}.parquet"
    try:
        df = read_parquet(spark, pq, schema)
        df.schema  # resolves the relation: raises if the path is missing
        if schema is None:
            df.limit(0).collect()
        return df
    except Exception as exc:  # noqa: BLE001 - any read failure falls back
        csv = (base[: -len(".parquet")] if base.endswith(".parquet") else base) + ".csv"
        warnings.warn(f"failed to read {pq} ({type(exc).__name__}); falling back to {csv}")
        sch = csv_schema or schema
        if sch is None:
            raise
        return read_csv(spark, csv, sch)


def require_columns(df: DataFrame, required: Iterable[str],
                    aliases: Mapping[str, str] | None = None) -> DataFrame:
    """S9. Raise when any required column is missing. ``aliases`` maps an
    accepted misspelling to its required name and renames it first."""
    for wrong, right in (aliases or {}).items():
        if wrong in df.columns and right not in df.columns:
            df = df.withColumnRenamed(wrong, right)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df
