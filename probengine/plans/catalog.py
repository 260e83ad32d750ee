"""Registry of checked queries: name -> (Spark plan builder, DuckDB oracle SQL).

Every Spark builder takes ``(spark, sf_dir)`` and reads the driver's tables
(or data Spark derives from them) in full. Doubles in the outputs are rounded
to ``DIGITS`` places on both sides so the value hash does not depend on the
summation order of either engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6

SparkQuery = Callable[[SparkSession, str], DataFrame]

_SPARK: dict[str, SparkQuery] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: SparkQuery) -> SparkQuery:
        _SPARK[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def spark_queries() -> dict[str, SparkQuery]:
    _load()
    return dict(_SPARK)


def oracle_queries() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # importing the query modules fills the registry
    from probengine.plans import (  # noqa: F401
        q_calibrate,
        q_clean,
        q_ensemble,
        q_models,
        q_profile,
        q_sources,
        q_train,
    )


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = {c: F.round(F.col(c), digits) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cols) if cols else df


def rsql(inner: str, double_cols: list[str], digits: int = DIGITS) -> str:
    """Wrap oracle SQL so the listed DOUBLE columns are rounded like
    ``round_doubles`` does."""
    if not double_cols:
        return inner
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) _q"
