"""Small tables with the awkward rows that every operator must stand."""

from pyspark.sql import DataFrame, SparkSession

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(spark: SparkSession, texts: list) -> DataFrame:
    """Documents 1, 2, ... with the given texts."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, DOC)


def save(spark: SparkSession, folder, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
