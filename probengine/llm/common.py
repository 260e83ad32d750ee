"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from probengine.session import ensure_checkpoint_dir, ship_package

#: Rows and bytes of one Arrow batch. Documents may be very long, so a batch
#: is bounded by bytes too; the values change memory only, never a result.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, reread.

    Cuts the lineage: a lost executor rereads the table. Columns and filters
    are still pruned, unlike with a row checkpoint."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def list_array(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per numpy array, without a Python object per element."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


class Memo(dict):
    """A worker's cache: missing keys are computed, long keys never stored,
    and at ``limit`` entries the cache goes back to the ``first`` ones, which
    bounds its memory and changes no value."""

    def __init__(self, compute, first: dict | None = None, limit: int = 1 << 19, longest: int = 64):
        super().__init__(first or {})
        self.compute, self.first, self.limit, self.longest = compute, first or {}, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.first)
            self[key] = value
        return value
