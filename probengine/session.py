"""Session and lineage helpers.

``get_spark`` is for tests, the bench and the command line; library operators
never build a session themselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "probengine", cpus: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only under a local master (tests) do we create
    one where it is unset, under the system temp folder; a cluster must name
    one."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="probengine-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, reread.

    For a table that several branches read: it is computed once, a lost
    executor rereads it, and unlike a row checkpoint it keeps column pruning
    and filter pushdown (and partition pruning on ``partition_by``)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """For a table that several jobs read (the cleaned table before split,
    encodings and fits; inputs of iterative fits): written once, without its
    order or partition count depending on a count of its rows."""
    return materialise(df)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``probengine`` importable in the Python workers (pandas UDFs,
    ``mapInPandas``, ``applyInPandas`` reference its functions). The package
    is zipped once per application on the driver and distributed with
    ``SparkContext.addPyFile`` — the usual way to ship Python code to
    executors, whatever the worker's working directory."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import probengine
    root = os.path.dirname(os.path.dirname(os.path.abspath(probengine.__file__)))
    staging = tempfile.mkdtemp(prefix="probengine-pkg-")   # driver-side upload staging only
    path = os.path.join(staging, "probengine.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "probengine")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
