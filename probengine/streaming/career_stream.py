"""Streaming form of entry point A.

The cleaning expressions and lookup joins are stateless, so they run
unchanged on a streaming DataFrame (stream-static joins against the
dimension tables). Career-to-date counts (W1-W3) need keyed state: the
attempts and makes of every actor seen so far live in
``applyInPandasWithState``; each micro-batch's rows of an actor are ordered by
(date, play) and numbered on top of the stored totals. Events are assumed to
arrive in time order per actor across micro-batches (within a micro-batch any
order is fine). A group costs Python milliseconds whatever its size, so the
state's key is a hash bucket of actors, not an actor: the number of groups is
bounded, and one bucket's rows of a micro-batch are numbered together in a few
array operations. A group holds a bucket's share of the trigger
(``maxFilesPerTrigger``), its state a bucket's share of the actors.

``ordered_career_stream`` takes events in any order within a delay: a row waits in
its actor's state until the watermark has passed its date, so its counts hold
all earlier rows. Rows that come later than the delay are dropped by the watermark
(Spark counts them as ``numRowsDroppedByWatermark``). An actor's state is as large as
its rows within the delay. When the stream has ended, ``ordered_to_table``
takes the rows that still wait from the state store; rows without a date are among
these and count last.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from probengine.operators import clean
from probengine.session import ensure_checkpoint_dir

OUT_SCHEMA = ("attempt_id long, kicker_player_id long, game_date date, "
              "career_attempts double, career_makes double, career_fg_pct double")
NUMBERED_SCHEMA = OUT_SCHEMA.replace("game_date date", "day int")
STATE_SCHEMA = "actors array<bigint>, attempts array<bigint>, makes array<bigint>"
#: Hash buckets of actors; a checkpoint keeps the number it began with.
BUCKETS = 2048
#: The bucket of rows without an actor.
NO_ACTOR = -1
WAITING_SCHEMA = "attempts long, makes long, ids array<bigint>, days array<int>, plays array<bigint>, ys array<bigint>"
#: The day of rows without a date: behind all others.
NO_DAY = (1 << 31) - 1
DAY_MS = 86_400_000


def _career_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches), ignore_index=True)
    pdf = pdf.iloc[np.lexsort([pdf[c].to_numpy() for c in ("play_id", "no_play", "day", "actor")])]
    actor, y, n = pdf["actor"].to_numpy(), pdf["y"].to_numpy(), len(pdf)
    first = np.flatnonzero(np.append(True, actor[1:] != actor[:-1]))
    sizes = np.diff(np.append(first, n))
    known, *totals = (np.array(v, dtype=np.int64) for v in (state.get if state.exists else ([], [], [])))
    actors = np.union1d(known, actor[first])
    att, mk = (np.zeros(len(actors), dtype=np.int64) for _ in range(2))
    att[np.searchsorted(actors, known)], mk[np.searchsorted(actors, known)] = totals
    at, made = np.searchsorted(actors, actor[first]), np.cumsum(y) - y
    before_n = np.repeat(att[at] - first, sizes) + np.arange(n)
    before_y = np.repeat(mk[at] - made[first], sizes) + made
    att[at] += sizes
    mk[at] += np.add.reduceat(y, first)
    state.update((actors.tolist(), att.tolist(), mk.tolist()))
    named = actor if key[0] != NO_ACTOR else pd.array([pd.NA] * n, dtype="Int64")
    yield pd.DataFrame({"attempt_id": pdf["attempt_id"].to_numpy(), "kicker_player_id": named, "day": pdf["day"].to_numpy(),
                        "career_attempts": before_n.astype(float), "career_makes": before_y.astype(float),
                        "career_fg_pct": before_y / np.maximum(before_n, 1)})


def stream_attempts(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Raw attempts as a stream: ``orders`` files streamed, ``customer``
    joined as a static dimension (stream-static join)."""
    from probengine.sources import bindings as B
    path = f"{sf_dir}/orders.parquet"
    reader = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", files_per_trigger))
    # a stream lists a folder: the table's own, or the one its only file is in
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        orders = reader.parquet(path)
    else:
        orders = reader.option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return B.attempts_from(orders, B.table(spark, sf_dir, "customer"))


def career_stream(attempts: DataFrame) -> DataFrame:
    """Streaming W1-W3 (without prior history) over non-blocked attempts."""
    from probengine.session import ship_package
    ship_package(attempts.sparkSession)
    df = clean.where_not_equal_keep_null(attempts, "field_goal_result", clean.BLOCKED)
    actor = F.col("kicker_player_id").cast("bigint")
    df = df.select(F.when(actor.isNull(), NO_ACTOR).otherwise(F.pmod(F.xxhash64(actor), F.lit(BUCKETS))).cast("int").alias("bucket"),
                   F.coalesce(actor, F.lit(0)).alias("actor"), "attempt_id", F.coalesce(F.unix_date("game_date"), F.lit(NO_DAY)).alias("day"),
                   F.col("play_id").isNull().alias("no_play"), F.coalesce("play_id", F.lit(0)).alias("play_id"),
                   F.coalesce(F.col("field_goal_result") == "made", F.lit(False)).cast("long").alias("y"))
    out = df.groupBy("bucket").applyInPandasWithState(_career_state, NUMBERED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("day", F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day"))).withColumnRenamed("day", "game_date")


def _waiting_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts, makes, *kept = state.get if state.exists else (0, 0, [], [], [], [])
    waiting = list(zip(*kept[1:], kept[0], strict=True))      # (day, play, y, id)
    if not state.hasTimedOut:
        for pdf in batches:
            waiting += zip(*(pdf[c].tolist() for c in ("day", "play_id", "y", "attempt_id")), strict=True)
    waiting.sort(key=lambda r: (r[0], r[1], r[3]))
    mark = state.getCurrentWatermarkMs()
    n = sum(r[0] * DAY_MS < mark for r in waiting)            # sorted: the first n are complete
    out = []
    for day, _, y, i in waiting[:n]:
        out.append((i, key[0], dt.date(1970, 1, 1) + dt.timedelta(days=day), float(attempts), float(makes), makes / max(attempts, 1)))
        attempts, makes = attempts + 1, makes + y
    rest = waiting[n:]
    state.update((attempts, makes, [r[3] for r in rest], [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest]))
    if rest and rest[0][0] != NO_DAY:
        state.setTimeoutTimestamp(rest[0][0] * DAY_MS + 1)
    yield pd.DataFrame(out, columns=["attempt_id", "kicker_player_id", "game_date", "career_attempts", "career_makes", "career_fg_pct"])


def ordered_career_stream(attempts: DataFrame, delay: str = "30 days") -> DataFrame:
    """Streaming W1-W3 over events that may come up to ``delay`` behind the
    latest date seen so far."""
    from probengine.session import ship_package
    ship_package(attempts.sparkSession)
    df = clean.where_not_equal_keep_null(attempts, "field_goal_result", clean.BLOCKED)
    day = F.unix_date("game_date")
    df = df.select(F.col("attempt_id").cast("bigint"), F.col("kicker_player_id").cast("bigint"), F.coalesce(day, F.lit(NO_DAY)).alias("day"),
                   F.coalesce(F.col("play_id").cast("bigint"), F.lit(0)).alias("play_id"), F.timestamp_seconds(day.cast("bigint") * 86_400).alias("event_time"),
                   F.coalesce(F.col("field_goal_result") == "made", F.lit(False)).cast("bigint").alias("y"))
    return df.withWatermark("event_time", delay).groupBy("kicker_player_id").applyInPandasWithState(
        _waiting_state, OUT_SCHEMA, WAITING_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def ordered_to_table(stream: DataFrame, name: str | None = None) -> DataFrame:
    """All rows of an ended ``ordered_career_stream``: those that the
    watermark has passed and, numbered behind them, those still waiting."""
    spark = stream.sparkSession
    name = name or f"stream-{uuid.uuid4().hex}"
    out = run_to_table(stream, name)
    state = spark.read.format("statestore").load(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/state")
    held = state.select(F.col("key.kicker_player_id").alias("kicker_player_id"), "value.groupState.*")
    rows = held.select("kicker_player_id", "attempts", "makes", F.inline(F.arrays_zip("ids", "days", "plays", "ys")))
    # a window holds what one actor's state held
    before = Window.partitionBy("kicker_player_id").orderBy("days", "plays", "ids").rowsBetween(Window.unboundedPreceding, -1)
    attempts = (F.col("attempts") + F.count(F.lit(1)).over(before)).cast("double")
    makes = (F.col("makes") + F.coalesce(F.sum("ys").over(before), F.lit(0))).cast("double")
    rest = rows.select(F.col("ids").alias("attempt_id"), "kicker_player_id", F.when(F.col("days") != NO_DAY, F.date_from_unix_date("days")).alias("game_date"),
                       attempts.alias("career_attempts"), makes.alias("career_makes"))
    rest = rest.withColumn("career_fg_pct", F.col("career_makes") / F.greatest(F.col("career_attempts"), F.lit(1.0)))
    return out.unionByName(rest)


def run_to_table(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Drive a streaming plan over everything available into a Parquet table
    in the shared checkpoint folder and return it as a batch DataFrame."""
    spark = stream.sparkSession
    name = name or f"stream-{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
