"""A stream with NULL results, the optional import, and effects by segment."""

import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from probengine.operators import effects as FX

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stream_counts_a_null_result_as_an_attempt_that_missed(spark, tmp_path):
    from probengine.streaming.career_stream import career_stream, run_to_table
    rows = [(1, "k", "2020-01-01", 1, "made"), (2, "k", "2020-01-02", 1, None), (3, "k", "2020-01-03", 1, "made"), (4, "k", "2020-01-04", 1, "missed")]
    df = spark.createDataFrame(rows, "attempt_id long, kicker_player_id string, game_date string, play_id long, field_goal_result string")
    df = df.withColumn("game_date", F.to_date("game_date")).withColumn("kicker_player_id", F.lit(7).cast("long"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.attempt_id: (r.career_attempts, r.career_makes) for r in run_to_table(career_stream(stream)).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (2, 1), 4: (3, 2)}


def test_entry_goes_without_the_optional_queries_if_a_library_is_missing():
    code = ("import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); assert len(q) > 60; assert e.oracle_sql().keys() <= q.keys()")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_effects_by_segment_are_residual_products_over_squares(spark):
    rng = np.random.default_rng(2)
    n = 600
    rows = [(i, int(rng.random() < 0.8) if i % 40 else None, float(rng.integers(18, 60)), int(rng.integers(0, 2)), int(rng.integers(0, 2)) if i % 30 else None) for i in range(n)]
    df = spark.createDataFrame(rows, f"attempt_id long, {FX.TARGET} int, kick_distance double, is_rain int, roof_binary int")
    df = df.withColumn("g", F.floor(F.col("kick_distance") / 10))
    res = FX.group_mean_residuals(df, "attempt_id", "g", [("is_rain", "binary"), ("kick_distance", "continuous")], segments=["roof_binary"])
    from probengine.operators.folds import hash_folds
    pdf = hash_folds(df, "attempt_id", 2, 42).toPandas()
    pdf["miss"] = 1 - pdf[FX.TARGET]
    want = {}
    for t in ("is_rain", "kick_distance"):
        ry, rt = [], []
        for r in pdf.itertuples():
            other = pdf[(pdf.g == r.g) & (pdf.fold != r.fold)]
            ry.append(r.miss - other.miss.mean())
            rt.append(getattr(r, t) - other[t].mean())
        pdf["ry"], pdf["rt"] = ry, rt
        ok = pdf[pdf.ry.notna() & pdf.rt.notna()]
        for value, part in [(None, ok), *[(v, ok[ok.roof_binary.isna()] if v == "null" else ok[ok.roof_binary == float(v)]) for v in ("0", "1", "null")]]:
            want[t, value] = (part.rt * part.ry).sum() / (part.rt ** 2).sum(), len(part)
    got = {(r.treatment, None if r.segment is None else r.value or "null"): (r.ATE_per_unit, r.n) for r in FX.final_stage(res, {}, ["roof_binary"]).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
