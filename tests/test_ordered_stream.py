"""Events out of order, by less than the delay, give the counts of the
ordered history."""

import datetime as dt
import random
import uuid

import pytest

from probengine.session import ensure_checkpoint_dir
from probengine.streaming import career_stream as CS

DDL = "attempt_id long, kicker_player_id long, game_date date, play_id long, field_goal_result string"


def _attempts(n_days=120):
    rng, rows = random.Random(3), []
    for i in range(n_days * 3):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i // 3)
        rows.append((i, rng.choice([1, 2, 2, 2, None]), day, rng.randrange(3), rng.choice(["made", "missed", None, "blocked"])))
    return rows


def _expected(rows):
    out, seen = {}, {}
    for i, who, day, play, result in sorted(rows, key=lambda r: (r[2] or dt.date.max, r[3], r[0])):
        if result != "blocked":
            n, m = seen.get(who, (0, 0))
            out[i] = (who, day, float(n), float(m), m / max(n, 1))
            seen[who] = n + 1, m + (result == "made")
    return out


def _run(spark, folder, files, delay):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    # the files of the folders, one a trigger, in the order written
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    name = f"ordered-{uuid.uuid4().hex}"
    got = CS.ordered_to_table(CS.ordered_career_stream(stream, delay), name).collect()
    passed = spark.read.parquet(f"{ensure_checkpoint_dir(spark)}/{name}/rows").count()
    assert passed > len(got) / 2 if delay == "30 days" else passed == 0      # by the watermark, not at the end
    assert len({r.attempt_id for r in got}) == len(got)
    return {r.attempt_id: (r.kicker_player_id, r.game_date, r.career_attempts, r.career_makes, pytest.approx(r.career_fg_pct)) for r in got}


def test_shuffled_files_give_the_ordered_result(spark, tmp_path):
    rows = _attempts()
    # each event is moved by up to 20 days, then dealt to six files in that order
    rng = random.Random(5)
    moved = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=rng.randrange(20)))
    files = [moved[k:k + 60] for k in range(0, len(moved), 60)]
    assert any(max(r[2] for r in a) > min(r[2] for r in b) for a, b in zip(files, files[1:]))
    assert _run(spark, tmp_path, files, "30 days") == _expected(rows)


def test_rows_without_a_date_count_last(spark, tmp_path):
    rows = _attempts(10) + [(900, 2, None, 0, "made"), (901, 2, None, 1, None)]
    assert _run(spark, tmp_path, [rows[::2], rows[1::2]], "365 days") == _expected(rows)
