"""The stream's state is kept by buckets of actors, not by actor."""

import datetime as dt
import uuid

from probengine.session import ensure_checkpoint_dir
from probengine.streaming import career_stream as CS


def test_stream_state_has_a_bounded_number_of_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CS, "BUCKETS", 4)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(n, a if a != 39 else None, day(n // 120) if n % 50 else None, n % 7 if n % 11 else None, ["made", "missed", "blocked", None][n * a % 4])
            for n in range(600) for a in [n * 17 % 40]]
    schema = "attempt_id long, kicker_player_id long, game_date date, play_id long, field_goal_result string"
    halves = [rows[:300], rows[300:]]
    for i, half in enumerate(halves):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"buckets-{uuid.uuid4().hex}"
    got = CS.run_to_table(CS.career_stream(stream), name).collect()
    state = spark.read.format("statestore").load(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/state")
    assert 0 < state.count() <= 4 + 1
    want, seen = {}, {}
    for half in halves:
        for n, a, d, p, r in sorted(half, key=lambda r: (r[2] or dt.date.max, r[3] is None, r[3] or 0)):
            if r != "blocked":
                att, mk = seen.get(a, (0, 0))
                want[n] = (a, d, att, mk, mk / max(att, 1))
                seen[a] = (att + 1, mk + (r == "made"))
    # rows alike in actor, date and play may be numbered either way: totals by key are the same
    key = lambda n, v: (str(v[0]), str(v[1]), str(rows[n][3]), n // 300)
    assert {r.attempt_id for r in got} == set(want) and len(got) == len(want)
    of = lambda found: sorted((key(n, v), v[2]) for n, v in found.items())
    have = {r.attempt_id: (r.kicker_player_id, r.game_date, r.career_attempts, r.career_makes, r.career_fg_pct) for r in got}
    assert of(have) == of(want)
    alone = {k for k in map(lambda n: key(n, want[n]), want) if sum(key(n, want[n]) == k for n in want) == 1}
    assert alone and all(have[n] == want[n] for n in want if key(n, want[n]) in alone)
