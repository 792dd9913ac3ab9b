"""Streams over files that arrive one after the other."""

from datetime import datetime

import pandas as pd

from quaystone.streaming import flows

T = "event_id long, user_id long, event_type string, ts timestamp"


def _arrive(spark, tmp_path, *files):
    """Each list of (user, hour, minute) is a file; older files come first."""
    import os
    import time

    where = tmp_path / "events.parquet"
    where.mkdir()
    for n, rows in enumerate(files):
        pdf = pd.DataFrame([(k, u, "view", datetime(2025, 1, 1, h, m)) for k, (u, h, m) in enumerate(rows)], columns=["event_id", "user_id", "event_type", "ts"]).astype({"ts": "datetime64[us]"})
        pdf.to_parquet(where / f"{n}.parquet")
        os.utime(where / f"{n}.parquet", (time.time() - 100 + n,) * 2)
    return flows.arrivals(spark, str(tmp_path), "events")


def test_late_events_are_dropped_and_open_windows_wait(spark, tmp_path):
    stream = _arrive(spark, tmp_path, [(1, 1, 0), (1, 1, 30), (1, 3, 0)], [(1, 5, 0)], [(1, 1, 5), (1, 9, 0)])
    got = {(r.window_start.hour, r.n) for r in flows.run_to_end(flows.tumbling_counts(stream, late="30 minutes")).collect()}
    assert got == {(1, 2), (3, 1), (5, 1)}  # 1:05 came after its window was closed; that of 9:00 is still open


def test_state_is_kept_over_files(spark, tmp_path):
    stream = _arrive(spark, tmp_path, [(1, 1, 0), (2, 1, 0)], [(1, 2, 0)])
    given = sorted((r.user_id, r.n) for r in flows.run_to_end(flows.user_totals(stream), "update").collect())
    assert given == [(1, 1), (1, 2), (2, 1)]


def test_sessions_grow_over_files(spark, tmp_path):
    stream = _arrive(spark, tmp_path, [(1, 1, 0), (1, 1, 20), (2, 1, 0)], [(1, 1, 45), (1, 2, 30)])
    got = sorted((r.user_id, r.session_start.hour, r.session_start.minute, r.n) for r in flows.run_to_end(flows.sessions(stream), "complete").collect())
    assert got == [(1, 1, 0, 3), (1, 2, 30, 1), (2, 1, 0, 1)]


def test_nothing_arrives(spark, tmp_path):
    assert flows.run_to_end(flows.user_totals(_arrive(spark, tmp_path, [])), "update").count() == 0
