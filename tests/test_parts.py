"""Tracks cut into parts by player and day give the rows of uncut tracks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackgraph.operators import telemetry as tracks

WHOLE = 10**15


@pytest.fixture(scope="module")
def track(spark):
    """Player 1 has most rows; pauses, gaps, equal times, odometers that are not valid or start again."""
    h = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n))
    paused = (h("pause", 6) == 0) | (F.col("id") < 3)
    rows = spark.range(2400).select(
        F.when(F.col("id") % 12 == 0, F.col("id") % 5 + 2).otherwise(1).cast("long").alias("player_id"), F.col("id").alias("seq"),
        (F.floor(F.col("id") / 2) * 74 + F.floor(F.col("id") / 25) * 2100).alias("ts_ms"),
        (h("x", 900) / 10).alias("position_x"), F.lit(0.0).alias("position_y"), (h("z", 900) / 10).alias("position_z"),
        F.when(paused, 0.1).otherwise(h("s", 300) / 10).alias("speed_mps"), (h("vx", 21) - 10).cast("double").alias("velocity_x"),
        (h("vz", 21) - 10).cast("double").alias("velocity_z"), (h("yaw", 628) / 100).alias("yaw_rad"), F.when(paused, 0).otherwise(3).alias("gear"),
        F.when(h("bad", 4) == 0, 0.0).when(h("bad", 41) == 7, None).otherwise((F.col("id") * 3 % 1700).cast("double")).alias("distance_traveled_m"),
        h("a", 256).cast("int").alias("accel_raw"), h("b", 256).cast("int").alias("brake_raw"))
    return rows.cache()


def _rows(df):
    df = df.select(sorted(df.columns))
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-1).collect())


@pytest.mark.parametrize("run", [
    lambda t, ms: tracks.held(t, ms), lambda t, ms: tracks.live_sessions(t, ms), lambda t, ms: tracks.heartbeat(t, part_ms=ms),
    lambda t, ms: tracks.trips(t, ms).select("seq", "trip_km"), lambda t, ms: tracks.motion_heading(tracks.held(t), ms).select("seq", "motion_heading")],
    ids=["held", "live_sessions", "heartbeat", "trips", "motion_heading"])
def test_parts_give_the_rows_of_whole_tracks(track, run):
    whole = _rows(run(track, WHOLE))
    assert len(whole) > 50
    for part_ms in (500, 7000, 60_000):
        assert _rows(run(track, part_ms)) == whole


def test_trips_of_parts_equal_a_pass_over_each_track(track):
    """A plain loop over each player's rows is the measure for parts of any length."""
    want = {}
    state = {}
    for r in sorted(track.collect(), key=lambda r: (r.player_id, r.ts_ms, r.seq)):
        s = state.setdefault(r.player_id, {"base": None, "valid": None, "trip": 0.0, "ts": None})
        raw = r.distance_traveled_m
        if raw is not None and 1 < raw < 2e7:
            if s["valid"] is None or raw + 5 < s["valid"]:
                s["base"] = raw
            s["valid"], s["trip"] = raw, max(0.0, raw - s["base"]) / 1000
        elif s["ts"] is not None:
            s["trip"] += r.speed_mps * 3.6 * min(max(r.ts_ms - s["ts"], 0), 2500) / 3.6e6
        s["ts"] = r.ts_ms
        want[r.seq] = s["trip"]
    got = {r.seq: r.trip_km for r in tracks.trips(track, 7000).collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("own", [0.0, 7600.0])
def test_rpm_of_parts_equals_a_pass_over_each_track(track, own):
    """Without an engine's own maximum, and with one on some rows, the learned one goes from part to part."""
    h = F.pmod(F.xxhash64("seq", F.lit("rpm")), F.lit(6000))
    rows = track.select("player_id", "seq", "ts_ms", (h + F.col("seq") * 2).cast("double").alias("rpm"), F.when(F.col("seq") % 97 == 5, own).otherwise(0.0).alias("engine_max_rpm"))
    want, learned = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.player_id, r.ts_ms, r.seq)):
        last = learned.get(r.player_id, 8000.0)
        if r.engine_max_rpm > 1000:
            last = r.engine_max_rpm
        elif r.rpm > last:
            last = min(12000.0, r.rpm * 1.08)
        learned[r.player_id] = last
        want[r.seq] = min(1.0, max(0.0, r.rpm / max(1000.0, last)))
    assert len(set(learned.values())) > 1
    for part_ms in (900, 20_000, WHOLE):
        assert {r.seq: r.rpm_ratio for r in tracks.rpm_ratio(rows, part_ms).collect()} == pytest.approx(want, abs=1e-12)


def test_a_player_with_most_rows_is_spread_over_tasks(track):
    plan = tracks.trips(tracks.held(track))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(player_id" in plan and "__day" in plan
    parts = tracks._cut(track, 7000).where("player_id = 1").select("__day").distinct().count()
    assert parts > 20
