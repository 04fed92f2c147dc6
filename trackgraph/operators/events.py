"""Driving events: candidates by range windows, and their thinning by cooldowns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackgraph.operators.telemetry import by_track, so_far

# Priority and cooldown in ms of each event, and the cooldown of all.
EVENTS = {"mega_fail_crash": (120, 8000), "jump_takeoff": (100, 4500), "collision": (60, 4000)}
GLOBAL_COOLDOWN_MS = 2500


def crash_candidates(track: DataFrame) -> DataFrame:
    """Rows whose speed fell sharply: ``collision`` (within 0.5 s, hardly braking) and ``mega_fail_crash`` (within 0.15 s)."""
    time = Window.partitionBy("player_id").orderBy("ts_ms")
    rows = track.withColumns({"__a": F.max("speed_kmh").over(time.rangeBetween(-500, -1)), "__b": F.max("speed_kmh").over(time.rangeBetween(-150, -1))})
    speed, a, b = F.col("speed_kmh"), F.col("__a"), F.col("__b")
    kinds = F.array_compact(F.array(
        F.when((a >= 60) & (a - speed >= 40) & (F.col("brake") <= 5), "collision"),
        F.when((b >= 120) & (speed <= 15) & (b - speed >= 100), "mega_fail_crash")))
    return rows.select("player_id", "seq", "ts_ms", F.explode(kinds).alias("event"))


def jump_candidates(track: DataFrame) -> DataFrame:
    """Rows in free fall after a ramp; see the survey's definition of ``jump_takeoff``."""
    dx, dz = F.col("position_x") - F.lag("position_x").over(by_track()), F.col("position_z") - F.lag("position_z").over(by_track())
    falling = F.col("velocity_y") <= -0.25
    rows = track.withColumns({"path": F.sum(F.coalesce(F.sqrt(dx * dx + dz * dz), F.lit(0.0))).over(so_far()), "rises": F.sum((~falling).cast("long")).over(so_far())})
    run = Window.partitionBy("player_id", "rises").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    time = Window.partitionBy("player_id").orderBy("ts_ms")
    near, far = time.rangeBetween(-150, 0), time.rangeBetween(-2800, 0)
    rows = rows.withColumns({
        "near": F.first(F.struct("ts_ms", "velocity_y")).over(near), "apex": F.max(F.struct(F.col("position_y").alias("y"), F.col("ts_ms").alias("t"), F.col("path").alias("p"))).over(far),
        "base": F.first(F.struct("position_y", "velocity_y")).over(far), "top_vy": F.max("velocity_y").over(far)})
    rows = rows.withColumns({"run_start": F.min(F.when(falling, F.col("ts_ms"))).over(run), "run_rows": F.sum(falling.cast("int")).over(run)})
    dt = (F.col("ts_ms") - F.col("near.ts_ms")) / 1000
    drop = F.col("apex.y") - F.col("position_y")
    jump = (
        falling & (F.col("speed_kmh") >= 75) & (F.col("ts_ms") - F.col("run_start") >= 150) & (F.col("run_rows") >= 2)
        & (dt > 0) & (F.col("velocity_y") - F.col("near.velocity_y") <= -0.45 * dt)
        & (F.col("ts_ms") - F.col("apex.t") <= 2400) & (drop >= 0.18) & (F.col("apex.y") - F.col("base.position_y") >= 0.75)
        & (F.col("top_vy") >= 1.0) & (F.col("top_vy") - F.col("base.velocity_y") >= 1.1) & (drop >= 0.018 * (F.col("path") - F.col("apex.p"))))
    return rows.where(jump).select("player_id", "seq", "ts_ms", F.lit("jump_takeoff").alias("event"))


def thinned(candidates: DataFrame, events: dict = EVENTS, global_ms: int = GLOBAL_COOLDOWN_MS) -> DataFrame:
    """Candidates kept by a greedy pass in time order, the highest priority first; events that are not in ``events`` go."""

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(p=[-events[e][0] for e in f["event"]]).sort_values(["ts_ms", "p", "seq"], kind="stable")
        own, last, out = {}, None, []
        for e, t in zip(f["event"], f["ts_ms"]):
            good = (last is None or t - last >= global_ms) and (e not in own or t - own[e] >= events[e][1])
            out.append(good)
            if good:
                own[e] = last = t
        return f.loc[out, ["player_id", "seq", "ts_ms", "event"]]

    rows = candidates.where(F.col("event").isin(*events))
    return rows.groupBy("player_id").applyInPandas(keep, "player_id long, seq long, ts_ms long, event string")


def drive_events(track: DataFrame) -> DataFrame:
    """Thinned events of a track with ``speed_kmh`` and ``brake``."""
    return thinned(crash_candidates(track).unionByName(jump_candidates(track)))
