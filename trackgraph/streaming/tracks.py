"""Telemetry streams: the twins of the batch operators. Each stream's rows have ``player_id, seq, ts_ms`` and sensor columns.

Streams are chained through tables: packets are decoded, held and appended to a table; the beats, sessions and snapshots read that
table as streams of their own. Event time is ``ts_ms``; rows later than the watermark are dropped by Spark and counted in its metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackgraph.operators import events, progress
from trackgraph.operators import telemetry as tracks
from trackgraph.sources import packets

LATE = "10 seconds"
#: A player who has been away for so long starts anew.
KEEP_MS = 3_600_000
#: The longest gap inside a session; a session window also joins gaps equal to it.
SESSION_GAP = f"{tracks.LIVE_MS - 1} milliseconds"


def timed(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Rows with their event time ``ts`` and a watermark on it."""
    return rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)


def without_repeats(rows: DataFrame, late: str = LATE) -> DataFrame:
    """A packet that is delivered twice within the watermark counts once."""
    return timed(rows, late).dropDuplicatesWithinWatermark(["player_id", "seq"])


def track_of_packets(raw: DataFrame) -> DataFrame:
    """Track columns of a stream of packets (``player_id, seq, payload``); short packets are left out."""
    names = {
        "TimestampMS": "ts_ms", "PositionX": "position_x", "PositionY": "position_y", "PositionZ": "position_z", "Speed": "speed_mps",
        "VelocityX": "velocity_x", "VelocityY": "velocity_y", "VelocityZ": "velocity_z", "Yaw": "yaw_rad", "Gear": "gear", "CurrentEngineRpm": "rpm",
        "EngineMaxRpm": "engine_max_rpm", "DistanceTraveled": "distance_traveled_m", "Accel": "accel_raw", "Brake": "brake_raw"}
    whole = {"ts_ms": "long", "gear": "int", "accel_raw": "int", "brake_raw": "int"}
    return packets.decoded(raw).select("player_id", "seq", *[F.col(a).cast(whole.get(b, "double")).alias(b) for a, b in names.items()])


def held(track: DataFrame) -> DataFrame:
    """Pause hold as a stream: the columns of the batch operator. A player's state is its packet count and last accepted place.

    Rows of one micro-batch are taken in the order of ``(ts_ms, seq)``, micro-batches in the order of their arrival. A state ends when
    the watermark is an hour past the player's last packet.
    """
    rows = timed(tracks.projected(track))
    place, own = tracks.PLACE, [(n, t) for n, t in rows.dtypes if n != "ts"]
    columns = [*[n for n, _ in own], "packet_count", "accepted"]

    def hold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values(["ts_ms", "seq"], kind="stable").reset_index(drop=True)
        count, *kept = state.get if state.exists else (0, *[np.nan] * len(place))
        number = count + 1 + np.arange(len(frame))
        accepted = ~frame["paused"].to_numpy(bool) | (number == 1)
        at = np.maximum.accumulate(np.where(accepted, np.arange(len(frame)), -1))
        for name, before in zip(place, kept):
            frame[name] = np.where(at >= 0, frame[name].to_numpy(float)[at], before)
        state.update((int(number[-1]), *[float(frame[name].iloc[-1]) for name in place]))
        state.setTimeoutTimestamp(int(frame["ts_ms"].max()) + KEEP_MS)
        yield frame.assign(packet_count=number, accepted=accepted)[columns]

    schema = ", ".join(f"`{n}` {t}" for n, t in own) + ", packet_count long, accepted boolean"
    memory = "packet_count long, " + ", ".join(f"{name} double" for name in place)
    return rows.groupBy("player_id").applyInPandasWithState(hold, schema, memory, "append", GroupStateTimeout.EventTimeTimeout)


def heartbeat(held_rows: DataFrame, every_ms: int = tracks.HEARTBEAT_MS) -> DataFrame:
    """Beats with packets, once the watermark has passed them: running packets, last speed, age of the last packet."""
    last = F.struct("ts_ms", "seq")
    beats = timed(held_rows).groupBy("player_id", F.window("ts", f"{every_ms} milliseconds").alias("w")).agg(
        F.max("packet_count").alias("packets"), F.max_by("speed_mps", last).alias("speed_mps"), F.max("ts_ms").alias("t"))
    beat = F.floor(F.unix_millis("w.start") / every_ms)
    return beats.select("player_id", beat.alias("beat"), "packets", "speed_mps", ((beat + 1) * every_ms - F.col("t")).alias("age_ms"))


def live_sessions(track: DataFrame) -> DataFrame:
    """Runs of packets with gaps under 1.5 s, once the watermark has passed them."""
    runs = timed(track).groupBy("player_id", F.session_window("ts", SESSION_GAP)).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("packets"))
    return runs.select("player_id", "start_ms", "end_ms", "packets")


def arrivals(rows: DataFrame) -> DataFrame:
    """First arrivals as a stream of ``player_id, arrived_ms``, from ``px`` and ``speed_kmh`` like the batch operator.

    A player's state is the time since which the target is near, and whether the arrival was told.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        timer, told = state.get if state.exists else (None, False)
        out = []
        for t, near, clear in zip(frame["ts_ms"], frame["near"], frame["clear"]):
            timer = None if clear else t if near and timer is None else timer
            if near and t - timer >= progress.ARRIVE_MS and not told:
                out, told = [(key[0], t)], True
        state.update((timer, told))
        state.setTimeoutTimestamp(int(frame["ts_ms"].max()) + KEEP_MS)
        yield pd.DataFrame(out, columns=["player_id", "arrived_ms"])

    marks = timed(progress.arrival_marks(rows).select("player_id", "ts_ms", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("clear", F.lit(False)).alias("clear")))
    return marks.groupBy("player_id").applyInPandasWithState(fold, "player_id long, arrived_ms long", "timer long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def reroutes(rows: DataFrame) -> DataFrame:
    """Reroute decisions as a stream: the columns and the steps of the batch operator, with its state kept for each player."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        now, out = state.get if state.exists else progress.NO_REROUTE, []
        for t, *row in zip(frame["ts_ms"], frame["off"], frame["to_target"], frame["map_x"], frame["map_y"]):
            now, reason = progress.reroute_step(now, t, *row)
            if reason:
                out.append((key[0], t, reason))
        state.update(now)
        state.setTimeoutTimestamp(int(frame["ts_ms"].max()) + KEEP_MS)
        yield pd.DataFrame(out, columns=["player_id", "ts_ms", "reason"])

    own = timed(rows.select("player_id", "ts_ms", "off", "to_target", "map_x", "map_y"))
    return own.groupBy("player_id").applyInPandasWithState(fold, "player_id long, ts_ms long, reason string", progress.REROUTE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: How far back a row's driving events look, and the longest cooldown after one.
EVENT_TAIL_MS = 2800
EVENT_COOLDOWN_MS = max(cooldown for _, cooldown in events.EVENTS.values())
EVENT = "player_id long, seq long, ts_ms long, event string"


def event_sink(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the driving events of every micro-batch of held rows, in ``folder/events/batch=<number>``.

    The batch operators run over the micro-batch and each player's last 2.8 s before it; the events of the last 8 s join the thinning, so
    cooldowns go on. Both are written for the next micro-batch; a micro-batch that is repeated gives the same. A player's micro-batches
    are taken in order of time; a player who is an hour behind all others starts anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows, recent = batch, spark.createDataFrame([], EVENT)
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{folder}/tail/batch={number - 1}").unionByName(batch)
            recent = spark.read.schema(EVENT).parquet(f"{folder}/recent/batch={number - 1}")
        rows = rows.persist()
        fresh = events.crash_candidates(rows).unionByName(events.jump_candidates(rows)).join(batch.select("player_id", "seq"), ["player_id", "seq"], "left_semi")
        told = events.thinned(fresh.unionByName(recent)).persist()
        newest = rows.groupBy("player_id").agg(F.max("ts_ms").alias("newest"))
        newest = newest.where(F.col("newest") >= F.lit((rows.agg(F.max("ts_ms")).first()[0] or 0) - KEEP_MS))
        back = lambda df, ms: df.join(newest, "player_id").where(F.col("ts_ms") >= F.col("newest") - ms).select(*df.columns)
        told.join(recent, ["player_id", "seq", "event"], "left_anti").select("player_id", "seq", "ts_ms", "event").write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        back(told, EVENT_COOLDOWN_MS).write.mode("overwrite").parquet(f"{folder}/recent/batch={number}")
        back(rows, EVENT_TAIL_MS).write.mode("overwrite").parquet(f"{folder}/tail/batch={number}")
        rows.unpersist()
        told.unpersist()

    return merge


def latest_sink(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the last row of each player after every micro-batch, a folder for each. A batch that is repeated
    after a failure writes its folder again from the one before it, so the result is the same."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{folder}/batch={number - 1}").unionByName(batch)
        tracks.latest(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return merge


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The table after the newest micro-batch."""
    rows = spark.read.parquet(folder)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == newest).drop("batch")


def appended(stream: DataFrame, folder: str) -> None:
    """Appends all that the stream's source holds now to Parquet files in ``folder/rows``; can be called again for later rows."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
