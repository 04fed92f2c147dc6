"""Track operators. Rows are in the order ``(ts_ms, seq)`` of their player.

Running values are computed over parts of a track, one for each player and day, with one exchange on ``(player_id, __day)``; a table
of one row for each part gives every part what the earlier ones leave. So a player with most rows is spread over tasks. Rows without
a ``player_id`` are handled day by day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackgraph.functions import geo

PAUSE_SPEED, LIVE_MS, HEARTBEAT_MS, DAY_MS = 0.20, 1500, 2000, 86_400_000


def by_track() -> WindowSpec:
    return Window.partitionBy("player_id").orderBy("ts_ms", "seq")


def so_far() -> WindowSpec:
    return by_track().rowsBetween(Window.unboundedPreceding, 0)


#: Order of a track.
AT = ["ts_ms", "seq"]


def _cut(track: DataFrame, part_ms: int) -> DataFrame:
    """``track`` and the part of each row; rows without a time are a part of their own, the first."""
    return track.withColumn("__day", F.coalesce(F.floor(F.col("ts_ms") / part_ms), F.lit(-(1 << 62))))


def _in_part() -> WindowSpec:
    return Window.partitionBy("player_id", "__day").orderBy(*AT)


def _part_so_far() -> WindowSpec:
    return _in_part().rowsBetween(Window.unboundedPreceding, 0)


def _parts() -> WindowSpec:
    return Window.partitionBy("player_id").orderBy("__day")


def _earlier_parts() -> WindowSpec:
    return _parts().rowsBetween(Window.unboundedPreceding, -1)


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, ["player_id", "__day"], "left")


#: What a paused row takes from the last row that was not.
PLACE = ["position_x", "position_y", "position_z", "map_x", "map_y", "yaw_rad", "heading"]


def projected(track: DataFrame) -> DataFrame:
    """What a row gives by itself: whether it is paused, its place on the map, heading and units."""
    return track.withColumns({
        "paused": F.coalesce((F.col("speed_mps") <= PAUSE_SPEED) & (F.col("gear") == 0), F.lit(False)),
        "map_x": geo.map_x(F.col("position_x"), F.col("position_z")), "map_y": geo.map_y(F.col("position_x"), F.col("position_z")),
        "heading": geo.heading(F.col("speed_mps"), F.col("velocity_x"), F.col("velocity_z"), F.col("yaw_rad")),
        "speed_kmh": geo.kmh(F.col("speed_mps")), "throttle": geo.percent(F.col("accel_raw")), "brake": geo.percent(F.col("brake_raw"))})


def _counted(rows: DataFrame) -> DataFrame:
    """``player_id, __day, __n``: rows of the player before each part."""
    parts = rows.groupBy("player_id", "__day").agg(F.count("*").alias("__n"))
    return parts.select("player_id", "__day", F.sum("__n").over(_earlier_parts()).alias("__n"))


def _number() -> Column:
    """A row's number in its track, where its part knows ``__n``."""
    return F.row_number().over(_in_part()).cast("long") + F.coalesce("__n", F.lit(0))


def held(track: DataFrame, part_ms: int = DAY_MS) -> DataFrame:
    """Pause hold, projection, units and counters of every row.

    A row with ``speed_mps <= 0.2`` and gear 0 is paused; but for a player's first row it takes place and heading from the last
    row that was not.
    """
    rows, place, earlier = _cut(projected(track), part_ms), F.struct(*PLACE), _earlier_parts()
    parts = rows.groupBy("player_id", "__day").agg(
        F.count("*").alias("__n"), F.max_by(place, F.when(~F.col("paused"), F.struct(*AT))).alias("__last"), F.min_by(place, F.struct(*AT)).alias("__first"))
    parts = parts.select(
        "player_id", "__day", F.sum("__n").over(earlier).alias("__n"), F.last("__last", ignorenulls=True).over(earlier).alias("__last"),
        F.first("__first").over(_parts().rowsBetween(Window.unboundedPreceding, 0)).alias("__first"))
    rows = _with_parts(rows, parts).withColumn("packet_count", _number())
    rows = rows.withColumn("accepted", ~F.col("paused") | (F.col("packet_count") == 1))
    kept = F.coalesce(F.last(F.when(F.col("accepted"), place), ignorenulls=True).over(_part_so_far()), F.col("__last"), F.col("__first"))
    rows = rows.withColumn("__kept", kept).withColumns({c: F.col(f"__kept.{c}") for c in PLACE})
    return rows.select(*projected(track).columns, "packet_count", "accepted")


def latest(track: DataFrame) -> DataFrame:
    """The last row of each player."""
    names = track.columns
    found = track.groupBy("player_id").agg(F.max_by(F.struct(*names), F.struct("ts_ms", "seq")).alias("r"))
    return found.select(*[F.col(f"r.{c}") for c in names])


def liveness(players: DataFrame, track: DataFrame, as_of_ms) -> DataFrame:
    """``player_id, age_ms, status``: LIVE within 1.5 s of the last packet, HOLDING if there is a position, else WAITING."""
    last = track.where(F.col("ts_ms") <= as_of_ms).groupBy("player_id").agg(F.max("ts_ms").alias("last"), F.max_by("map_x", F.struct("ts_ms", "seq")).alias("x"))
    age = F.lit(as_of_ms) - F.col("last")
    status = F.when(age < LIVE_MS, "LIVE").when(F.col("x").isNotNull(), "HOLDING").otherwise("WAITING")
    return players.join(last, "player_id", "left").select("player_id", age.alias("age_ms"), status.alias("status"))


def client_status(players: DataFrame, track: DataFrame, as_of_ms) -> DataFrame:
    """``player_id, status`` as a client shows it: ERROR first, then HOLDING while paused, LIVE, HOLDING with a position, else WAITING.

    ``players`` has ``failed`` (null: not), ``track`` has ``paused``; a paused player is held from its first row on.
    """
    last = track.where(F.col("ts_ms") <= as_of_ms).groupBy("player_id").agg(F.max_by(F.struct("ts_ms", "paused", "map_x"), F.struct("ts_ms", "seq")).alias("r"))
    status = (F.when(F.coalesce("failed", F.lit(False)), "ERROR").when(F.col("r.paused"), "HOLDING").when(F.lit(as_of_ms) - F.col("r.ts_ms") < LIVE_MS, "LIVE")
              .when(F.col("r.map_x").isNotNull(), "HOLDING").otherwise("WAITING"))
    return players.join(last, "player_id", "left").select("player_id", status.alias("status"))


def live_sessions(track: DataFrame, part_ms: int = DAY_MS) -> DataFrame:
    """Runs of packets with gaps under 1.5 s."""
    rows = _cut(track.select("player_id", *AT), part_ms)
    new = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(_in_part()) >= LIVE_MS, F.lit(False))  # the first row of a part is judged below
    rows = rows.withColumn("__new", new).withColumn("__run", F.sum(F.col("__new").cast("long")).over(_part_so_far()))
    runs = rows.groupBy("player_id", "__day", "__run").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("packets"))
    parts = runs.groupBy("player_id", "__day").agg(F.max("__run").alias("__runs"), F.min("start_ms").alias("__start"), F.max("end_ms").alias("__end"))
    apart = F.coalesce(F.col("__start") - F.lag("__end").over(_parts()) >= LIVE_MS, F.lit(True)).cast("long")
    parts = parts.withColumn("__apart", apart)
    first = F.coalesce(F.sum(F.col("__runs") + F.col("__apart")).over(_earlier_parts()), F.lit(0)) + F.col("__apart")
    found = _with_parts(runs, parts.select("player_id", "__day", first.alias("__session"))).withColumn("session", F.coalesce("__session", F.lit(1)) + F.col("__run"))
    return found.groupBy("player_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("packets").alias("packets"))


def heartbeat(track: DataFrame, every_ms: int = HEARTBEAT_MS, part_ms: int = DAY_MS) -> DataFrame:
    """Per player and interval with packets: running packets, last speed, age of the last packet at the interval's end."""
    rows = _cut(track.select("player_id", *AT, "speed_mps"), part_ms)
    rows = _with_parts(rows, _counted(rows)).withColumn("packets", _number()).withColumn("beat", F.floor(F.col("ts_ms") / every_ms))
    last = F.struct(*AT)
    out = rows.groupBy("player_id", "beat").agg(F.max("packets").alias("packets"), F.max_by("speed_mps", last).alias("speed_mps"), F.max("ts_ms").alias("t"))
    return out.withColumn("age_ms", (F.col("beat") + 1) * every_ms - F.col("t")).drop("t")


def _driven(speed: Column, ms: Column) -> Column:
    """Kilometres at ``speed`` (km/h) in ``ms``, of which at most 2.5 s count."""
    return speed * F.least(F.greatest(ms, F.lit(0)), F.lit(2500)) / 3.6e6


def _is_reset(value: Column, last: Column) -> Column:
    return value.isNotNull() & (last.isNull() | (value + 5 < last))


def _metres_to_km(value: Column, base: Column) -> Column:
    return F.greatest(F.lit(0.0), value - base) / 1000


def trips(track: DataFrame, part_ms: int = DAY_MS) -> DataFrame:
    """``trip_km`` of every row from the odometer, with speed integrated over rows whose odometer is not valid.

    Within a part the first row's step and the first valid value's reset are left open; the table of parts settles both.
    """
    raw, at, earlier = F.col("distance_traveled_m"), F.struct(*AT), _earlier_parts()
    valid = F.coalesce(~F.isnan(raw) & (raw > 1) & (raw < 2e7), F.lit(False))
    rows = _cut(track, part_ms).withColumns({"__v": F.when(valid, raw), "__speed": F.col("speed_mps") * 3.6})
    rows = rows.withColumn("__p", F.last("__v", ignorenulls=True).over(_in_part().rowsBetween(Window.unboundedPreceding, -1)))
    step = F.when(F.col("__v").isNull(), _driven(F.col("__speed"), F.col("ts_ms") - F.lag("ts_ms").over(_in_part())))
    reset = F.col("__p").isNotNull() & _is_reset(F.col("__v"), F.col("__p"))
    rows = rows.withColumns({"__r": F.when(reset, F.col("__v")), "__i": F.coalesce(F.sum(step).over(_part_so_far()), F.lit(0.0))})
    known = F.when(F.col("__v").isNotNull(), at)
    parts = rows.groupBy("player_id", "__day").agg(
        F.min_by(F.struct("ts_ms", "__speed", "__v"), at).alias("__head"), F.max("ts_ms").alias("__end"), F.max_by("__i", at).alias("__all"),
        F.min_by("__v", known).alias("__v0"), F.max_by(F.struct(F.col("__v").alias("v"), F.col("__i").alias("i")), known).alias("__vn"),
        F.max_by("__r", F.when(F.col("__r").isNotNull(), at)).alias("__rn"))
    opening = F.when(F.col("__head.__v").isNull(), _driven(F.col("__head.__speed"), F.col("__head.ts_ms") - F.last("__end", ignorenulls=True).over(earlier)))
    begins = _is_reset(F.col("__v0"), F.last("__vn.v", ignorenulls=True).over(earlier))
    parts = parts.withColumns({"__x": F.coalesce(opening, F.lit(0.0)), "__r0": F.when(begins, F.col("__v0"))})
    parts = parts.withColumns({
        "__b": F.coalesce(F.col("__r0"), F.last(F.coalesce("__rn", "__r0"), ignorenulls=True).over(earlier)),
        "__before": F.coalesce(F.sum(F.col("__x") + F.col("__all")).over(earlier), F.lit(0.0))})
    mark = F.struct(_metres_to_km(F.col("__vn.v"), F.coalesce("__rn", "__b")).alias("trip"), (F.col("__before") + F.col("__x") + F.col("__vn.i")).alias("i"))
    parts = parts.withColumn("__mark", F.last(F.when(F.col("__vn").isNotNull(), mark), ignorenulls=True).over(earlier))
    rows = _with_parts(rows, parts.select("player_id", "__day", "__x", "__b", "__before", "__mark"))
    rows = rows.withColumns({"__i": F.col("__i") + F.coalesce(F.col("__before") + F.col("__x"), F.lit(0.0)),
                             "__b": F.coalesce(F.last("__r", ignorenulls=True).over(_part_so_far()), F.col("__b"))})
    own = F.struct(_metres_to_km(F.col("__v"), F.col("__b")).alias("trip"), F.col("__i").alias("i"))
    rows = rows.withColumn("__a", F.coalesce(F.last(F.when(F.col("__v").isNotNull(), own), ignorenulls=True).over(_part_so_far()), F.col("__mark")))
    trip = F.coalesce(F.col("__a.trip"), F.lit(0.0)) + F.col("__i") - F.coalesce(F.col("__a.i"), F.lit(0.0))
    return rows.select(*track.columns, trip.alias("trip_km"))


def _motion(x: Column, y: Column, last_x: Column, last_y: Column, speed_kmh: Column, ts_ms: Column) -> Column:
    """``t, h``: time and heading of a displacement that is long enough, else null."""
    dx, dy = x - last_x, y - last_y
    return F.when((F.sqrt(dx * dx + dy * dy) > 0.45) & (speed_kmh > 2), F.struct(ts_ms.alias("t"), F.degrees(F.atan2(dx, -dy)).alias("h")))


def motion_heading(track: DataFrame, part_ms: int = DAY_MS) -> DataFrame:
    """Heading of the displacement if it is long enough, else the last such heading of under 3.5 s ago, else ``heading``."""
    rows, at, place = _cut(track, part_ms), F.struct(*AT), F.struct("map_x", "map_y", "speed_kmh", "ts_ms")
    x, y, speed, ts = F.col("map_x"), F.col("map_y"), F.col("speed_kmh"), F.col("ts_ms")
    rows = rows.withColumn("__m", _motion(x, y, F.lag("map_x").over(_in_part()), F.lag("map_y").over(_in_part()), speed, ts))
    parts = rows.groupBy("player_id", "__day").agg(F.min_by(place, at).alias("__head"), F.max_by(place, at).alias("__tail"), F.max_by("__m", F.when(F.col("__m").isNotNull(), at)).alias("__inner"))
    last, head = F.lag("__tail").over(_parts()), F.col("__head")
    parts = parts.withColumn("__m0", _motion(head["map_x"], head["map_y"], last["map_x"], last["map_y"], head["speed_kmh"], head["ts_ms"]))
    parts = parts.select("player_id", "__day", F.coalesce(F.col("__m0"), F.last(F.coalesce("__inner", "__m0"), ignorenulls=True).over(_earlier_parts())).alias("__left"))
    rows = _with_parts(rows, parts).withColumn("__l", F.coalesce(F.last("__m", ignorenulls=True).over(_part_so_far()), F.col("__left")))
    fresh = ts - F.col("__l.t") < 3500
    return rows.select(*track.columns, geo.normal_angle(F.when(fresh, F.col("__l.h")).otherwise(F.col("heading"))).alias("motion_heading"))


#: Maximum before the first row.
FIRST_RPM = 8000.0


def _learned(last: float, rpm: float, own: float) -> float:
    return own if own > 1000 else min(12000.0, rpm * 1.08) if rpm > last else last


def _bands_after(bands: list[tuple[float, float]], rpm: float, own: float) -> list[tuple[float, float]]:
    """The maximum after a part as a function of the one before it, one row longer.

    ``bands`` are ``(below, value)``, rising: a maximum under ``below`` becomes the value of the first such band, any other stays.
    """
    if own > 1000:
        return [(float("inf"), own)]
    if bands and not rpm > bands[-1][0] and not any(rpm > value for _, value in bands):
        return bands
    out = []
    for below, value in [*bands, *([(rpm, 0.0)] if not bands or rpm > bands[-1][0] else [])]:
        value = _learned(value, rpm, own)
        if out and out[-1][1] == value:
            out.pop()
        out.append((below, value))
    return out


def rpm_ratio(track: DataFrame, part_ms: int = DAY_MS) -> DataFrame:
    """``rpm_ratio, lit, red`` against a learned maximum: 8000, the engine's own if over 1000, else raised by 8 % of a higher rpm.

    A first pass gives each part of a track as a function of the maximum before it, the functions of a player's parts are applied one
    after another (one small row for each part), and a second pass starts every part with its own maximum. Parts run side by side.
    A row without a player is a track of its own.
    """
    rows = _cut(track.select("player_id", *AT, "rpm", "engine_max_rpm"), part_ms)
    keys = ["player_id", "__day"]

    def sorted_parts(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, *AT)

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, found = None, []
        for f in frames:
            done = []
            for p, d, rpm, own in zip(f["player_id"].tolist(), f["__day"].tolist(), f["rpm"].tolist(), f["engine_max_rpm"].tolist()):
                if (p, d) != part:
                    if part:
                        done.append((*part, [{"below": b, "value": v} for b, v in found]))
                    part, found = (p, d), []
                found = _bands_after(found, rpm, own)
            yield pd.DataFrame(done, columns=[*keys, "bands"])
        if part:
            yield pd.DataFrame([(*part, [{"below": b, "value": v} for b, v in found])], columns=[*keys, "bands"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, learned = None, FIRST_RPM
        for f in frames:
            out = np.empty(len(f))
            for k, (p, d, first, rpm, own) in enumerate(zip(f["player_id"].tolist(), f["__day"].tolist(), f["__first"].tolist(), f["rpm"].tolist(), f["engine_max_rpm"].tolist())):
                if (p, d) != part:
                    part, learned = (p, d), first
                learned = _learned(learned, rpm, own)
                out[k] = min(max(rpm / max(1000.0, learned), 0.0), 1.0)
            lit = np.floor(out * 88 + 0.5).astype("int64")
            yield pd.DataFrame({"player_id": f["player_id"], "seq": f["seq"], "rpm_ratio": out, "lit": lit, "red": np.maximum(lit - 75, 0)})

    parts = sorted_parts(rows.where("player_id is not null")).mapInPandas(bands, "player_id long, __day long, bands array<struct<below: double, value: double>>")
    in_order = parts.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("__day", "bands"))).alias("parts"))

    def step(state: Column, part: Column) -> Column:
        after = F.coalesce(F.get(F.filter(part["bands"], lambda b: state["now"] < b["below"]), F.lit(0))["value"], state["now"])
        return F.struct(after.alias("now"), F.concat(state["firsts"], F.array(F.struct(part["__day"].alias("__day"), state["now"].alias("__first")))).alias("firsts"))

    start = F.struct(F.lit(FIRST_RPM).alias("now"), F.expr("cast(array() as array<struct<__day: bigint, __first: double>>)").alias("firsts"))
    firsts = in_order.select("player_id", F.inline(F.aggregate("parts", start, step)["firsts"]))
    known = _with_parts(rows, firsts).withColumn("__first", F.coalesce("__first", F.lit(FIRST_RPM)))
    return sorted_parts(known).mapInPandas(fold, "player_id long, seq long, rpm_ratio double, lit long, red long")
