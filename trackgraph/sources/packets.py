"""Binary telemetry packets: 88 little-endian fields in the first 323 bytes; further bytes are ignored, shorter packets rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHEELS = ["FrontLeft", "FrontRight", "RearLeft", "RearRight"]


def _wheels(name: str, kind: str) -> list[tuple[str, str]]:
    return [(name + w, kind) for w in WHEELS]


def _axes(name: str) -> list[tuple[str, str]]:
    return [(name + a, "<f4") for a in "XYZ"]


#: Fixed format: names and types of the fields in their order.
FIELDS: list[tuple[str, str]] = [
    ("IsRaceOn", "<i4"), ("TimestampMS", "<u4"), ("EngineMaxRpm", "<f4"), ("EngineIdleRpm", "<f4"), ("CurrentEngineRpm", "<f4"),
    *_axes("Acceleration"), *_axes("Velocity"), *_axes("AngularVelocity"), ("Yaw", "<f4"), ("Pitch", "<f4"), ("Roll", "<f4"),
    *_wheels("NormalizedSuspensionTravel", "<f4"), *_wheels("TireSlipRatio", "<f4"), *_wheels("WheelRotationSpeed", "<f4"),
    *_wheels("WheelOnRumbleStrip", "<i4"), *_wheels("WheelInPuddle", "<i4"), *_wheels("SurfaceRumble", "<f4"), *_wheels("TireSlipAngle", "<f4"),
    *_wheels("TireCombinedSlip", "<f4"), *_wheels("SuspensionTravelMeters", "<f4"),
    ("CarOrdinal", "<i4"), ("CarClass", "<i4"), ("CarPerformanceIndex", "<i4"), ("DrivetrainType", "<i4"), ("NumCylinders", "<i4"),
    ("CarGroup", "<u4"), ("SmashableVelDiff", "<f4"), ("SmashableMass", "<f4"), *_axes("Position"), ("Speed", "<f4"), ("Power", "<f4"), ("Torque", "<f4"),
    *_wheels("TireTemp", "<f4"), ("Boost", "<f4"), ("Fuel", "<f4"), ("DistanceTraveled", "<f4"), ("BestLap", "<f4"), ("LastLap", "<f4"),
    ("CurrentLap", "<f4"), ("CurrentRaceTime", "<f4"), ("LapNumber", "<u2"), ("RacePosition", "u1"), ("Accel", "u1"), ("Brake", "u1"), ("Clutch", "u1"),
    ("HandBrake", "u1"), ("Gear", "u1"), ("Steer", "i1"), ("NormalizedDrivingLine", "i1"), ("NormalizedAIBrakeDifference", "i1")]
PACKET = np.dtype(FIELDS)
assert PACKET.itemsize == 323 and len(FIELDS) == 88
_SQL = {"<i4": "int", "<u4": "long", "<f4": "float", "<u2": "int", "u1": "int", "i1": "int"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}


def decoded(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns of ``raw`` and the 88 fields of every packet that is long enough, decoded a batch at a time."""
    keep = [f for f in raw.schema if f.name != payload]
    names = [f.name for f in keep]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(p[: PACKET.itemsize] for p in batch.column(len(names)).to_pylist()), PACKET)
            fields = [pa.array(rows[n]).cast(_ARROW[_SQL[k]]) for n, k in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *fields], [*names, *[n for n, _ in FIELDS]])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} {_SQL[k]}" for n, k in FIELDS])
    return raw.where(F.length(payload) >= PACKET.itemsize).select(*names, payload).mapInArrow(decode, schema)


def counts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Packets and rejected short packets of each player."""
    short = F.coalesce(F.length(payload) < PACKET.itemsize, F.lit(True))
    return raw.groupBy("player_id").agg(F.count("*").alias("packets"), F.sum(short.cast("long")).alias("dropped_short"))


def encoded(track: DataFrame) -> DataFrame:
    """Packets of a track, for tests: ``player_id, payload``; every 50th packet of a player is cut short."""
    columns = {"ts_ms": "TimestampMS", "position_x": "PositionX", "position_y": "PositionY", "position_z": "PositionZ", "speed_mps": "Speed", "yaw_rad": "Yaw", "brake_raw": "Brake", "accel_raw": "Accel", "gear": "Gear", "distance_traveled_m": "DistanceTraveled"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(len(batch), PACKET)
            for name, field in columns.items():
                rows[field] = batch.column(name).to_numpy(zero_copy_only=False)
            cut = batch.column("seq").to_numpy(zero_copy_only=False) % 50 == 0
            payload = [r.tobytes() + b"\0" if not c else r.tobytes()[:322] for r, c in zip(rows, cut)]
            yield pa.RecordBatch.from_arrays([batch.column("player_id"), pa.array(payload, pa.binary())], ["player_id", "payload"])

    return track.select("player_id", "seq", *columns).mapInArrow(encode, "player_id long, payload binary")
