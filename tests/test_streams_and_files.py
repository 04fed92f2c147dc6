import json

from pyspark.sql import functions as F

from trackgraph.operators import events, progress
from trackgraph.operators import telemetry as tracks
from trackgraph.sources import adapters, files, packets
from trackgraph.streaming import tracks as streams

DATA = "/root/testdata/sf0.001"


def _stream(spark, table, *parts, folder):
    """A stream with one micro-batch for each part."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{table}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{table}")


def _rows(df, *columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


def _closed(track):
    """The track and a packet far behind it, which lets the watermark pass all others."""
    last = track.agg(F.max("ts_ms")).first()[0]
    one = track.limit(1).withColumns({"player_id": F.lit(-1).cast("long"), "ts_ms": F.lit(last + 3_600_000).cast("long")})
    return track, one


def test_streams_equal_their_batch_twins(spark, tmp_path):
    folder = str(tmp_path)
    track = adapters.telemetry(spark, DATA)
    want = tracks.held(track).cache()
    streams.appended(streams.held(_stream(spark, "track", track.where("ts_ms < 3000"), track.where("ts_ms >= 3000"), folder=folder)), f"{folder}/held")
    got = spark.read.parquet(f"{folder}/held/rows")
    assert sorted(got.columns) == sorted(want.columns) and _rows(got, *want.columns) == _rows(want, *want.columns)

    streams.appended(streams.heartbeat(_stream(spark, "beats", *_closed(want), folder=folder)), f"{folder}/beat")
    names = ["player_id", "beat", "packets", "speed_mps", "age_ms"]
    assert _rows(spark.read.parquet(f"{folder}/beat/rows").where("player_id >= 0"), *names) == _rows(tracks.heartbeat(track), *names)

    streams.appended(streams.live_sessions(_stream(spark, "sessions", *_closed(track), folder=folder)), f"{folder}/runs")
    names = ["player_id", "start_ms", "end_ms", "packets"]
    assert _rows(spark.read.parquet(f"{folder}/runs/rows").where("player_id >= 0"), *names) == _rows(tracks.live_sessions(track), *names)

    source = _stream(spark, "snapshots", want.where("ts_ms >= 3000"), want.where("ts_ms < 3000"), folder=folder)
    source.writeStream.foreachBatch(streams.latest_sink(spark, f"{folder}/latest")).option("checkpointLocation", f"{folder}/sink").trigger(availableNow=True).start().awaitTermination()
    assert _rows(streams.read_latest(spark, f"{folder}/latest"), *want.columns) == _rows(tracks.latest(want), *want.columns)


def test_event_and_route_streams_equal_their_batch_twins(spark, tmp_path):
    folder = str(tmp_path)
    held = tracks.held(adapters.telemetry(spark, DATA)).cache()
    middle = held.selectExpr("percentile(ts_ms, array(0.35, 0.7))").first()[0]
    parts = lambda df: [df.where(F.col("ts_ms") < middle[0]), df.where(F.col("ts_ms").between(middle[0], middle[1])), df.where(F.col("ts_ms") > middle[1])]
    source = _stream(spark, "rows", *parts(held), folder=folder)
    source.writeStream.foreachBatch(streams.event_sink(spark, folder)).option("checkpointLocation", f"{folder}/told").trigger(availableNow=True).start().awaitTermination()
    names = ["player_id", "seq", "ts_ms", "event"]
    got = spark.read.parquet(f"{folder}/events")
    assert _rows(got, *names) == _rows(events.drive_events(held), *names) and got.select("batch").distinct().count() == 3

    place = held.select("player_id", "ts_ms", "speed_kmh", F.abs(F.col("map_x") % 400).alias("px"), F.when(F.col("seq") % 9 != 0, F.abs(F.col("map_y") % 900)).alias("off"), F.abs(F.col("map_x") % 700).alias("to_target"), "map_x", "map_y").cache()
    for name, columns in (("arrivals", ["player_id", "arrived_ms"]), ("reroutes", ["player_id", "ts_ms", "reason"])):
        streams.appended(getattr(streams, name)(_stream(spark, f"{name}-in", *parts(place), folder=folder)), f"{folder}/{name}")
        want = _rows(getattr(progress, name)(place), *columns)
        assert want and _rows(spark.read.parquet(f"{folder}/{name}/rows"), *columns) == want


def test_packets_become_a_track(spark):
    track = adapters.telemetry(spark, DATA).where("seq < 60")
    got = streams.track_of_packets(packets.encoded(track).withColumn("seq", F.lit(1).cast("long")))
    assert got.columns == track.columns[:3] + [c for c in got.columns if c not in track.columns[:3]]
    assert _rows(got, "player_id", "ts_ms", "gear", "brake_raw", "position_x") == _rows(track.where("seq <> 50"), "player_id", "ts_ms", "gear", "brake_raw", "position_x")


def test_marker_and_calibration_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"markerId": "a", "title": "T", "map_x": 1.5}, {"id": "b"}]')
    (tmp_path / "bad.json").write_text('"no list"')
    assert _rows(files.read_markers(spark, f"{tmp_path}/m.json"), "markerId", "id", "map_x") == [("a", None, 1.5), (None, "b", None)]
    assert files.read_markers(spark, f"{tmp_path}/bad.json").count() == files.read_markers(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "c.csv").write_text("﻿name,forza_x,forza_z,yaw_deg,map_x,map_y\np,1,-2.5,,3,4\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_calibration(spark, f"{tmp_path}/c.csv").collect()] == [("p", 1.0, -2.5, None, 3.0, 4.0)]


def test_graph_files(spark, tmp_path):
    graph = {"version": "cv-1", "stride_px": 10, "nodes": [{"id": "n", "map_x": 1, "map_y": 2, "kind": "Magenta"}, [3, 4], {"id": "lost"}, {"x": 5, "y": 6}], "edges": [["n", "1", 7.5], {"a": "1", "b": "3", "length": 2}]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges, header = files.read_graph(spark, f"{tmp_path}/g.json")
    assert _rows(nodes, "node_id", "map_x", "map_y", "road_class") == [("1", 3.0, 4.0, "unknown"), ("3", 5.0, 6.0, "unknown"), ("n", 1.0, 2.0, "white")]
    assert _rows(edges, "seq", "a", "b", "length", "cost") == [(0, "n", "1", None, 7.5), (1, "1", "3", 2.0, None)]
    assert header.first().version == "cv-1"
    files.write_graph(nodes, edges.fillna("unknown", ["road_class"]), {"version": "v"}, f"{tmp_path}/out")
    line = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/out/header").collect()))
    assert line == {"version": "v", "node_class_counts": {"unknown": 2, "white": 1}, "edge_class_counts": {"unknown": 2}}
    files.write_table(nodes, f"{tmp_path}/table", "road_class")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 3
