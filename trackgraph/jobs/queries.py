"""The library's operators as queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.functions.storage import shared_dir, staged
from trackgraph.jobs import mask_oracles, more_oracles, oracles, raster_oracles, repair_oracles
from trackgraph.operators import events, graph, network, poi, progress, raster, routing
from trackgraph.operators import telemetry as tracks
from trackgraph.sources import adapters, packets
from trackgraph.streaming import tracks as streams

FACTORS = {"white": 1.0, "orange": 1.08, "orange_dashed": 2.6, "unknown": 9.5}
AS_OF_MS = 100_000


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def trip_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.trips(tracks.held(adapters.telemetry(spark, sf_dir)))
    out = rows.groupBy("player_id").agg(F.max_by("trip_km", "seq").alias("trip_km"), F.max("trip_km").alias("longest_km"), F.count("*").alias("packets"))
    return _round(out, "trip_km", "longest_km")


def telemetry_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(tracks.held(adapters.telemetry(spark, sf_dir)))


def _held(rows: DataFrame) -> DataFrame:
    out = rows.select("player_id", "seq", "packet_count", "paused", "accepted", "position_x", "map_x", "map_y", "heading", "speed_kmh", "throttle", "brake")
    return _round(out, "map_x", "map_y", "heading", "speed_kmh", "throttle", "brake")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(tracks.latest(tracks.held(adapters.telemetry(spark, sf_dir))))


def _latest(rows: DataFrame) -> DataFrame:
    return _round(rows.select("player_id", "seq", "ts_ms", "map_x", "map_y", "gear", "packet_count", "paused"), "map_x", "map_y")


def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.held(adapters.telemetry(spark, sf_dir))
    return tracks.liveness(rows.select("player_id").distinct(), rows, AS_OF_MS)


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.live_sessions(adapters.telemetry(spark, sf_dir))


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(tracks.heartbeat(adapters.telemetry(spark, sf_dir)), "speed_mps")


def motion_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.motion_heading(tracks.held(adapters.telemetry(spark, sf_dir)))
    return _round(rows.select("player_id", "seq", "motion_heading"), "motion_heading", digits=5)


def rpm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.rpm_ratio(adapters.telemetry(spark, sf_dir))


def crash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.crash_candidates(tracks.held(adapters.telemetry(spark, sf_dir)))


def jump_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.jump_candidates(tracks.held(adapters.telemetry(spark, sf_dir)))


def drive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drive_events(tracks.held(adapters.telemetry(spark, sf_dir)))


def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.decoded(packets.encoded(adapters.telemetry(spark, sf_dir))).select("player_id", "TimestampMS", "PositionX", "Speed", "Brake", "Gear", "DistanceTraveled")


def packet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.counts(packets.encoded(adapters.telemetry(spark, sf_dir)))


def scalar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.telemetry(spark, sf_dir)
    d = F.col("distance_traveled_m")
    return t.select(
        "player_id", "seq", geo.gear_label(F.col("gear") - 1).alias("gear_label"), geo.distance_label(d).alias("distance_label"),
        geo.eta_minutes(d, F.col("speed_mps") * 3.6).cast("long").alias("eta"), F.round(geo.normal_angle(F.col("velocity_x") * 50), 6).alias("angle"),
        geo.grid_index(F.col("position_x"), 10).alias("grid_x"), geo.cell(F.col("position_z") - 500).alias("cell_z"), F.round(geo.pixels(geo.metres(d)), 6).alias("there_and_back"))


def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.markers(spark, sf_dir).withColumn("zoom", F.explode(F.sequence(F.lit(geo.MIN_ZOOM), F.lit(geo.MAX_ZOOM))))
    return m.groupBy("zoom", geo.tile(F.col("map_x"), F.col("zoom")).alias("tile_x"), geo.tile(F.col("map_y"), F.col("zoom")).alias("tile_y")).agg(F.count("*").alias("markers"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.requests(spark, sf_dir)
    return r.select(F.col("request_id").alias("box_id"), (F.col("start_x") * 30).alias("x0"), (F.col("start_y") * 40).alias("y0"), (F.col("start_x") * 30 + 3000).alias("x1"), (F.col("start_y") * 40 + 2500).alias("y1"))


def box_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(15)
    b = _boxes(spark, sf_dir).withColumn("tile_x", F.explode(geo.covering_tiles(F.col("x0"), F.col("x1"), z)))
    return b.withColumn("tile_y", F.explode(geo.covering_tiles(F.col("y0"), F.col("y1"), z))).select("box_id", "tile_x", "tile_y")


def markers_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi.in_boxes(_boxes(spark, sf_dir), adapters.markers(spark, sf_dir), pad=50)


def marker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.markers(spark, sf_dir)
    r = adapters.requests(spark, sf_dir)
    q = r.select(F.col("request_id").alias("query_id"), F.concat(F.lit("  Brand#"), (F.col("request_id") % 5 + 1).cast("string"), F.lit(" "), (F.col("request_id") % 7).cast("string")).alias("text"), (F.col("start_x") * 40).alias("x"), (F.col("start_y") * 50).alias("y"))
    return poi.search(q, m, 25).select("query_id", "file_order", "distance", F.col("rank").cast("long").alias("rank"))


def _nearest_markers(spark: SparkSession, sf_dir: str, radius: float | None) -> DataFrame:
    r = adapters.requests(spark, sf_dir).select("request_id", (F.col("start_x") * 40).alias("x"), (F.col("start_y") * 50).alias("y"))
    out = poi.nearest(r, adapters.markers(spark, sf_dir), "request_id", "file_order", k=4, radius=radius)
    return _round(out.select("request_id", "file_order", "distance", F.col("rank").cast("long").alias("rank")), "distance")


def nearest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_markers(spark, sf_dir, 5000.0)


def nearest_markers_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_markers(spark, sf_dir, None)


def marker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.requests(spark, sf_dir).withColumn("needle", (F.col("request_id") * 3 % 211).cast("string"))
    return poi.lookup(r, adapters.markers(spark, sf_dir))


def marker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = poi.category_label(poi.marker_key(adapters.markers(spark, sf_dir)), {"PROMO BRUSHED TIN": "tin", "ECONOMY ANODIZED STEEL": "steel"})
    return m.select("file_order", "key", "label")


def marker_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi.categories(adapters.markers(spark, sf_dir))


def road_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(raster.cell_ratios(adapters.pixels(spark, sf_dir)), "road_ratio", "white_ratio", "orange_ratio")


def road_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(raster.grid_nodes(raster.cell_ratios(adapters.pixels(spark, sf_dir))), "road_ratio", "white_ratio", "orange_ratio")


def _blobs(spark: SparkSession, sf_dir: str, tile: int | None) -> DataFrame:
    """Blobs of the clean masks of white and orange pixels, with their shapes."""
    m = raster.colour_masks(F.col("r"), F.col("g"), F.col("b"), F.col("alpha"))
    placed, out = raster.on_the_map(adapters.strokes(spark, sf_dir)), []
    for kind, shape in (("white", raster.WHITE_SHAPE), ("orange", raster.ORANGE_SHAPE)):
        runs = staged(raster.smoothed_runs(placed.where(m[kind]), tile), "runs")
        first = raster.road_blobs(runs, shape, tile).groupBy("blob", "area", "width", "height", "kept").agg(F.min("x0").alias("left"), F.min("y").alias("top"))
        out.append(first.select(F.lit(kind).alias("kind"), "left", "top", "width", "height", "area", "kept"))
    return out[0].unionByName(out[1])


def tile_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir, geo.TILE_SIZE)


def map_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that may cross the borders of tiles."""
    return _blobs(spark, sf_dir, None)


def clean_road_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(raster.grid_nodes(raster.clean_cell_ratios(adapters.strokes(spark, sf_dir))), "road_ratio", "white_ratio", "orange_ratio")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.neighbour_edges(adapters.nodes(spark, sf_dir), FACTORS)


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def road_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.class_counts(adapters.nodes(spark, sf_dir), "nodes").unionByName(graph.class_counts(_edges(spark, sf_dir), "edges"))


def normalised_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in mixed spelling, doubled in the other direction, some without length, cost or class."""
    e = _edges(spark, sf_dir)
    k = (F.col("a") * 31 + F.col("b") * 17) % 7
    kind = F.when(k == 0, F.lit(None)).when(k == 1, " Magenta ").when(k == 2, "Orange-Dashed").otherwise(F.col("road_class"))
    one = e.select("a", "b", F.when(k != 3, F.col("length")).alias("length"), F.when(k != 4, F.col("cost")).alias("cost"), kind.alias("road_class"), F.lit(0).alias("seq"))
    two = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("length"), (F.col("cost") * 0.9 + k).alias("cost"), F.lit("white").alias("road_class"), F.lit(1).alias("seq"))
    dangling = e.where(k == 5).select(F.col("a"), (F.col("b") + 10_000_000).alias("b"), "length", "cost", "road_class", F.lit(2).alias("seq"))
    return _round(graph.normalised_edges(one.unionByName(two).unionByName(dangling), adapters.nodes(spark, sf_dir), in_order=False), "length", "cost")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = staged(adapters.nodes(spark, sf_dir), "nodes"), staged(_edges(spark, sf_dir), "edges")
    return nodes, edges, staged(graph.node_components(nodes, edges), "components")


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[2]


def graph_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.status(*_graph(spark, sf_dir))
    return s.select("nodes", "edges", "components", F.concat_ws(",", F.transform("largest", lambda n: n.cast("string"))).alias("largest"))


def _islands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, graph.Repair]:
    nodes = staged(adapters.islands(spark, sf_dir), "nodes")
    edges = staged(raster.neighbour_edges(nodes, FACTORS), "edges")
    return edges, graph.repaired(nodes, edges, adapters.header(spark, sf_dir))


def graph_stitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)[1].stitches


def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_islands(spark, sf_dir)[1].bridges, "length")


def graph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, repair = _islands(spark, sf_dir)
    out = graph.repair_status(graph.resolved_edges(edges.withColumn("seq", F.col("a")), repair.nodes), repair)
    return out.withColumn("largest", F.concat_ws(",", F.transform("largest", lambda n: n.cast("string"))))


def parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three edges for each pair of neighbours, of other classes, whose stored costs are not those of their classes."""
    e = _edges(spark, sf_dir)
    k = (F.col("a") * 31 + F.col("b") * 17) % 7
    row = lambda a, b, length, cost, kind, seq: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), length.alias("length"), cost.alias("cost"), kind.alias("road_class"), F.lit(seq).alias("seq"))
    given = F.col("length")
    rows = [row("a", "b", given, F.col("cost") * (1 + k), F.col("road_class"), 0), row("b", "a", given + k, given * 2, F.lit("orange_dashed"), 1), row("a", "b", given * 0.5, given * (0.4 + k), F.when(k < 4, "white").otherwise("orange"), 2)]
    made = e.select(F.explode(F.when(k == 6, F.array(rows[0])).when(k == 5, F.array(*rows[:2])).otherwise(F.array(*rows))).alias("r")).select("r.*")
    return _round(graph.normalised_edges(made, adapters.nodes(spark, sf_dir)), "length", "cost")


def _repaired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = staged(adapters.nodes(spark, sf_dir), "nodes"), staged(_edges(spark, sf_dir), "edges")
    repair = graph.repaired(nodes, edges, adapters.header(spark, sf_dir))
    return repair.nodes, repair.edges, repair.components


def _snapped_nodes(spark: SparkSession, sf_dir: str, most: int, radius: float) -> DataFrame:
    nodes = adapters.nodes(spark, sf_dir)
    out = routing.snapped(adapters.requests(spark, sf_dir), nodes, "start", most, radius)
    return _round(out.select("request_id", "node_id", "distance", F.col("rank").cast("long").alias("rank")), "distance")


def snapped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapped_nodes(spark, sf_dir, 10, 900.0)


def snapped_nodes_for_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapped_nodes(spark, sf_dir, routing.SNAP_MOST, routing.SNAP_RADIUS)


def _pairs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nodes, edges, components = _repaired(spark, sf_dir)
    r = adapters.requests(spark, sf_dir)
    start, goal = (staged(routing.snapped(r, nodes, end), "snaps") for end in ("start", "target"))
    pairs = staged(routing.candidate_pairs(start, goal, components), "pairs")
    return {"nodes": nodes, "requests": r, "start": start, "goal": goal, "pairs": pairs, "costs": staged(routing.profile_costs(edges), "costs")}


def _routes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    x = _pairs(spark, sf_dir)
    paths = routing.shortest_paths(x["pairs"], x["costs"], x["nodes"])
    return x | {"paths": paths, "routes": staged(routing.scored_routes(x["pairs"], paths, x["costs"], x["requests"]), "routes")}


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, components = _repaired(spark, sf_dir)
    r = adapters.requests(spark, sf_dir)
    out = routing.candidate_pairs(*(routing.snapped(r, nodes, end) for end in ("start", "target")), components)
    return _round(out.withColumn("pair_rank", F.col("pair_rank").cast("long")), "s_snap", "g_snap", "score")


def path_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost and the number of nodes' edges of each pair's path in each profile; paths are summed up edge by edge."""
    x = _pairs(spark, sf_dir)
    paths = routing.shortest_paths(x["pairs"], x["costs"], x["nodes"])
    hop = paths.withColumn("b", F.lead("node").over(Window.partitionBy("s", "g", "profile").orderBy("pos"))).join(x["costs"].select("profile", F.col("a").alias("node"), "b", F.col("cost").alias("w")), ["profile", "node", "b"], "left")
    out = hop.groupBy("s", "g", "profile").agg(F.any_value("cost").alias("cost"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("by_edges"))
    return _round(out, "cost", "by_edges", digits=5)


def best_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _routes(spark, sf_dir)
    return _round(x["routes"].withColumn("metres", F.col("metres").cast("long")), "length", "physical", "direct", "route_score")


def route_road_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _routes(spark, sf_dir)
    return routing.road_profile(x["routes"], x["paths"], x["costs"])


def route_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _routes(spark, sf_dir)
    return routing.outcomes(x["requests"], x["start"], x["goal"], x["pairs"], x["routes"])


def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _routes(spark, sf_dir)
    return routing.simplified(routing.polylines(x["routes"], x["paths"], x["nodes"], x["requests"]))


def route_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _routes(spark, sf_dir)
    texts = routing.profile_texts(x["routes"], routing.road_profile(x["routes"], x["paths"], x["costs"]))
    lines = routing.simplified(routing.polylines(x["routes"], x["paths"], x["nodes"], x["requests"]))
    return routing.route_metrics(x["routes"], x["paths"], lines).join(texts, "request_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes for the progress queries: four corners from each request's place."""
    r = adapters.requests(spark, sf_dir)
    at = lambda k, dx, dy: F.struct(F.lit(k).alias("pos"), (F.col("start_x") * 2 + 10000 + dx).alias("x"), (10000 - F.col("start_y") * 2 + dy).alias("y"))
    return r.select(F.col("request_id").alias("route_id"), F.explode(F.array(at(0, 0, 0), at(1, 300, -100), at(2, 500, 200), at(3, 900, 150))).alias("p")).select("route_id", "p.*")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.requests(spark, sf_dir).count()
    t = tracks.held(adapters.telemetry(spark, sf_dir)).select("player_id", "seq", "ts_ms", (F.col("player_id") % n + 1).alias("route_id"), "map_x", "map_y", "speed_kmh")
    return progress.nearest_segment(t, progress.segments(_lines(spark, sf_dir)))


def route_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _progress(spark, sf_dir).select("player_id", "seq", "pos", "off", "px", "py", "t", "remaining")
    return _round(out, "off", "px", "py", "t", "remaining", digits=8)


def off_route_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.off_route_episodes(_progress(spark, sf_dir), limit=300.0)
    return _round(out, "max_off", digits=8)


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = progress.segments(_lines(spark, sf_dir))
    wanted = s.select("route_id").distinct().withColumn("want", F.explode(F.array(*[F.lit(float(v)) for v in (0, 100, 316.5, 700, 5000)])))
    return _round(progress.point_at(wanted, s), "x", "y")


def look_ahead_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.look_ahead(_progress(spark, sf_dir), progress.vertices(_lines(spark, sf_dir)))
    return _round(out.select("player_id", "seq", "look_px", "look_x", "look_y"), "look_px", "look_x", "look_y")


def arrivals_at_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by the least of the straight way and the rest of the route, at targets near the tracks."""
    k = F.col("request_id")
    targets = adapters.requests(spark, sf_dir).select(k.alias("route_id"), (k % 60 + 10400).cast("double").alias("target_x"), (9840 - k % 40).cast("double").alias("target_y"))
    return progress.arrivals(progress.to_target(_progress(spark, sf_dir), progress.vertices(_lines(spark, sf_dir)), targets))


def client_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth player has an error; one player for each user that no packet came from is waiting."""
    rows = tracks.held(adapters.telemetry(spark, sf_dir))
    known = rows.select("player_id").distinct().select("player_id", (F.col("player_id") % 10 == 0).alias("failed"))
    silent = known.select((F.col("player_id") + 1_000_000_000).alias("player_id"), F.lit(None).cast("boolean").alias("failed"))
    return tracks.client_status(known.unionByName(silent), rows, AS_OF_MS // 20)


def direct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.requests(spark, sf_dir)
    none = r.limit(0).select("request_id")
    out = routing.direct_routes(r).join(routing.outcomes(r, none, none, none, none, has_graph=False), "request_id")
    return out.select("request_id", "outcome", "distance_px", "metres", F.size("points").alias("points"))


def _to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("player_id", "ts_ms", "speed_kmh", (F.col("off") / 10).alias("px"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.arrivals(_to_target(spark, sf_dir))


def _off_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("player_id", "ts_ms", "off", F.col("remaining").alias("to_target"), "map_x", "map_y")


def reroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.reroutes(_off_routes(spark, sf_dir))


def suspicious_reroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir).select("player_id", "seq", "off", "remaining", (F.col("remaining") + F.col("seq") * 9).alias("new_length"), (F.col("seq") % 50 * 1000).alias("off_ms"), (F.col("seq") % 13 == 0).alias("forced"))
    return progress.suspicious(rows).select("player_id", "seq", "rejected")


def _replayed(rows: DataFrame) -> tuple[DataFrame, str]:
    """A stream over a table of ``rows`` and a packet far behind them, which lets the watermark pass all others; its folder."""
    spark, columns = rows.sparkSession, rows.columns
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/source")
    last = spark.read.parquet(f"{folder}/source").agg(F.max_by(F.struct(*columns), "ts_ms").alias("r")).select("r.*")
    closing = last.withColumns({"player_id": F.lit(-1).cast("long"), "ts_ms": F.col("ts_ms") + 3_600_000})
    closing.write.mode("append").parquet(f"{folder}/source")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/source"), folder


def _streamed(stream: DataFrame, folder: str) -> DataFrame:
    streams.appended(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").where("player_id <> -1")


def stream_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(adapters.telemetry(spark, sf_dir))
    return _held(_streamed(streams.held(source), folder))


def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(tracks.held(adapters.telemetry(spark, sf_dir)))
    return _round(_streamed(streams.heartbeat(source), folder), "speed_mps")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(adapters.telemetry(spark, sf_dir))
    return _streamed(streams.live_sessions(source), folder)


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(tracks.held(adapters.telemetry(spark, sf_dir)))
    writer = source.writeStream.foreachBatch(streams.latest_sink(spark, f"{folder}/latest")).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _latest(streams.read_latest(spark, f"{folder}/latest")).where("player_id <> -1")


def stream_drive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(tracks.held(adapters.telemetry(spark, sf_dir)))
    writer = source.writeStream.foreachBatch(streams.event_sink(spark, folder)).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.EVENT).parquet(f"{folder}/events").drop("batch").where("player_id <> -1")


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(_to_target(spark, sf_dir))
    return _streamed(streams.arrivals(source), folder)


def stream_reroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = _replayed(_off_routes(spark, sf_dir))
    return _streamed(streams.reroutes(source), folder)


LABELS = {"PROMO": "tin offer", "ECONOMY": "steel"}


def remaining_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = progress.remaining_route(_progress(spark, sf_dir), progress.vertices(_lines(spark, sf_dir)))
    return _round(out.select("player_id", "seq", "points", "length"), "length")


def grid_unique_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.nodes(spark, sf_dir)
    known = F.col("node_id") % 3 == 0
    n = n.select("node_id", F.when(known, F.floor(F.col("gx") / 2)).alias("gx"), F.when(known, F.floor(F.col("gy") / 2)).alias("gy"), "map_x", "map_y")
    return graph.one_for_each_cell(n, 20.0)


def detected_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made of the orders: a version and a detection entry."""
    k = F.col("o_orderkey")
    version = F.concat(F.when(k % 4 == 0, "manual-").when(k % 4 == 1, "CV-").otherwise("v"), k.cast("string"))
    detection = F.when(k % 3 == 0, "{ }").when(k % 3 == 1, F.concat(F.lit('{"n": '), k.cast("string"), F.lit("}")))
    return adapters.table(spark, sf_dir, "orders").select(k.alias("graph_id"), graph.from_detection(version, detection).alias("detected"))


def edit_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit file for each order: as many strokes as its key has beyond the last multiple of four, of types by its priority."""
    k = F.col("o_orderkey")
    stroke = F.when(F.col("o_orderpriority") != "", F.concat(F.lit('{"type": "'), F.col("o_orderpriority"), F.lit('"}'))).otherwise("{}")
    strokes = F.array_join(F.array_repeat(F.when(k % 5 == 0, "{}").otherwise(stroke), (k % 4).cast("int")), ",")
    return graph.edit_strokes(adapters.table(spark, sf_dir, "orders").select(F.concat(F.lit('{"kind": "edits", "strokes": ['), strokes, F.lit("]}")).alias("value")))


def client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("request_id")
    text = F.when(k % 3 == 0, "Tin").when(k % 3 == 1, F.concat(F.lit("brand#"), (k % 5 + 1).cast("string"))).otherwise("x")
    q = adapters.requests(spark, sf_dir).select(k.alias("query_id"), text.alias("text"), F.when(k % 2 == 0, "PROMO").alias("category"), (F.col("start_x") * 40).alias("x"), (F.col("start_y") * 50).alias("y"))
    return poi.client_search(q, adapters.markers(spark, sf_dir), LABELS).select("query_id", "file_order", "distance", F.col("rank").cast("long").alias("rank"))


def markers_in_boxes_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poi.in_boxes(_boxes(spark, sf_dir), adapters.markers(spark, sf_dir), pad=50, category="PROMO")
    return out.select("box_id", "file_order", F.col("rank").cast("long").alias("rank"))


def mask_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.blobs(adapters.mask(spark, sf_dir)).select("x", "y", "size", "kept")


def _skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(network.blobs(adapters.mask(spark, sf_dir)).where("kept").select("x", "y"), "skeleton")


def mask_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(_skeleton(spark, sf_dir))


def mask_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.chains(_skeleton(spark, sf_dir)).where("not loop")
    return _round(out.select("start", "first", "pos", "x", "y", "along"), "along", digits=4)


def ring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains and loops of pixels of open and closed diamonds."""
    out = network.chains(staged(adapters.rings(spark, sf_dir), "rings"))
    return _round(out.select("loop", "start", "first", "pos", "x", "y", "along"), "along", digits=4)


def mask_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_classes(spark, sf_dir, _skeleton(spark, sf_dir))


def _mask_classes(spark: SparkSession, sf_dir: str, points: DataFrame) -> DataFrame:
    size = adapters.mask_size(spark, sf_dir)
    return network.pixel_classes(points, network.orange_hint(adapters.mask(spark, sf_dir), size), size)


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = _skeleton(spark, sf_dir)
    classes = staged(_mask_classes(spark, sf_dir, points), "classes")
    return network.segments(network.chains(points), classes), classes


def mask_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.edges(_pieces(spark, sf_dir)[0], FACTORS)


def mask_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousandths = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_thousandths")
    return network.nodes(*_pieces(spark, sf_dir)).select("id", thousandths("map_x"), thousandths("map_y"), "road_class", "source_x", "source_y")


QUERIES = [
    remaining_routes, grid_unique_nodes, detected_graphs, edit_strokes, client_search, markers_in_boxes_of_category, mask_blobs, mask_degrees, mask_chains, ring_chains, mask_classes, mask_edges, mask_nodes,
    trip_leaders, telemetry_hold, latest_snapshot, liveness, live_sessions, heartbeat, motion_heading, rpm_ratio, crash_candidates, jump_candidates,
    drive_events, packet_decode, packet_counts, scalar_labels, tile_pyramid, box_tiles, markers_in_boxes, marker_search, nearest_markers, nearest_markers_anywhere, marker_lookup,
    marker_labels, marker_categories, road_cells, road_grid, tile_blobs, map_blobs, clean_road_grid, grid_edges, road_class_counts, normalised_edges, graph_components, graph_status,
    graph_stitches, graph_bridges, graph_repair, parallel_edges, snapped_nodes, snapped_nodes_for_routing, candidate_pairs, path_costs, best_routes, route_road_profile, route_outcomes, route_lines, route_texts, direct_routes, look_ahead_points, arrivals_at_targets, client_status, route_progress,
    off_route_episodes, route_points, arrivals, reroutes, suspicious_reroutes, stream_hold, stream_heartbeat,
    stream_sessions, stream_latest, stream_drive_events, stream_arrivals, stream_reroutes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    sql = oracles.all_sql() | mask_oracles.sql() | more_oracles.sql() | repair_oracles.sql() | raster_oracles.sql()
    sql["drive_events"] = more_oracles.drive_events(sql["crash_candidates"], sql["jump_candidates"])
    # a stream's rows equal those of its batch twin
    return sql | {
        "stream_drive_events": sql["drive_events"], "stream_reroutes": sql["reroutes"],
        "stream_hold": sql["telemetry_hold"], "stream_heartbeat": sql["heartbeat"], "stream_latest": sql["latest_snapshot"], "stream_arrivals": sql["arrivals"],
        "stream_sessions": f"SELECT player_id, start_ms, end_ms, packets FROM ({sql['live_sessions']})"}
