"""The queries in ANSI SQL over the same tables, for comparison in another engine."""

from __future__ import annotations

TELEMETRY = """e AS (SELECT user_id AS player_id, event_id AS i, least(coalesce(value, 0.0), 400.0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
t AS (SELECT player_id, s AS seq, s * 100 + s // 20 * 2000 AS ts_ms, CAST(s * 3 + i % 17 AS DOUBLE) AS position_x, (i * 11 % 50) / 10 AS position_y, CAST(s * 2 - i % 13 AS DOUBLE) AS position_z,
 (CASE WHEN s % 11 = 0 THEN 0.0 ELSE v END) / 3.6 AS speed_mps, CAST(i % 21 - 10 AS DOUBLE) AS velocity_x, (i * 7 % 41 - 20) / 10 AS velocity_y, CAST(i % 19 - 9 AS DOUBLE) AS velocity_z, (i % 628) / 100 AS yaw_rad,
 CAST(CASE WHEN s % 11 = 0 THEN 0 ELSE i % 7 END AS INT) AS gear, CAST(CASE WHEN s % 37 = 0 THEN 0 ELSE s * 10 % 4000 END AS DOUBLE) AS odometer, i * 29 % 256 AS accel_raw, i * 13 % 256 AS brake_raw FROM e)"""
_W = "PARTITION BY player_id ORDER BY ts_ms, seq"
HELD = f"""{TELEMETRY},
h0 AS (SELECT *, row_number() OVER ({_W}) AS packet_count, speed_mps <= 0.2 AND gear = 0 AS paused, position_x * 0.652837 + position_z * 0.000763 + 10387.027 AS mx, position_x * -0.003754 + position_z * -0.657135 + 9846.097 AS my,
 CASE WHEN speed_mps > 1.5 THEN velocity_x ELSE sin(yaw_rad) END AS hx, CASE WHEN speed_mps > 1.5 THEN velocity_z ELSE cos(yaw_rad) END AS hz FROM t),
h1 AS (SELECT *, NOT paused OR packet_count = 1 AS accepted, degrees(atan2(hx * 0.652837 + hz * 0.000763, -(hx * -0.003754 + hz * -0.657135))) AS hd FROM h0),
h AS (SELECT player_id, seq, ts_ms, speed_mps, gear, accel_raw, brake_raw, velocity_y, packet_count, paused, accepted,
 {", ".join(f"last_value(CASE WHEN accepted THEN {src} END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS {dst}" for src, dst in [("position_x", "position_x"), ("position_y", "position_y"), ("position_z", "position_z"), ("mx", "map_x"), ("my", "map_y"), ("hd", "heading")])},
 speed_mps * 3.6 AS speed_kmh, accel_raw / 255.0 * 100.0 AS throttle, brake_raw / 255.0 * 100.0 AS brake FROM h1)"""
MARKERS = """m AS (SELECT p_partkey AS file_order, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS marker_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 100 AS VARCHAR) END AS id,
 p_name AS title, p_type AS category, p_brand AS parent_category, CAST(p_partkey * 7919 % 20000 AS DOUBLE) AS map_x, CAST(p_partkey * 104729 % 20000 AS DOUBLE) AS map_y FROM part)"""
REQUESTS = """r AS (SELECT s_suppkey AS request_id, CAST(s_suppkey * 37 % 500 AS DOUBLE) AS start_x, CAST(s_suppkey * 53 % 400 AS DOUBLE) AS start_y, CAST((s_suppkey * 91 + s_nationkey * 17) % 500 AS DOUBLE) AS target_x, CAST((s_suppkey * 71 + s_nationkey * 29) % 400 AS DOUBLE) AS target_y FROM supplier)"""
NODES = """n AS (SELECT p_partkey AS node_id, p_partkey % 50 AS gx, p_partkey // 50 AS gy, CAST(p_partkey % 50 * 10 AS DOUBLE) AS map_x, CAST(p_partkey // 50 * 10 AS DOUBLE) AS map_y,
 CASE WHEN p_size < 35 THEN 'white' WHEN p_size < 45 THEN 'orange' ELSE 'orange_dashed' END AS road_class, CASE WHEN p_size < 35 THEN 0 WHEN p_size < 45 THEN 1 ELSE 2 END AS rank FROM part WHERE p_size > 12)"""
EDGES = NODES + """,
d(x, y) AS (VALUES (1, 0), (0, 1), (1, 1), (1, -1)),
g0 AS (SELECT a.node_id AS a, b.node_id AS b, sqrt((a.map_x - b.map_x) * (a.map_x - b.map_x) + (a.map_y - b.map_y) * (a.map_y - b.map_y)) AS exact, CASE WHEN b.rank > a.rank THEN b.road_class ELSE a.road_class END AS road_class
 FROM n a CROSS JOIN d JOIN n b ON b.gx = a.gx + d.x AND b.gy = a.gy + d.y),
g AS (SELECT a, b, round(exact, 3) AS length, round(exact * CASE road_class WHEN 'white' THEN 1.0::DOUBLE WHEN 'orange' THEN 1.08::DOUBLE WHEN 'orange_dashed' THEN 2.6::DOUBLE ELSE 9.5::DOUBLE END, 3) AS cost, road_class FROM g0)"""
COMPONENTS = """,
link AS (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g),
c(node, component) USING KEY (node) AS (SELECT node_id, node_id FROM n UNION SELECT x.node, x.component FROM (SELECT l.v AS node, min(c.component) AS component FROM c JOIN link l ON l.u = c.node GROUP BY l.v) x JOIN recurring.c o ON o.node = x.node WHERE x.component < o.component)"""
PIXELS = """p AS (SELECT l_orderkey % 4 AS tile_x, l_partkey % 3 AS tile_y, (l_orderkey * 7 + l_linenumber * 31) % 256 AS x, (l_partkey * 11 + CAST(l_quantity AS BIGINT)) % 256 AS y, (l_orderkey + l_partkey) % 3 AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
c0 AS (SELECT tile_x, tile_y, x, y, CASE k WHEN 0 THEN 200 + q % 50 WHEN 1 THEN 190 + q ELSE 10 + q END AS r, CASE k WHEN 0 THEN 200 + q % 40 WHEN 1 THEN 90 + q ELSE 60 + q END AS g, CASE k WHEN 0 THEN 195 + q % 50 WHEN 1 THEN 40 + q ELSE 90 + q END AS b, q * 5 AS a FROM p),
c1 AS (SELECT *, (a >= 35 AND greatest(r, g, b) >= 188 AND greatest(r, g, b) - least(r, g, b) <= 48 AND least(r, g, b) >= 145) OR (r >= 150 AND b >= 105 AND g <= 120 AND r - g >= 45 AND b - g >= 35 AND a >= 35) AS white,
 r >= 185 AND g >= 75 AND g <= 175 AND b <= 115 AND r - b >= 85 AND r - g >= 8 AND a >= 35 AS orange FROM c0),
cells AS (SELECT tile_x, tile_y, x // 10 AS cell_x, y // 10 AS cell_y, avg(CAST(white OR orange AS DOUBLE)) AS road_ratio, avg(CAST(white AS DOUBLE)) AS white_ratio, avg(CAST(orange AS DOUBLE)) AS orange_ratio FROM c1 GROUP BY ALL HAVING avg(CAST(white OR orange AS DOUBLE)) >= 0.16)"""
BOXES = REQUESTS + """, b AS (SELECT request_id AS box_id, start_x * 30 AS x0, start_y * 40 AS y0, start_x * 30 + 3000 AS x1, start_y * 40 + 2500 AS y1 FROM r)"""
LINES = REQUESTS + """,
l AS (SELECT request_id AS route_id, pos, start_x * 2 + 10000 + dx AS x, 10000 - start_y * 2 + dy AS y FROM r CROSS JOIN (VALUES (0, 0, 0), (1, 300, -100), (2, 500, 200), (3, 900, 150)) v(pos, dx, dy)),
s0 AS (SELECT route_id, pos, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM l WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
s1 AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) AS length FROM s0 WHERE bx IS NOT NULL),
sg AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before, sum(length) OVER (PARTITION BY route_id) AS total FROM s1)"""
PROGRESS = HELD + ", " + LINES + """,
j0 AS (SELECT h.player_id, h.seq, h.ts_ms, h.map_x, h.map_y, h.speed_kmh, sg.*, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS sq FROM h JOIN sg ON sg.route_id = h.player_id % (SELECT count(*) FROM r) + 1),
j1 AS (SELECT *, greatest(0.0, least(1.0, ((map_x - ax) * (bx - ax) + (map_y - ay) * (b_y - ay)) / sq)) AS t FROM j0),
j2 AS (SELECT *, ax + t * (bx - ax) AS px, ay + t * (b_y - ay) AS py FROM j1),
j3 AS (SELECT *, sqrt((map_x - px) * (map_x - px) + (map_y - py) * (map_y - py)) AS off, total - before - t * length AS remaining FROM j2),
pr AS (SELECT * FROM j3 QUALIFY row_number() OVER (PARTITION BY player_id, seq ORDER BY off, pos) = 1)"""
_NEAR = """, d AS (SELECT request_id, {id} AS {id}, sqrt((x - map_x) * (x - map_x) + (y - map_y) * (y - map_y)) AS distance FROM q CROSS JOIN {t}),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, {id}) AS rank FROM d WHERE distance <= {radius} QUALIFY rank <= {k})"""


def all_sql() -> dict[str, str]:
    near_start = f"WITH {NODES}, {REQUESTS}, q AS (SELECT request_id, start_x AS x, start_y AS y FROM r)" + _NEAR.format(id="node_id", t="n", radius=900, k=10)
    return {
        "trip_leaders": f"""WITH {HELD}, a AS (SELECT t.*, CASE WHEN odometer > 1 AND odometer < 2e7 THEN odometer END AS v, ts_ms - lag(ts_ms) OVER ({_W}) AS dt FROM t),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM a),
c AS (SELECT *, last_value(CASE WHEN v IS NOT NULL AND (pv IS NULL OR v + 5 < pv) THEN v END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS base,
 sum(coalesce(CASE WHEN v IS NULL THEN speed_mps * 3.6 * least(greatest(dt, 0), 2500) / 3.6e6 END, 0.0)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS cum FROM b),
d AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN greatest(0.0, v - base) / 1000 END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS at_trip, last_value(CASE WHEN v IS NOT NULL THEN cum END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS at_cum FROM c),
f AS (SELECT *, coalesce(at_trip, 0.0) + cum - coalesce(at_cum, 0.0) AS trip FROM d)
SELECT player_id, round(arg_max(trip, seq), 6) AS trip_km, round(max(trip), 6) AS longest_km, count(*) AS packets FROM f GROUP BY player_id""",
        "telemetry_hold": f"WITH {HELD} SELECT player_id, seq, packet_count, paused, accepted, position_x, round(map_x, 6) AS map_x, round(map_y, 6) AS map_y, round(heading, 6) AS heading, round(speed_kmh, 6) AS speed_kmh, round(throttle, 6) AS throttle, round(brake, 6) AS brake FROM h",
        "latest_snapshot": f"WITH {HELD} SELECT player_id, seq, ts_ms, round(map_x, 6) AS map_x, round(map_y, 6) AS map_y, gear, packet_count, paused FROM h QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ts_ms DESC, seq DESC) = 1",
        "liveness": f"WITH {HELD}, l AS (SELECT player_id, max(ts_ms) AS last FROM h WHERE ts_ms <= 100000 GROUP BY 1) SELECT p.player_id, 100000 - last AS age_ms, CASE WHEN 100000 - last < 1500 THEN 'LIVE' WHEN last IS NOT NULL THEN 'HOLDING' ELSE 'WAITING' END AS status FROM (SELECT DISTINCT player_id FROM h) p LEFT JOIN l ON p.player_id = l.player_id",
        "live_sessions": f"WITH {TELEMETRY}, a AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER ({_W}) < 1500 THEN 0 ELSE 1 END AS st FROM t), b AS (SELECT *, CAST(sum(st) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT player_id, session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS packets FROM b GROUP BY ALL",
        "heartbeat": f"WITH {TELEMETRY}, a AS (SELECT *, row_number() OVER ({_W}) AS pc, ts_ms // 2000 AS beat FROM t) SELECT player_id, beat, max(pc) AS packets, round(arg_max(speed_mps, seq), 6) AS speed_mps, (beat + 1) * 2000 - max(ts_ms) AS age_ms FROM a GROUP BY player_id, beat",
        "motion_heading": f"""WITH {HELD}, a AS (SELECT *, map_x - lag(map_x) OVER ({_W}) AS dx, map_y - lag(map_y) OVER ({_W}) AS dy FROM h),
b AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 0.45 AND speed_kmh > 2 THEN ts_ms END AS mt, CASE WHEN sqrt(dx * dx + dy * dy) > 0.45 AND speed_kmh > 2 THEN degrees(atan2(dx, -dy)) END AS mh FROM a),
c AS (SELECT *, last_value(mt IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lt, last_value(mh IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lh FROM b),
d AS (SELECT *, CASE WHEN ts_ms - lt < 3500 THEN lh ELSE heading END AS f FROM c) SELECT player_id, seq, round(f - 360 * floor(f / 360), 5) AS motion_heading FROM d""",
        "crash_candidates": f"""WITH {HELD}, a AS (SELECT *, max(speed_kmh) OVER (PARTITION BY player_id ORDER BY ts_ms RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS a, max(speed_kmh) OVER (PARTITION BY player_id ORDER BY ts_ms RANGE BETWEEN 150 PRECEDING AND 1 PRECEDING) AS b FROM h)
SELECT player_id, seq, ts_ms, 'collision' AS event FROM a WHERE a >= 60 AND a - speed_kmh >= 40 AND brake <= 5 UNION ALL SELECT player_id, seq, ts_ms, 'mega_fail_crash' FROM a WHERE b >= 120 AND speed_kmh <= 15 AND b - speed_kmh >= 100""",
        "packet_decode": f"WITH {TELEMETRY} SELECT player_id, ts_ms AS \"TimestampMS\", CAST(position_x AS FLOAT) AS \"PositionX\", CAST(speed_mps AS FLOAT) AS \"Speed\", CAST(brake_raw AS INT) AS \"Brake\", gear AS \"Gear\", CAST(odometer AS FLOAT) AS \"DistanceTraveled\" FROM t WHERE seq % 50 <> 0",
        "packet_counts": f"WITH {TELEMETRY} SELECT player_id, count(*) AS packets, CAST(sum(CASE WHEN seq % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_short FROM t GROUP BY player_id",
        "scalar_labels": f"""WITH {TELEMETRY} SELECT player_id, seq, CASE WHEN gear - 1 = 0 THEN 'N' WHEN gear - 1 < 0 THEN 'R' ELSE CAST(gear - 1 AS VARCHAR) END AS gear_label,
CASE WHEN floor(odometer + 0.5) >= 1000 THEN printf('%.1f', odometer / 1000) || ' km' ELSE CAST(CAST(floor(odometer + 0.5) AS BIGINT) AS VARCHAR) || ' m' END AS distance_label,
CAST(greatest(1, floor(odometer / 1000 / greatest(15.0, speed_mps * 3.6) * 60 + 0.5)) AS BIGINT) AS eta, round(velocity_x * 50 - 360 * floor(velocity_x * 50 / 360), 6) AS angle,
CAST(round_even(position_x / 10, 0) AS BIGINT) AS grid_x, CAST(floor((position_z - 500) / 320) AS BIGINT) AS cell_z, round(odometer / 0.655 * 0.655, 6) AS there_and_back FROM t""",
        "tile_pyramid": f"WITH {MARKERS} SELECT CAST(zoom AS INT) AS zoom, CAST(floor(map_x * pow(2.0, zoom - 18) / 256) AS BIGINT) AS tile_x, CAST(floor(map_y * pow(2.0, zoom - 18) / 256) AS BIGINT) AS tile_y, count(*) AS markers FROM m CROSS JOIN range(12, 19) z(zoom) GROUP BY ALL",
        "box_tiles": f"WITH {BOXES}, z AS (SELECT *, 0.125 / 256 AS f, CAST(ceil(20000 * 0.125 / 256) AS BIGINT) - 1 AS last FROM b), w AS (SELECT box_id, unnest(range(greatest(CAST(floor(x0 * f) AS BIGINT) - 1, 0), least(CAST(ceil(x1 * f) AS BIGINT) + 1, last) + 1)) AS tile_x, y0, y1, f, last FROM z) SELECT box_id, tile_x, unnest(range(greatest(CAST(floor(y0 * f) AS BIGINT) - 1, 0), least(CAST(ceil(y1 * f) AS BIGINT) + 1, last) + 1)) AS tile_y FROM w",
        "markers_in_boxes": f"WITH {BOXES}, {MARKERS} SELECT box_id, file_order, title, category, map_x, map_y, CAST(row_number() OVER (PARTITION BY box_id ORDER BY file_order) AS INT) AS rank FROM b JOIN m ON map_x BETWEEN x0 - 50 AND x1 + 50 AND map_y BETWEEN y0 - 50 AND y1 + 50 QUALIFY rank <= 600",
        "marker_search": f"""WITH {REQUESTS}, {MARKERS}, q AS (SELECT request_id AS query_id, 'brand#' || CAST(request_id % 5 + 1 AS VARCHAR) AS t1, CAST(request_id % 7 AS VARCHAR) AS t2, start_x * 40 AS x, start_y * 50 AS y FROM r),
k AS (SELECT query_id, file_order, title, round(sqrt((x - map_x) * (x - map_x) + (y - map_y) * (y - map_y)), 2) AS distance FROM q JOIN m ON contains(lower(title || ' ' || category || ' ' || parent_category), t1) AND contains(lower(title || ' ' || category || ' ' || parent_category), t2))
SELECT query_id, file_order, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, lower(title), file_order) AS rank FROM k QUALIFY rank <= 25""",
        "nearest_markers": f"WITH {REQUESTS}, {MARKERS}, q AS (SELECT request_id, start_x * 40 AS x, start_y * 50 AS y FROM r)" + _NEAR.format(id="file_order", t="m", radius=5000, k=4) + " SELECT request_id, file_order, round(distance, 6) AS distance, rank FROM k",
        "marker_lookup": f"WITH {REQUESTS}, {MARKERS}, i AS (SELECT *, marker_id AS needle FROM m WHERE marker_id IS NOT NULL UNION ALL SELECT *, id FROM m WHERE id IS NOT NULL), f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY needle ORDER BY file_order) = 1) SELECT request_id, f.title, coalesce(f.map_x, target_x) AS target_x, coalesce(f.map_y, target_y) AS target_y FROM r LEFT JOIN f ON f.needle = CAST(request_id * 3 % 211 AS VARCHAR)",
        "marker_labels": f"WITH {MARKERS} SELECT file_order, coalesce(marker_id, id, coalesce(nullif(title, ''), 'poi') || '@' || CAST(CAST(floor(map_x + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(map_y + 0.5) AS BIGINT) AS VARCHAR)) AS key, CASE category WHEN 'PROMO BRUSHED TIN' THEN 'tin' WHEN 'ECONOMY ANODIZED STEEL' THEN 'steel' ELSE coalesce(nullif(category, ''), 'POI') END AS label FROM m",
        "marker_categories": f"WITH {MARKERS} SELECT DISTINCT category FROM m WHERE category <> ''",
        "road_cells": f"WITH {PIXELS} SELECT tile_x, tile_y, cell_x, cell_y, round(road_ratio, 6) AS road_ratio, round(white_ratio, 6) AS white_ratio, round(orange_ratio, 6) AS orange_ratio FROM cells",
        "road_grid": f"""WITH {PIXELS}, k AS (SELECT *, CASE WHEN white_ratio >= 0.13 AND white_ratio >= 0.55 * orange_ratio THEN 0 WHEN orange_ratio >= 0.28 THEN 1 WHEN orange_ratio >= 0.16 THEN 2 ELSE 4 END AS kind,
 CAST(round_even((tile_x * 256 + cell_x * 10 + 5.0::DOUBLE) / 10, 0) AS BIGINT) AS gx, CAST(round_even((tile_y * 256 + cell_y * 10 + 5.0::DOUBLE) / 10, 0) AS BIGINT) AS gy FROM cells),
f AS (SELECT *, min(kind) OVER (PARTITION BY gx, gy) AS best FROM k WHERE kind < 4 QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY tile_y, tile_x, cell_y, cell_x) = 1)
SELECT gx, gy, CAST(gx * 10 AS DOUBLE) AS map_x, CAST(gy * 10 AS DOUBLE) AS map_y, CASE best WHEN 0 THEN 'white' WHEN 1 THEN 'orange' ELSE 'orange_dashed' END AS road_class, round(road_ratio, 6) AS road_ratio, round(white_ratio, 6) AS white_ratio, round(orange_ratio, 6) AS orange_ratio FROM f""",
        "grid_edges": f"WITH {EDGES} SELECT a, b, length, cost, road_class FROM g",
        "road_class_counts": f"WITH {EDGES} SELECT road_class, count(*) AS count, 'nodes' AS what FROM n GROUP BY ALL UNION ALL SELECT road_class, count(*), 'edges' FROM g GROUP BY ALL",
        "graph_components": f"WITH RECURSIVE {EDGES}{COMPONENTS} SELECT node AS node_id, component, count(*) OVER (PARTITION BY component) AS size FROM c",
        "graph_status": f"WITH RECURSIVE {EDGES}{COMPONENTS}, z AS (SELECT component, count(*) AS k FROM c GROUP BY 1) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM z) AS components, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k DESC) FROM (SELECT k FROM z ORDER BY k DESC LIMIT 8)) AS largest",
        "snapped_nodes": near_start + " SELECT request_id, node_id, round(distance, 6) AS distance, rank FROM k",
        "route_progress": f"WITH {PROGRESS} SELECT player_id, seq, pos, round(off, 8) AS off, round(px, 8) AS px, round(py, 8) AS py, round(t, 8) AS t, round(remaining, 8) AS remaining FROM pr",
        "off_route_episodes": f"WITH {PROGRESS}, o AS (SELECT *, CAST(sum(CASE WHEN off <= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM pr) SELECT player_id, episode, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(ts_ms) - min(ts_ms) AS duration_ms, round(max(off), 8) AS max_off FROM o WHERE off > 300 GROUP BY player_id, episode",
        "route_points": f"WITH {LINES}, w AS (SELECT route_id, want FROM (SELECT DISTINCT route_id FROM sg) CROSS JOIN (VALUES (0.0::DOUBLE), (100.0), (316.5), (700.0), (5000.0)) v(want)), k AS (SELECT w.*, ax, ay, bx, b_y, greatest(0.0, least(1.0, (want - before) / length)) AS t FROM w JOIN sg ON sg.route_id = w.route_id AND before <= want QUALIFY row_number() OVER (PARTITION BY w.route_id, want ORDER BY before DESC, pos DESC) = 1) SELECT route_id, want, round(ax + t * (bx - ax), 6) AS x, round(ay + t * (b_y - ay), 6) AS y FROM k",
        "arrivals": f"""WITH {PROGRESS}, a AS (SELECT *, off / 10 AS px2, CASE WHEN speed_kmh <= 8 THEN 62.0::DOUBLE ELSE 30.0::DOUBLE END * 0.655 AS lim FROM pr), b AS (SELECT *, sum(CASE WHEN px2 > 1.35 * lim THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, min(CASE WHEN px2 <= lim THEN ts_ms END) OVER (PARTITION BY player_id, run ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS timer FROM b) SELECT player_id, min(ts_ms) AS arrived_ms FROM c WHERE px2 <= lim AND ts_ms - timer >= 1100 GROUP BY player_id""",
        "suspicious_reroutes": f"WITH {PROGRESS} SELECT player_id, seq, seq % 13 <> 0 AND remaining + seq * 9 > greatest(remaining * 1.25, remaining + 350) AND off < 520 AND seq % 50 * 1000 < 32000 AS rejected FROM pr",
    }
