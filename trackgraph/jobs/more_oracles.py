"""SQL of the queries on remaining routes, grid keys, graph headers, edits and marker searches by category."""

from __future__ import annotations

from trackgraph.jobs.oracles import BOXES, EDGES, HELD, MARKERS, NODES, PROGRESS, REQUESTS
from trackgraph.operators.events import EVENTS, GLOBAL_COOLDOWN_MS
from trackgraph.operators.graph import MULTIPLIERS


def _distance(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


#: Rows of the tracks with the vertex that comes next, the places from which the way goes on, and pixels to it.
AHEAD = PROGRESS + f""", v0 AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM l WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
v1 AS (SELECT *, coalesce({_distance("x", "y", "nx", "ny")}, 0.0) AS step FROM v0),
v AS MATERIALIZED (SELECT route_id AS rid, pos AS k, x AS vx, y AS vy, nx, ny, step, sum(step) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, count(*) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1 AS follow,
 coalesce(sum(step) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS vbefore FROM v1),
j AS (SELECT *, off < 160 AS near, off < 160 AND {_distance("map_x", "map_y", "px", "py")} >= 3 AS shown, off >= 160 AND coalesce({_distance("map_x", "map_y", "vx", "vy")} < 3, false) AS skip FROM pr LEFT JOIN v ON v.rid = pr.route_id AND v.k = CASE WHEN off < 160 THEN pos + CASE WHEN t > 0.72 THEN 2 ELSE 1 END ELSE 1 END)"""


RPM = """WITH RECURSIVE e AS (SELECT user_id AS player_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, CAST(event_id * 37 % 9000 AS DOUBLE) AS rpm, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(7000 + event_id % 5 * 500 AS DOUBLE) END AS own FROM events),
f AS (SELECT player_id, s, rpm, CASE WHEN own > 1000 THEN own WHEN rpm > 8000 THEN least(12000.0::DOUBLE, rpm * 1.08::DOUBLE) ELSE 8000.0::DOUBLE END AS learned FROM e WHERE s = 1
 UNION ALL SELECT e.player_id, e.s, e.rpm, CASE WHEN e.own > 1000 THEN e.own WHEN e.rpm > f.learned THEN least(12000.0::DOUBLE, e.rpm * 1.08::DOUBLE) ELSE f.learned END FROM f JOIN e ON e.player_id = f.player_id AND e.s = f.s + 1),
r AS (SELECT player_id, s AS seq, least(greatest(rpm / greatest(1000.0::DOUBLE, learned), 0.0::DOUBLE), 1.0::DOUBLE) AS rpm_ratio FROM f)
SELECT player_id, seq, rpm_ratio, CAST(floor(rpm_ratio * 88 + 0.5) AS BIGINT) AS lit, greatest(CAST(floor(rpm_ratio * 88 + 0.5) AS BIGINT) - 75, 0) AS red FROM r"""


def drive_events(crashes: str, jumps: str) -> str:
    """The greedy pass over the candidates of two queries, one candidate of each player after another."""
    own = {name: f"w{k}" for k, name in enumerate(EVENTS)}
    rank = "CASE event " + " ".join(f"WHEN '{e}' THEN {-p}" for e, (p, _) in EVENTS.items()) + " END"
    free = lambda last, times: f"({last} IS NULL OR c.ts_ms - {last} >= {GLOBAL_COOLDOWN_MS}) AND CASE c.event " + " ".join(f"WHEN '{e}' THEN {times(w)} IS NULL OR c.ts_ms - {times(w)} >= {EVENTS[e][1]}" for e, w in own.items()) + " END"
    state = ", ".join(f"CASE WHEN ok AND event = '{e}' THEN ts_ms ELSE {w} END AS {w}" for e, w in own.items())
    return f"""WITH RECURSIVE cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts_ms, {rank}, seq) AS n FROM (SELECT player_id, seq, ts_ms, event FROM ({crashes}) UNION ALL SELECT player_id, seq, ts_ms, event FROM ({jumps})) WHERE event IN ({", ".join(f"'{e}'" for e in EVENTS)})),
pass AS (SELECT player_id, n, seq, ts_ms, event, true AS ok, ts_ms AS last, {", ".join(f"CASE WHEN event = '{e}' THEN ts_ms END AS {w}" for e, w in own.items())} FROM cand WHERE n = 1
 UNION ALL SELECT player_id, n, seq, ts_ms, event, ok, CASE WHEN ok THEN ts_ms ELSE last END AS last, {state} FROM (SELECT c.player_id, c.n, c.seq, c.ts_ms, c.event, {free("p.last", lambda w: f"p.{w}")} AS ok, p.last, {", ".join(f"p.{w}" for w in own.values())} FROM pass p JOIN cand c ON c.player_id = p.player_id AND c.n = p.n + 1))
SELECT player_id, seq, ts_ms, event FROM pass WHERE ok"""


def sql() -> dict[str, str]:
    factor = "CASE kind " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in MULTIPLIERS.items()) + f" ELSE {float(MULTIPLIERS['unknown'])}::DOUBLE END"
    car = lambda x, y: _distance("map_x", "map_y", x, y)
    legs = f"""{AHEAD}, a AS (SELECT *, greatest(170.0::DOUBLE, speed_kmh / 3.6 * 4) * 0.655 AS look, CASE WHEN skip THEN nx ELSE vx END AS wx, CASE WHEN skip THEN ny ELSE vy END AS wy, CASE WHEN skip THEN vbefore + step ELSE vbefore END AS begins, CASE WHEN shown THEN px ELSE map_x END AS fx, CASE WHEN shown THEN py ELSE map_y END AS fy FROM j),
b AS (SELECT *, {_distance("map_x", "map_y", "fx", "fy")} AS leg, {_distance("fx", "fy", "wx", "wy")} AS rest FROM a),
c AS (SELECT b.*, q.vx AS sx, q.vy AS sy, q.nx AS ex, q.ny AS ey, (look - leg - rest + begins - q.vbefore) / q.step AS part FROM b LEFT JOIN v q ON q.rid = b.route_id AND q.step > 0 AND q.vbefore <= look - leg - rest + begins AND b.wx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY player_id, seq ORDER BY q.vbefore DESC) = 1)"""
    at = lambda car, f, w, s, e: f"round(CASE WHEN shown AND look <= leg THEN {car} + ({f} - {car}) * look / leg WHEN wx IS NULL THEN CASE WHEN shown THEN {f} END WHEN look - leg <= rest AND rest > 0 THEN {f} + ({w} - {f}) * (look - leg) / rest ELSE {s} + ({e} - {s}) * least(part, 1.0) END, 6)"
    step = """SELECT player_id, n, t, CASE WHEN fired THEN t ELSE last END AS last, since, CASE WHEN fired THEN x ELSE ax END AS ax, CASE WHEN fired THEN y ELSE ay END AS ay, CASE WHEN NOT fired THEN NULL WHEN since IS NULL THEN 'moved' ELSE 'off_route' END AS reason
 FROM (SELECT *, goal >= 35 AND CASE WHEN since IS NULL THEN (last IS NULL OR t - last > 16000) AND (x - ax) * (x - ax) + (y - ay) * (y - ay) > 577600 ELSE (last IS NULL OR t - last >= 14000) AND ((off > 650 AND t - since > 3500) OR (off > 360 AND t - since > 9000) OR t - since > 22000) END AS fired
 FROM (SELECT c.player_id, c.n, c.t, c.off, c.goal, c.x, c.y, {last} AS last, CASE WHEN c.off > 170 THEN coalesce({since}, c.t) END AS since, coalesce({ax}, c.x) AS ax, coalesce({ay}, c.y) AS ay FROM {rows}))"""
    first = step.format(last="CAST(NULL AS BIGINT)", since="CAST(NULL AS BIGINT)", ax="CAST(NULL AS DOUBLE)", ay="CAST(NULL AS DOUBLE)", rows="walked c WHERE c.n = 1")
    later = step.format(last="p.last", since="p.since", ax="p.ax", ay="p.ay", rows="fold p JOIN walked c ON c.player_id = p.player_id AND c.n = p.n + 1")
    return {
        "reroutes": f"""WITH RECURSIVE {PROGRESS}, walked AS MATERIALIZED (SELECT player_id, ts_ms AS t, off, remaining AS goal, map_x AS x, map_y AS y, row_number() OVER (PARTITION BY player_id ORDER BY ts_ms) AS n FROM pr),
fold AS ({first} UNION ALL {later}) SELECT player_id, t AS ts_ms, reason FROM fold WHERE reason IS NOT NULL""",
        "rpm_ratio": RPM,
        "look_ahead_points": f"WITH {legs} SELECT player_id, seq, round(look, 6) AS look_px, {at('map_x', 'fx', 'wx', 'sx', 'ex')} AS look_x, {at('map_y', 'fy', 'wy', 'sy', 'ey')} AS look_y FROM c",
        "arrivals_at_targets": f"""WITH {AHEAD}, rest AS (SELECT player_id, ts_ms, speed_kmh, {_distance("map_x", "map_y", "(route_id % 60 + 10400)", "(9840 - route_id % 40)")} AS direct,
 CASE WHEN shown THEN {car("px", "py")} + coalesce({_distance("px", "py", "vx", "vy")} + tail, 0.0) WHEN skip AND follow > 0 THEN {car("nx", "ny")} + tail - step WHEN NOT skip AND vx IS NOT NULL THEN {car("vx", "vy")} + tail END AS along FROM j),
a AS (SELECT *, least(direct, along) AS d, CASE WHEN speed_kmh <= 8 THEN 62.0::DOUBLE ELSE 30.0::DOUBLE END * 0.655 AS lim FROM rest), b AS (SELECT *, sum(CASE WHEN d > 1.35 * lim THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, min(CASE WHEN d <= lim THEN ts_ms END) OVER (PARTITION BY player_id, run ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS timer FROM b) SELECT player_id, min(ts_ms) AS arrived_ms FROM c WHERE d <= lim AND ts_ms - timer >= 1100 GROUP BY player_id""",
        "client_status": f"""WITH {HELD}, p AS (SELECT DISTINCT player_id FROM h), l AS (SELECT player_id, ts_ms, paused FROM h WHERE ts_ms <= 5000 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ts_ms DESC, seq DESC) = 1)
SELECT p.player_id, CASE WHEN p.player_id % 10 = 0 THEN 'ERROR' WHEN paused THEN 'HOLDING' WHEN 5000 - ts_ms < 1500 THEN 'LIVE' WHEN ts_ms IS NOT NULL THEN 'HOLDING' ELSE 'WAITING' END AS status FROM p LEFT JOIN l ON l.player_id = p.player_id UNION ALL SELECT player_id + 1000000000, 'WAITING' FROM p""",
        "direct_routes": f"WITH {REQUESTS}, d AS (SELECT *, {_distance('start_x', 'start_y', 'target_x', 'target_y')} AS px FROM r) SELECT request_id, 'direct' AS outcome, round(px, 2) AS distance_px, CAST(round_even(px / 0.655, 0) AS BIGINT) AS metres, 2 AS points FROM d",
        "remaining_routes": f"""WITH {PROGRESS}, v0 AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM l WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
v1 AS (SELECT *, coalesce({_distance("x", "y", "nx", "ny")}, 0.0) AS step FROM v0),
v AS (SELECT route_id AS rid, pos AS k, x AS vx, y AS vy, nx, ny, step, sum(step) OVER w AS tail, count(*) OVER w - 1 AS follow FROM v1 WINDOW w AS (PARTITION BY route_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
j AS (SELECT *, off < 160 AS near, {car("px", "py")} >= 3 AS shown, CASE WHEN vx IS NULL THEN 0 ELSE follow + 1 END AS rest, coalesce({car("vx", "vy")} < 3, false) AS close FROM pr LEFT JOIN v ON v.rid = pr.route_id AND v.k = CASE WHEN off < 160 THEN pos + CASE WHEN t > 0.72 THEN 2 ELSE 1 END ELSE 1 END)
SELECT player_id, seq, CASE WHEN near AND shown THEN rest + 1 WHEN NOT near AND close THEN rest - 1 ELSE rest END AS points,
 round(CASE WHEN near AND shown THEN {car("px", "py")} + coalesce({_distance("px", "py", "vx", "vy")} + tail, 0.0) WHEN NOT near AND close THEN coalesce({car("nx", "ny")} + tail - step, 0.0) ELSE coalesce({car("vx", "vy")} + tail, 0.0) END, 6) AS length FROM j""",
        "normalised_edges": f"""WITH {EDGES}, e0 AS (SELECT *, (a * 31 + b * 17) % 7 AS k FROM g),
raw AS (SELECT a, b, CASE WHEN k <> 3 THEN length END AS length, CASE WHEN k <> 4 THEN cost END AS cost, CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'white' WHEN 2 THEN 'orange_dashed' ELSE road_class END AS given, 0 AS seq FROM e0
 UNION ALL SELECT b, a, length, cost * 0.9::DOUBLE + k, 'white', 1 FROM e0),
both_ends AS (SELECT raw.*, p.map_x AS ax, p.map_y AS ay, q.map_x AS bx, q.map_y AS b_y, CASE WHEN given <> 'unknown' THEN given WHEN q.rank > p.rank THEN q.road_class ELSE p.road_class END AS kind FROM raw JOIN n p ON p.node_id = raw.a JOIN n q ON q.node_id = raw.b),
len AS (SELECT *, coalesce(length, {_distance("ax", "ay", "bx", "b_y")}) AS size FROM both_ends),
won AS (SELECT *, CASE WHEN cost IS NOT NULL AND (length IS NOT NULL OR kind = 'unknown') THEN cost ELSE size * {factor} END AS weighted FROM len WHERE a <> b AND size > 0)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(size, 6) AS length, round(weighted, 6) AS cost, kind AS road_class FROM won QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY weighted, seq) = 1""",
        "jump_candidates": f"""WITH {HELD}, j0 AS (SELECT *, velocity_y <= -0.25 AS falling, position_x - lag(position_x) OVER w AS dx, position_z - lag(position_z) OVER w AS dz FROM h WINDOW w AS (PARTITION BY player_id ORDER BY ts_ms, seq)),
j1 AS (SELECT *, sum(coalesce(sqrt(dx * dx + dz * dz), 0.0)) OVER w AS path, sum(CASE WHEN falling THEN 0 ELSE 1 END) OVER w AS rises FROM j0 WINDOW w AS (PARTITION BY player_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING)),
j2 AS (SELECT *, first_value(ts_ms) OVER close AS t0, first_value(velocity_y) OVER close AS vy0, max({{'y': position_y, 't': ts_ms, 'p': path}}) OVER far AS apex, first_value(position_y) OVER far AS y0, first_value(velocity_y) OVER far AS fvy, max(velocity_y) OVER far AS top,
 min(CASE WHEN falling THEN ts_ms END) OVER run AS run_start, sum(CASE WHEN falling THEN 1 ELSE 0 END) OVER run AS run_rows FROM j1
 WINDOW close AS (PARTITION BY player_id ORDER BY ts_ms RANGE BETWEEN 150 PRECEDING AND CURRENT ROW), far AS (PARTITION BY player_id ORDER BY ts_ms RANGE BETWEEN 2800 PRECEDING AND CURRENT ROW), run AS (PARTITION BY player_id, rises ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING))
SELECT player_id, seq, ts_ms, 'jump_takeoff' AS event FROM j2 WHERE falling AND speed_kmh >= 75 AND ts_ms - run_start >= 150 AND run_rows >= 2 AND ts_ms > t0 AND velocity_y - vy0 <= -0.45::DOUBLE * ((ts_ms - t0) / 1000)
 AND ts_ms - apex.t <= 2400 AND apex.y - position_y >= 0.18 AND apex.y - y0 >= 0.75 AND top >= 1.0 AND top - fvy >= 1.1 AND apex.y - position_y >= 0.018::DOUBLE * (path - apex.p)""",
        "grid_unique_nodes": f"""WITH {NODES} SELECT CASE WHEN node_id % 3 = 0 THEN (gx // 2) || ':' || (gy // 2) ELSE CAST(round_even(map_x / 20, 0) AS BIGINT) || ':' || CAST(round_even(map_y / 20, 0) AS BIGINT) END AS grid_key, min(node_id) AS node_id FROM n GROUP BY 1""",
        "detected_graphs": "SELECT o_orderkey AS graph_id, o_orderkey % 4 = 1 OR o_orderkey % 3 = 1 AS detected FROM orders",
        "edit_strokes": "SELECT type, count(*) AS strokes FROM (SELECT CASE WHEN o_orderkey % 5 = 0 OR coalesce(o_orderpriority, '') = '' THEN 'unknown' ELSE o_orderpriority END AS type, unnest(range(o_orderkey % 4)) FROM orders) GROUP BY type",
        "client_search": f"""WITH {MARKERS}, {REQUESTS},
q AS (SELECT request_id AS query_id, CASE request_id % 3 WHEN 0 THEN 'tin' WHEN 1 THEN 'brand#' || (request_id % 5 + 1) ELSE 'x' END AS term, CASE WHEN request_id % 2 = 0 THEN 'PROMO' END AS kind, start_x * 40 AS x, start_y * 50 AS y FROM r),
hay AS (SELECT *, lower(concat_ws(' ', title, category, parent_category, CASE category WHEN 'PROMO' THEN 'tin offer' WHEN 'ECONOMY' THEN 'steel' ELSE coalesce(nullif(category, ''), 'POI') END)) AS h FROM m),
d AS (SELECT query_id, file_order, title, round({_distance("x", "y", "map_x", "map_y")}, 2) AS distance FROM q JOIN hay ON contains(h, term) AND (kind IS NULL OR kind = category) WHERE length(term) >= 2)
SELECT query_id, file_order, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, lower(title), file_order) AS rank FROM d QUALIFY rank <= 8""",
        "markers_in_boxes_of_category": f"""WITH {MARKERS}, {BOXES} SELECT box_id, file_order, row_number() OVER (PARTITION BY box_id ORDER BY file_order) AS rank FROM b JOIN m ON category = 'PROMO' AND map_x BETWEEN x0 - 50 AND x1 + 50 AND map_y BETWEEN y0 - 50 AND y1 + 50 QUALIFY rank <= 600""",
    }
