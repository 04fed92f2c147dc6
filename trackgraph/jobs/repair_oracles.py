"""SQL of the queries on repaired graphs, parallel edges and what routing takes from them."""

from __future__ import annotations

from trackgraph.functions.geo import PROFILES
from trackgraph.jobs.oracles import EDGES, MARKERS, NODES, REQUESTS, _NEAR
from trackgraph.operators.graph import MULTIPLIERS

ISLANDS = """n AS (SELECT p_partkey AS node_id, p_partkey % 10 + p_partkey // 100 % 10 // 2 * 38 + p_partkey // 100 % 2 * 13 AS gx, p_partkey % 100 // 10 + p_partkey // 1000 * 30 AS gy, CAST(gx * 10 AS DOUBLE) AS map_x, CAST(gy * 10 AS DOUBLE) AS map_y,
 CASE WHEN p_size < 35 THEN 'white' WHEN p_size < 45 THEN 'orange' ELSE 'orange_dashed' END AS road_class, CASE WHEN p_size < 35 THEN 0 WHEN p_size < 45 THEN 1 ELSE 2 END AS rank FROM part WHERE p_size > 12)"""


def _components(name: str, links: str) -> str:
    """CTEs ``{name}(node, component)`` and ``{name}z`` with sizes, over links ``u, v`` in both directions."""
    return f"""
{name}(node, component) USING KEY (node) AS (SELECT node_id, node_id FROM n UNION SELECT x.node, x.component FROM (SELECT l.v AS node, min({name}.component) AS component FROM {name} JOIN {links} l ON l.u = {name}.node GROUP BY l.v) x JOIN recurring.{name} o ON o.node = x.node WHERE x.component < o.component),
{name}z AS MATERIALIZED (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM {name})"""


def _forest(name: str, candidates: str) -> str:
    """CTE ``{name}``: candidates (``seq, a, b, ca, cb``) whose components no earlier ones connect, which is what a pass in their order accepts."""
    return f"""
{name}_reach AS (SELECT seq AS e, ca AS c FROM {candidates} UNION SELECT r.e, CASE WHEN k.ca = r.c THEN k.cb ELSE k.ca END FROM {name}_reach r JOIN {candidates} k ON k.seq < r.e AND (k.ca = r.c OR k.cb = r.c)),
{name} AS MATERIALIZED (SELECT * FROM {candidates} k WHERE NOT EXISTS (SELECT 1 FROM {name}_reach r WHERE r.e = k.seq AND r.c = k.cb))"""


def _repair(nodes: str) -> str:
    far = "sqrt((p.map_x - q.map_x) * (p.map_x - q.map_x) + (p.map_y - q.map_y) * (p.map_y - q.map_y))"
    return EDGES.replace(NODES, nodes) + f""",
link1 AS MATERIALIZED (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g),{_components("c1", "link1")},
steps AS (SELECT i AS dx, j AS dy, row_number() OVER (ORDER BY i, j) AS k FROM range(0, 5) a(i) CROSS JOIN range(-4, 5) b(j) WHERE (i > 0 OR j > 0) AND i * i + j * j <= 16),
firsts AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY node_id) = 1),
scand AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p.node_id, k) AS seq, p.node_id AS a, q.node_id AS b, x.component AS ca, y.component AS cb, {far} AS length
 FROM n p CROSS JOIN steps JOIN firsts q ON q.gx = p.gx + dx AND q.gy = p.gy + dy JOIN c1z x ON x.node = p.node_id JOIN c1z y ON y.node = q.node_id WHERE x.component <> y.component AND {far} > 0 AND {far} <= 40.01),{_forest("stitch", "scand")},
link2 AS MATERIALIZED (SELECT * FROM link1 UNION SELECT a, b FROM stitch UNION SELECT b, a FROM stitch),{_components("c2", "link2")},
bcand AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score, a, b) AS seq FROM (SELECT p.node_id AS a, q.node_id AS b, x.component AS ca, y.component AS cb, {far} AS length, round({far} + CASE WHEN p.road_class <> q.road_class THEN 35.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score
 FROM n p JOIN n q ON p.rank < 2 AND q.rank < 2 JOIN c2z x ON x.node = p.node_id JOIN c2z y ON y.node = q.node_id WHERE x.component < y.component AND x.size >= 2 AND y.size >= 2 AND {far} > 0 AND {far} <= 320 QUALIFY row_number() OVER (PARTITION BY ca, cb ORDER BY score, a, b) = 1)),{_forest("bridge", "bcand")},
link3 AS MATERIALIZED (SELECT * FROM link2 UNION SELECT a, b FROM bridge UNION SELECT b, a FROM bridge),{_components("c3", "link3")}"""


def sql() -> dict[str, str]:
    islands, routed = (f"WITH RECURSIVE {_repair(n)}" for n in (ISLANDS, NODES))
    times = lambda kind: f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in MULTIPLIERS.items()) + " END"
    ends = lambda end: f"(SELECT request_id, node_id, distance, row_number() OVER (PARTITION BY request_id ORDER BY distance, node_id) AS rank FROM (SELECT request_id, node_id, sqrt(({end}_x - map_x) * ({end}_x - map_x) + ({end}_y - map_y) * ({end}_y - map_y)) AS distance FROM r CROSS JOIN n) WHERE distance <= 1800 QUALIFY rank <= 96)"
    pairs = f"""{routed}, {REQUESTS}, st AS MATERIALIZED {ends("start")}, gl AS MATERIALIZED {ends("target")},
pairs AS MATERIALIZED (SELECT st.request_id, row_number() OVER (PARTITION BY st.request_id ORDER BY st.distance + gl.distance + 600.0::DOUBLE / sqrt(x.size), st.rank, gl.rank) AS pair_rank, st.node_id AS s, gl.node_id AS g, st.distance AS s_snap, gl.distance AS g_snap, st.distance + gl.distance + 600.0::DOUBLE / sqrt(x.size) AS score
 FROM st JOIN gl ON st.request_id = gl.request_id JOIN c3z x ON x.node = st.node_id JOIN c3z y ON y.node = gl.node_id AND y.component = x.component QUALIFY pair_rank <= 4)"""
    near = lambda q, t, id_, radius, k: f"{q}" + _NEAR.format(id=id_, t=t, radius=radius, k=k) + f" SELECT request_id, {id_}, round(distance, 6) AS distance, rank FROM k"
    profiles = ", ".join(f"('{p}', {', '.join(str(float(m)) + '::DOUBLE' for m in (t['white'], t['orange'], t['orange_dashed'], t['synthetic_short'], t['synthetic_medium'], t['synthetic_bridge']))})" for p, t in PROFILES.items())
    links = f"""links AS (SELECT a, b, length, road_class FROM g UNION ALL SELECT a, b, length, 'synthetic_bridge' FROM stitch UNION ALL SELECT a, b, length, 'synthetic_bridge' FROM bridge),
pf(profile, white, orange, dashed, short, medium, far) AS (VALUES {profiles}),
pe AS (SELECT profile, a, b, length * CASE road_class WHEN 'white' THEN white WHEN 'orange' THEN orange WHEN 'orange_dashed' THEN dashed ELSE CASE WHEN length <= 70 THEN short WHEN length <= 180 THEN medium ELSE far END END AS w FROM links CROSS JOIN pf),
way AS MATERIALIZED (SELECT profile, a, b, w FROM pe UNION ALL SELECT profile, b, a, w FROM pe)"""
    return {
        "path_costs": f"""{pairs}, {links},
dist(s, profile, node, cost) USING KEY (s, profile, node) AS (SELECT DISTINCT s, profile, s, 0.0::DOUBLE FROM pairs CROSS JOIN pf
 UNION SELECT q.s, q.profile, q.node, q.cost FROM (SELECT d.s, d.profile, w.b AS node, min(round(d.cost + w.w, 6)) AS cost FROM dist d JOIN way w ON w.profile = d.profile AND w.a = d.node GROUP BY ALL) q LEFT JOIN recurring.dist o ON o.s = q.s AND o.profile = q.profile AND o.node = q.node WHERE o.cost IS NULL OR q.cost < o.cost)
SELECT DISTINCT p.s, p.g, d.profile, round(d.cost, 5) AS cost, round(d.cost, 5) AS by_edges FROM pairs p JOIN dist d ON d.s = p.s AND d.node = p.g""",
        "graph_stitches": f"{islands} SELECT a, b, ca, cb, length FROM stitch",
        "graph_bridges": f"{islands} SELECT a, b, ca, cb, round(length, 6) AS length FROM bridge",
        "graph_repair": f"""{islands}, z AS (SELECT component, count(*) AS k FROM c3 GROUP BY 1), m AS (SELECT (SELECT count(*) FROM g) AS e, (SELECT count(*) FROM stitch) AS s, (SELECT count(*) FROM bridge) AS b)
SELECT (SELECT count(*) FROM n) AS nodes, e + s + b AS edges, e AS raw_edges, s AS stitches, b AS bridges, 4 AS stitch_radius_cells, 320.0::DOUBLE AS bridge_radius_px, (SELECT count(*) FROM z) AS components, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k DESC) FROM (SELECT k FROM z ORDER BY k DESC LIMIT 8)) AS largest FROM m""",
        "parallel_edges": f"""WITH RECURSIVE {EDGES}, e0 AS (SELECT *, (a * 31 + b * 17) % 7 AS k FROM g),
made AS (SELECT a, b, 1 AS seq, length AS len, cost * (1 + k) AS w, road_class FROM e0 UNION ALL SELECT a, b, 2, length + k, length * 2, 'orange_dashed' FROM e0 WHERE k < 6 UNION ALL SELECT a, b, 3, length * 0.5::DOUBLE, length * (0.4::DOUBLE + k), CASE WHEN k < 4 THEN 'white' ELSE 'orange' END FROM e0 WHERE k < 5),
worth AS (SELECT *, len * {times("road_class")} AS worth FROM made),
fold AS (SELECT * FROM worth WHERE seq = 1 UNION ALL SELECT f.a, f.b, m.seq, CASE WHEN m.w < f.worth THEN m.len ELSE f.len END, CASE WHEN m.w < f.worth THEN m.w ELSE f.w END, CASE WHEN m.w < f.worth THEN m.road_class ELSE f.road_class END, CASE WHEN m.w < f.worth THEN m.worth ELSE f.worth END FROM fold f JOIN worth m ON m.a = f.a AND m.b = f.b AND m.seq = f.seq + 1)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(len, 6) AS length, round(w, 6) AS cost, road_class FROM fold QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY seq DESC) = 1""",
        "candidate_pairs": f"{pairs} SELECT request_id, pair_rank, s, g, round(s_snap, 6) AS s_snap, round(g_snap, 6) AS g_snap, round(score, 6) AS score FROM pairs",
        "route_outcomes": f"{pairs} SELECT request_id, CASE WHEN start_x IS NULL THEN 'waiting_for_telemetry' WHEN request_id NOT IN (SELECT request_id FROM st) OR request_id NOT IN (SELECT request_id FROM gl) THEN 'graph_snap_failed' WHEN request_id NOT IN (SELECT request_id FROM pairs) THEN 'graph_disconnected' ELSE 'graph' END AS outcome FROM r",
        "snapped_nodes_for_routing": near(f"WITH {NODES}, {REQUESTS}, q AS (SELECT request_id, start_x AS x, start_y AS y FROM r)", "n", "node_id", 1800, 96),
        "nearest_markers_anywhere": near(f"WITH {REQUESTS}, {MARKERS}, q AS (SELECT request_id, start_x * 40 AS x, start_y * 50 AS y FROM r)", "m", "file_order", 1e9, 4),
    }
