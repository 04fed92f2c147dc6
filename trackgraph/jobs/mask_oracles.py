"""SQL of the queries on mask networks."""

from __future__ import annotations

MASK = """ord AS (SELECT o_orderkey AS o_orderkey, o_orderkey // 200 % 8 AS own, o_orderkey // 1600 * 1000 AS shift FROM orders),
mk0 AS (SELECT CASE WHEN own % 2 = 0 THEN o_orderkey % 200 + 10 * (own % 3) ELSE own * 20 END + shift AS x, CASE WHEN own % 2 = 0 THEN own * 6 ELSE o_orderkey % 200 END AS y,
 {'grey': CASE WHEN o_orderkey % 53 = 0 THEN 40 ELSE 255 END, 'r': 120 + o_orderkey % 120, 'g': 80 + o_orderkey * 7 % 80, 'b': o_orderkey * 3 % 90} AS c FROM ord),
mk AS MATERIALIZED (SELECT x, y, c.grey AS grey, CAST(c.r AS DOUBLE) AS r, CAST(c.g AS DOUBLE) AS g, CAST(c.b AS DOUBLE) AS b, (y << 32) + x AS id FROM (SELECT x, y, max(c) AS c FROM mk0 GROUP BY x, y)),
st(k, dx, dy) AS (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)),
mon AS MATERIALIZED (SELECT x, y, id FROM mk WHERE grey > 127),
mlink AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM mon a CROSS JOIN st JOIN mon b ON b.x = a.x + dx AND b.y = a.y + dy),
mc(node, component) USING KEY (node) AS (SELECT id, id FROM mon UNION SELECT q.node, q.component FROM (SELECT l.v AS node, min(mc.component) AS component FROM mc JOIN mlink l ON l.u = mc.node GROUP BY l.v) q JOIN recurring.mc o ON o.node = q.node WHERE q.component < o.component),
blob AS MATERIALIZED (SELECT x, y, id, count(*) OVER (PARTITION BY component) AS size FROM mon JOIN mc ON node = id),
sk AS MATERIALIZED (SELECT x, y, id FROM blob WHERE size >= 80),
stp AS MATERIALIZED (SELECT a.id AS u, b.id AS v, k FROM sk a CROSS JOIN st JOIN sk b ON b.x = a.x + dx AND b.y = a.y + dy),
deg AS MATERIALIZED (SELECT sk.*, count(u) AS degree, count(u) <> 2 AS is_key FROM sk LEFT JOIN stp ON u = id GROUP BY x, y, id)"""
CHAINS = MASK + """,
walk AS (SELECT u AS start, k AS first, 0 AS pos, u AS prev, u AS node, v AS next, k AS last_k FROM stp JOIN deg ON id = u WHERE is_key
 UNION ALL SELECT w.start, w.first, w.pos + 1, w.node, w.next, s.v, coalesce(s.k, -1) FROM walk w JOIN deg d ON d.id = w.next LEFT JOIN stp s ON s.u = w.next AND s.v <> w.node AND NOT d.is_key WHERE w.next IS NOT NULL),
fin AS MATERIALIZED (SELECT start, first, max(pos) AS last, max_by(node, pos) AS stop, max_by(prev, pos) AS before FROM walk GROUP BY start, first),
good AS MATERIALIZED (SELECT f.start, f.first, f.last FROM fin f LEFT JOIN stp s ON s.u = f.stop AND s.v = f.before WHERE f.start < f.stop OR (f.start = f.stop AND f.first <= s.k)),
ch AS (SELECT start, first, pos, last, node & 4294967295 AS x, node >> 32 AS y FROM walk JOIN good USING (start, first)),
ch1 AS (SELECT *, coalesce(sqrt(pow((x - lag(x) OVER w) * 6.58487266, 2) + pow((y - lag(y) OVER w) * 6.60554791, 2)), 0.0) AS step FROM ch WINDOW w AS (PARTITION BY start, first ORDER BY pos)),
chain AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY start, first ORDER BY pos ROWS UNBOUNDED PRECEDING) AS along FROM ch1)"""
CLASSES = """,
hv AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM mk),
hh AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN v = r THEN 60 * (g - b) / d WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END AS turn FROM hv),
hit AS (SELECT DISTINCT x, y FROM hh WHERE round(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2) BETWEEN 2 AND 28 AND CASE WHEN v = 0 THEN 0 ELSE round(255 * d / v) END >= 35 AND v >= 70 AND r - b >= 35 AND r >= g - 12),
o5 AS (SELECT a.i AS dx, b.i AS dy FROM range(-2, 3) a(i) CROSS JOIN range(-2, 3) b(i)),
hint AS MATERIALIZED (SELECT DISTINCT x + dx AS x, y + dy AS y FROM hit CROSS JOIN o5 WHERE x + dx >= 0 AND y + dy >= 0),
cls AS MATERIALIZED (SELECT s.x, s.y, CASE WHEN count(h.x) / CAST((s.x + 3 - greatest(s.x - 2, 0)) * (s.y + 3 - greatest(s.y - 2, 0)) AS DOUBLE) >= 0.2 THEN 'orange' ELSE 'white' END AS road_class FROM sk s CROSS JOIN o5 LEFT JOIN hint h ON h.x = s.x + dx AND h.y = s.y + dy GROUP BY s.x, s.y)"""
PIECES = CHAINS + CLASSES + """,
seg AS (SELECT c.*, unnest(CASE WHEN pos > 0 AND pos % 6 = 0 AND pos < last THEN [pos // 6 - 1, pos // 6] WHEN pos > 0 AND pos % 6 = 0 THEN [pos // 6 - 1] ELSE [pos // 6] END) AS segment FROM chain c),
sg1 AS (SELECT start, first, segment, min_by(x, pos) AS ax, min_by(y, pos) AS ay, max_by(x, pos) AS bx, max_by(y, pos) AS b_y, max(along) - min(along) AS length, avg(CAST(road_class = 'orange' AS DOUBLE)) AS share FROM seg JOIN cls USING (x, y) GROUP BY start, first, segment),
piece AS MATERIALIZED (SELECT *, CASE WHEN share >= 0.2 THEN 'orange' ELSE 'white' END AS road_class FROM sg1)"""

#: Diamonds; the first pixel of a closed one counts as a key where its chain begins and would end.
RINGS = """rg AS (SELECT o_orderkey // 40 AS ring, o_orderkey % 40 // 10 AS side, o_orderkey % 10 AS j FROM orders WHERE o_orderkey % 97 <> 0),
sk AS MATERIALIZED (SELECT *, (y << 32) + x AS id FROM (SELECT ring % 50 * 24 + 12 + CASE side WHEN 0 THEN j WHEN 1 THEN 10 - j WHEN 2 THEN -j ELSE j - 10 END AS x, ring // 50 * 24 + 12 + CASE side WHEN 0 THEN 10 - j WHEN 1 THEN -j WHEN 2 THEN j - 10 ELSE j END AS y FROM rg)),
st(k, dx, dy) AS (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)),
stp AS MATERIALIZED (SELECT a.id AS u, b.id AS v, k FROM sk a CROSS JOIN st JOIN sk b ON b.x = a.x + dx AND b.y = a.y + dy),
deg0 AS MATERIALIZED (SELECT sk.*, count(u) <> 2 AS is_key FROM sk LEFT JOIN stp ON u = id GROUP BY x, y, id),
lc(node, component) USING KEY (node) AS (SELECT id, id FROM sk UNION SELECT q.node, q.component FROM (SELECT l.v AS node, min(lc.component) AS component FROM lc JOIN stp l ON l.u = lc.node GROUP BY l.v) q JOIN recurring.lc o ON o.node = q.node WHERE q.component < o.component),
closed AS MATERIALIZED (SELECT component FROM lc JOIN deg0 ON id = node GROUP BY component HAVING NOT bool_or(is_key)),
deg AS MATERIALIZED (SELECT x, y, id, is_key OR id IN (SELECT component FROM closed) AS is_key FROM deg0)"""


def sql() -> dict[str, str]:
    return {
        "ring_chains": f"""WITH RECURSIVE {CHAINS.replace(MASK, RINGS)} SELECT start IN (SELECT component FROM closed) AS loop, start, first, pos, x, y, round(along, 4) AS along FROM chain WHERE pos < last OR start NOT IN (SELECT component FROM closed)""",
        "mask_blobs": f"WITH RECURSIVE {MASK} SELECT x, y, size, size >= 80 AS kept FROM blob",
        "mask_degrees": f"WITH RECURSIVE {MASK} SELECT x, y, degree, is_key FROM deg",
        "mask_chains": f"WITH RECURSIVE {CHAINS} SELECT start, first, pos, x, y, round(along, 4) AS along FROM chain",
        "mask_classes": f"WITH RECURSIVE {MASK}{CLASSES} SELECT x, y, road_class FROM cls",
        "mask_edges": f"""WITH RECURSIVE {PIECES}, named AS (SELECT *, ax || ':' || ay AS f, bx || ':' || b_y AS t FROM piece WHERE (ax <> bx OR ay <> b_y) AND length > 0)
SELECT f AS "from", t AS "to", round(length, 3) AS length, round(length * CASE road_class WHEN 'white' THEN 1.0::DOUBLE ELSE 1.08::DOUBLE END, 3) AS cost, road_class FROM named QUALIFY row_number() OVER (PARTITION BY least(f, t), greatest(f, t) ORDER BY start, first, segment) = 1""",
        "mask_nodes": f"""WITH RECURSIVE {PIECES}, spot AS (SELECT ax AS x, ay AS y FROM piece UNION SELECT bx, b_y FROM piece)
SELECT x || ':' || y AS id, CAST(round((x * 6.58487266 + 4594.21749925) * 1000) AS BIGINT) AS map_x_thousandths, CAST(round((y * 6.60554791 + 3225.79270983) * 1000) AS BIGINT) AS map_y_thousandths, road_class, x AS source_x, y AS source_y FROM spot JOIN cls USING (x, y)"""}
