"""SQL of the queries on clean masks."""

from __future__ import annotations

STROKES = """so AS (SELECT o_orderkey AS k, o_orderkey // 80 AS line, o_orderkey % 80 AS along FROM orders),
sp AS (SELECT k, line, along * 4 + line % 3 * 100 AS x, line * 9 + along // 20 % 2 AS y, CASE WHEN line % 6 = 5 THEN 8 ELSE 3 END AS thick, CASE WHEN k % (CASE WHEN line % 5 = 4 THEN 5 ELSE 17 END) = 0 THEN 0 WHEN k % 29 = 0 THEN 3 ELSE 4 END AS size FROM so),
sq AS (SELECT k, line, x + dx AS x, y + dy AS y FROM sp JOIN range(4) a(dx) ON dx < size JOIN range(8) b(dy) ON dy < thick),
sc AS (SELECT x, y, max({'r': [220, 220, 200, 90][line % 4 + 1], 'g': [220, 120, 60, 90][line % 4 + 1], 'b': [215, 60, 160, 90][line % 4 + 1], 'alpha': CASE WHEN k % 41 = 0 THEN 10 ELSE 255 END}) AS c FROM sq GROUP BY x, y),
o3 AS (SELECT i AS dx, j AS dy FROM range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j)),
m0 AS MATERIALIZED (SELECT 'white' AS kind, x, y FROM sc WHERE c.alpha >= 35 AND ((greatest(c.r, c.g, c.b) >= 188 AND greatest(c.r, c.g, c.b) - least(c.r, c.g, c.b) <= 48 AND least(c.r, c.g, c.b) >= 145) OR (c.r >= 150 AND c.b >= 105 AND c.g <= 120 AND c.r - c.g >= 45 AND c.b - c.g >= 35))
 UNION ALL SELECT 'orange', x, y FROM sc WHERE c.alpha >= 35 AND c.r >= 185 AND c.g BETWEEN 75 AND 175 AND c.b <= 115 AND c.r - c.b >= 85 AND c.r - c.g >= 8)"""


def _clean(tile: int | None) -> str:
    """CTEs for runs, blobs and shapes; pixels of different tiles are no neighbours."""
    same = (lambda a, b: "true") if tile is None else (lambda a, b: f"{a} // {tile} = ({b}) // {tile}")
    inside = f"{same('x', 'x + dx')} AND {same('y', 'y + dy')}" + ("" if tile is None else " AND x + dx >= 0 AND y + dy >= 0")
    grow = lambda name, of: f"{name} AS MATERIALIZED (SELECT DISTINCT kind, x + dx AS x, y + dy AS y FROM {of} CROSS JOIN o3 WHERE {inside})"
    shrink = lambda name, of: f"{name} AS MATERIALIZED (SELECT p.kind, p.x, p.y FROM (SELECT kind, x, y, x + dx AS nx, y + dy AS ny FROM {of} CROSS JOIN o3 WHERE {inside}) p LEFT JOIN {of} q ON q.kind = p.kind AND q.x = nx AND q.y = ny GROUP BY ALL HAVING count(*) = count(q.x))"
    part = "" if tile is None else f", x // {tile}"
    return f"""{STROKES}, {grow("m1", "m0")}, {shrink("m2", "m1")}, {shrink("m3", "m2")}, {grow("m4", "m3")},
rn AS MATERIALIZED (SELECT kind, y, min(x) AS x0, max(x) AS x1, row_number() OVER (ORDER BY kind, y, min(x)) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY kind, y{part} ORDER BY x) AS island FROM m4) GROUP BY kind, y, island{part}),
rl AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM rn a JOIN rn b ON a.kind = b.kind AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 AND {same("a.x0", "b.x0")} AND {same("a.y", "b.y")}),
rlink AS MATERIALIZED (SELECT u, v FROM rl UNION SELECT v, u FROM rl),
rc(node, component) USING KEY (node) AS (SELECT id, id FROM rn UNION SELECT q.node, q.component FROM (SELECT l.v AS node, min(rc.component) AS component FROM rc JOIN rlink l ON l.u = rc.node GROUP BY l.v) q JOIN recurring.rc o ON o.node = q.node WHERE q.component < o.component),
shape AS (SELECT component, any_value(kind) AS kind, min(x0) AS "left", min(y) AS top, max(x1) - min(x0) + 1 AS width, max(y) - min(y) + 1 AS height, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM rn JOIN rc ON node = id GROUP BY component),
judged AS MATERIALIZED (SELECT *, greatest(width, height) / least(width, height) AS long, area / (width * height) AS fill, area >= 55 AND greatest(width, height) >= 26
 AND NOT (area < CASE kind WHEN 'white' THEN 4200 ELSE 1200 END AND long < CASE kind WHEN 'white' THEN 2.35::DOUBLE ELSE 1.8::DOUBLE END) AND NOT (fill > CASE kind WHEN 'white' THEN 0.36::DOUBLE ELSE 0.52::DOUBLE END AND long < 3.2::DOUBLE) AS kept FROM shape)"""


def sql() -> dict[str, str]:
    blobs = lambda tile: f'WITH RECURSIVE {_clean(tile)} SELECT kind, "left", top, width, height, area, kept FROM judged'
    return {
        "tile_blobs": blobs(256), "map_blobs": blobs(None),
        "clean_road_grid": f"""WITH RECURSIVE {_clean(256)}, px AS (SELECT unnest(range(x0, x1 + 1)) AS x, y, j.kind FROM rn JOIN rc ON node = id JOIN judged j ON j.component = rc.component WHERE kept),
flag AS (SELECT x, y, bool_or(kind = 'white') AS white, bool_or(kind = 'orange') AS orange FROM px GROUP BY x, y),
cells AS (SELECT x // 256 AS tile_x, y // 256 AS tile_y, x % 256 // 10 AS cell_x, y % 256 // 10 AS cell_y, count(*) AS n, count(*) FILTER (WHERE white) AS w, count(*) FILTER (WHERE orange) AS o FROM flag GROUP BY ALL),
ratio AS (SELECT *, n / (least(10, 256 - cell_x * 10) * least(10, 256 - cell_y * 10)) AS road_ratio, w / (least(10, 256 - cell_x * 10) * least(10, 256 - cell_y * 10)) AS white_ratio, o / (least(10, 256 - cell_x * 10) * least(10, 256 - cell_y * 10)) AS orange_ratio FROM cells),
k AS (SELECT *, CASE WHEN white_ratio >= 0.13 AND white_ratio >= 0.55 * orange_ratio THEN 0 WHEN orange_ratio >= 0.28 THEN 1 WHEN orange_ratio >= 0.16 THEN 2 ELSE 4 END AS kind, CAST(round_even((tile_x * 256 + cell_x * 10 + 5.0::DOUBLE) / 10, 0) AS BIGINT) AS gx, CAST(round_even((tile_y * 256 + cell_y * 10 + 5.0::DOUBLE) / 10, 0) AS BIGINT) AS gy FROM ratio WHERE road_ratio >= 0.16),
f AS (SELECT *, min(kind) OVER (PARTITION BY gx, gy) AS best FROM k WHERE kind < 4 QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY tile_y, tile_x, cell_y, cell_x) = 1)
SELECT gx, gy, CAST(gx * 10 AS DOUBLE) AS map_x, CAST(gy * 10 AS DOUBLE) AS map_y, CASE best WHEN 0 THEN 'white' WHEN 1 THEN 'orange' ELSE 'orange_dashed' END AS road_class, round(road_ratio, 6) AS road_ratio, round(white_ratio, 6) AS white_ratio, round(orange_ratio, 6) AS orange_ratio FROM f"""}
