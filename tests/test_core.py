import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.jobs import queries
from trackgraph.operators import components, events, graph, network, poi, progress, raster, routing
from trackgraph.operators import telemetry as tracks
from trackgraph.operators.components import connected_components
from trackgraph.sources import adapters, packets

DATA = "/root/testdata/sf0.001"


def _plain(rows):
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(number(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _plain(got.select(*columns).collect()) == _plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    star = [(1, k) for k in range(2, 30)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")).collect()}
    assert {found[i] for i in range(100, 165)} == {100} and {found[i] for i in range(1, 30)} == {1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_paused_packet_is_accepted_and_later_ones_hold(spark):
    t = adapters.telemetry(spark, DATA).limit(0)
    row = dict.fromkeys(t.columns, 0)
    rows = [row | {"player_id": 1, "seq": k, "ts_ms": k * 100, "position_x": float(k), "speed_mps": v, "gear": g} for k, (v, g) in enumerate([(0.0, 0), (9.0, 2), (0.1, 0), (0.3, 0)])]
    made = spark.createDataFrame([tuple(float(r[f.name]) if f.dataType.simpleString() == "double" else int(r[f.name]) for f in t.schema) for r in rows], t.schema)
    got = tracks.held(made).orderBy("seq").select("position_x", "accepted").collect()
    assert [tuple(r) for r in got] == [(0.0, True), (1.0, True), (1.0, False), (3.0, True)]


def test_short_packets_are_rejected(spark):
    raw = spark.createDataFrame([(1, bytearray(323)), (1, bytearray(324)), (1, bytearray(322)), (1, bytearray(0)), (2, None)], "player_id long, payload binary")
    assert packets.decoded(raw).count() == 2
    assert {tuple(r) for r in packets.counts(raw).collect()} == {(1, 4, 2), (2, 1, 1)}
    one = np.zeros(1, packets.PACKET)
    one["TimestampMS"], one["Steer"] = 2**31 + 5, -7
    row = packets.decoded(spark.createDataFrame([(1, bytearray(one.tobytes()))], "player_id long, payload binary")).first()
    assert (row.TimestampMS, row.Steer) == (2**31 + 5, -7)


def test_cooldowns(spark):
    rows = [(1, 1, 0, "collision"), (1, 2, 0, "mega_fail_crash"), (1, 3, 2400, "collision"), (1, 4, 2500, "collision"), (1, 5, 6000, "collision"), (1, 6, 9000, "mega_fail_crash"), (1, 7, 9100, "off")]
    kept = events.thinned(spark.createDataFrame(rows, "player_id long, seq long, ts_ms long, event string")).collect()
    assert sorted(r.seq for r in kept) == [2, 4, 6]


def test_forest_equals_a_sequential_pass(spark):
    nodes = adapters.nodes(spark, "/root/testdata/sf0.01").where("pmod(node_id * 7, 5) > 1")
    edges = raster.neighbour_edges(nodes, queries.FACTORS, diagonal=False)
    components = graph.node_components(nodes, edges)
    candidates = graph.stitch_candidates(nodes, components)
    boss = {}

    def top(x):
        while boss.get(x, x) != x:
            x = boss[x]
        return x

    want = set()
    for r in sorted(candidates.collect(), key=lambda r: tuple(r.order)):
        if top(r.ca) != top(r.cb):
            boss[top(r.ca)] = top(r.cb)
            want.add((r.a, r.b))
    assert want and {(r.a, r.b) for r in graph.spanning_forest(candidates).collect()} == want


@pytest.mark.parametrize("placed", [True, False])
def test_paths_through_long_chains(spark, monkeypatch, placed):
    """Crossings joined by chains of 200 nodes; the number of jobs' rounds must not grow with them."""
    import heapq
    import random

    rnd, edges, far = random.Random(2), [], 1000
    for a, b in [(1, 2), (2, 3), (3, 4), (4, 1), (1, 3), (2, 5), (5, 6), (5, 6)]:
        nodes = [a, *range(far, far + 200), b]
        far += 200
        edges += [(x, y, float(rnd.randint(1, 9)), rnd.choice(["white", "orange", "synthetic_bridge"])) for x, y in zip(nodes, nodes[1:])]
    edges += [(9001, 9002, 1.0, "white"), (9002, 9003, 1.0, "white"), (9003, 9001, 1.0, "white")]  # a ring of its own
    costs = routing.profile_costs(spark.createDataFrame(edges, "a long, b long, length double, road_class string")).cache()
    wanted = [(1, 6), (6, 4), (1050, 2100), (1050, 1060), (3, 3), (1, 9001), (9001, 9003)]
    names = []
    monkeypatch.setattr(routing, "staged", lambda df, name, real=routing.staged: (names.append(name), real(df, name))[1])
    ends = {n: (40.0 * n % 700, 90.0 * n % 500) for a, b, *_ in edges for n in (a, b) if n != 5}  # one node without a place
    places = spark.createDataFrame([(n, *p) for n, p in ends.items()], "node_id long, map_x double, map_y double")
    paths = routing.shortest_paths(spark.createDataFrame(wanted, "s long, g long"), costs, places if placed else None).collect()
    assert names.count("front") <= 12
    out = {}
    for r in costs.collect():
        out.setdefault((r.profile, r.a), []).append((r.b, r.cost))
    weight = {(p, a, b): min(c for m, c in ends if m == b) for (p, a), ends in out.items() for b, _ in ends}
    for s, g in wanted:
        for profile in geo.PROFILES:
            best, heap = {}, [(0.0, s)]
            while heap:
                c, n = heapq.heappop(heap)
                if n not in best:
                    best[n] = c
                    for m, w in out[profile, n]:
                        heapq.heappush(heap, (c + w, m))
            mine = sorted((r.pos, r.node, r.cost) for r in paths if (r.s, r.g, r.profile) == (s, g, profile))
            if g not in best:
                assert not mine
                continue
            nodes = [n for _, n, _ in mine]
            assert [p for p, _, _ in mine] == list(range(len(mine))) and (nodes[0], nodes[-1]) == (s, g)
            assert abs(mine[0][2] - best[g]) < 1e-3 and abs(sum(weight[profile, a, b] for a, b in zip(nodes, nodes[1:])) - best[g]) < 1e-3


def test_crowded_cells_are_cut(spark):
    nodes = spark.createDataFrame([(k, k % 40 * 2.0, k // 40 * 2.0) for k in range(1600)] + [(5000, 900.0, 900.0)], "node_id long, map_x double, map_y double")
    sizes = routing.search_cells(nodes.selectExpr("node_id as node"), nodes).groupBy("cell").count().collect()
    assert sum(r["count"] for r in sizes) == 1601 and max(r["count"] for r in sizes) <= 2 * routing.CROWDED


def test_shortest_paths_equal_dijkstra(spark):
    import heapq

    edges = spark.createDataFrame([(1, 2, 10.0, "white"), (2, 3, 10.0, "orange"), (1, 3, 60.0, "synthetic_bridge"), (3, 4, 5.0, "white"), (5, 6, 1.0, "white")], "a long, b long, length double, road_class string")
    costs = routing.profile_costs(edges)
    paths = routing.shortest_paths(spark.createDataFrame([(1, 4), (2, 2), (1, 6)], "s long, g long"), costs).collect()
    graph_ = {}
    for r in costs.collect():
        graph_.setdefault((r.profile, r.a), []).append((r.b, r.cost))
    for profile in geo.PROFILES:
        best, heap = {}, [(0.0, 1)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                heap += [(c + w, m) for m, w in graph_[profile, n]]
                heapq.heapify(heap)
        mine = sorted((r.pos, r.node, r.cost) for r in paths if (r.s, r.g, r.profile) == (1, 4, profile))
        assert [n for _, n, _ in mine] == [1, 2, 3, 4] and abs(mine[0][2] - best[4]) < 1e-6
        assert [(r.pos, r.node) for r in paths if (r.s, r.g, r.profile) == (2, 2, profile)] == [(0, 2)]
    assert not [r for r in paths if r.g == 6]


def test_simplified_line_stays_within_tolerance():
    x = np.arange(200.0)
    y = 20 * np.sin(x / 15)
    keep = routing.douglas_peucker(x, y, 2.0)
    assert keep[0] == 0 and keep[-1] == 199 and len(keep) < 60
    assert np.abs(np.interp(x, x[keep], y[keep]) - y).max() < 2.5


def test_labels_and_road_classes(spark):
    rows = spark.createDataFrame([(" Orange-Dashed ",), ("MAGENTA",), (None,), ("x",)], "c string")
    assert [r[0] for r in rows.select(geo.road_class(F.col("c"))).collect()] == ["orange_dashed", "white", "unknown", "unknown"]
    rows = spark.createDataFrame([(2020.8, 3108.4)], "x double, z double").select(geo.map_x(-F.col("x"), -F.col("z")), geo.map_y(-F.col("x"), -F.col("z")))
    assert [round(v, 3) for v in rows.first()] == [9065.402, 11896.322]


def test_suspicious_reroute(spark):
    rows = spark.createDataFrame([(2000.0, 1000.0, 100.0, 0, False), (2000.0, 1000.0, 600.0, 0, False), (1300.0, 1000.0, 100.0, 0, False), (2000.0, 1000.0, 100.0, 0, True)], "new_length double, remaining double, off double, off_ms int, forced boolean")
    assert [r.rejected for r in progress.suspicious(rows).collect()] == [True, False, False, False]


def _islands(spark):
    """Two chains 200 px apart, a single node, and a chain of dashed roads that no bridge may reach."""
    rows = [(i, i, 0, i * 10.0, 0.0, "white") for i in range(3)] + [(10 + i, 22 + i, 0, 220.0 + i * 10, 0.0, "orange") for i in range(3)]
    rows += [(20, 12, 10, 120.0, 100.0, "white")] + [(30 + i, i, 30, i * 10.0, 300.0, "orange_dashed") for i in range(2)]
    return spark.createDataFrame(rows, "node_id long, gx long, gy long, map_x double, map_y double, road_class string")


def test_requests_are_routed_over_bridges(spark, monkeypatch):
    nodes = _islands(spark)
    monkeypatch.setattr(adapters, "nodes", lambda spark, sf_dir: nodes)
    monkeypatch.setattr(adapters, "requests", lambda spark, sf_dir: spark.createDataFrame([(1, 0.0, 0.0, 240.0, 0.0)], "request_id long, start_x double, start_y double, target_x double, target_y double"))
    found = {r.node_id: r.component for r in queries._repaired(spark, DATA)[2].collect()}
    assert {k for k, c in found.items() if c == 0} == {0, 1, 2, 10, 11, 12} and found[20] == 20 and found[31] == 30
    route = queries.best_routes(spark, DATA).first()
    assert route.s == 0 and route.length >= 220 and route.physical == 240.0


def test_bridges_reach_320_px_between_stitched_components(spark, monkeypatch):
    nodes = _islands(spark)
    monkeypatch.setattr(adapters, "nodes", lambda spark, sf_dir: nodes)
    assert [(r.a, r.b, r.length) for r in queries.graph_bridges(spark, DATA).collect()] == [(2, 10, 200.0)]


def test_nearest_without_radius_equals_brute_force(spark):
    spots = [(i, float(i * 7919 % 3000), float(i * 104729 % 2500)) for i in range(60)] + [(60, 90_000.0, -40_000.0)]
    points = [(i, float(i * 613 % 4000 - 500), float(i * 389 % 3000)) for i in range(40)] + [(40, -70_000.0, 10.0), (41, 88_000.0, -40_000.0)]
    p, t = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(spots, "t long, map_x double, map_y double")
    want = {(i, r + 1, j) for i, x, y in points for r, (_, j) in enumerate(sorted((math.hypot(x - a, y - b), j) for j, a, b in spots)[:4])}
    assert {(r.p, r.rank, r.t) for r in poi.nearest(p, t, "p", "t", 4, None).collect()} == want
    assert poi.nearest(p, t, "p", "t", 100, None).count() == len(points) * len(spots)
    assert poi.nearest(p, t.limit(0), "p", "t", 4, None).count() == 0


def test_pairs_beyond_the_ten_nearest_nodes(spark, monkeypatch):
    """Around each end 12 single nodes are nearer than the road that joins both ends."""
    rows = [(i, i * 100, 0, 3.0 * i, 0.0, "white") for i in range(12)] + [(20 + i, i * 100, 900, 1000 + 3.0 * i, 0.0, "white") for i in range(12)]
    rows += [(50 + i, 5000 + i, 0, i * 100.0, 400.0, "white") for i in range(12)]
    nodes = spark.createDataFrame(rows, "node_id long, gx long, gy long, map_x double, map_y double, road_class string")
    monkeypatch.setattr(adapters, "nodes", lambda spark, sf_dir: nodes)
    monkeypatch.setattr(adapters, "requests", lambda spark, sf_dir: spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0)], "request_id long, start_x double, start_y double, target_x double, target_y double"))
    assert (queries.candidate_pairs(spark, DATA).count(), queries.snapped_nodes_for_routing(spark, DATA).count()) == (4, 36)


def test_search_reads_descriptions(spark):
    markers = spark.createDataFrame([(1, "Barn", "a", "b", "Hidden BARN find", None, 0.0, 0.0), (2, "Sign", "a", "b", None, "near the hidden lake", 3.0, 4.0), (3, "hidden", "a", "b", None, None, 9.0, 0.0), (4, "Speed", "a", "b", None, None, 1.0, 0.0)],
                                    "file_order long, title string, category string, parent_category string, description string, desc string, map_x double, map_y double")
    asked = spark.createDataFrame([(1, " Hidden ", 0.0, 0.0), (2, "lake sign", 0.0, 0.0), (3, "  ", 0.0, 0.0), (4, "barn lake", 0.0, 0.0), (5, "hidden", 9.0, 0.0)], "query_id long, text string, x double, y double")
    want = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2), (5, 1, 3), (5, 2, 2), (5, 3, 1)]
    rows = lambda: sorted((r.query_id, r["rank"], r.file_order) for r in poi.search(asked, markers).collect())
    assert rows() == want
    plan = poi.search(asked, markers)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_search_by_pieces_equals_a_scan(spark):
    """Terms of one, two and more characters, some of them nowhere, against every text."""
    import random

    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcä") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 4))) for _ in range(60)]
    terms = [sorted({"".join(rnd.choice("abcäz") for _ in range(rnd.choice((1, 1, 2, 3, 4)))) for _ in range(rnd.randint(1, 3))}) for _ in range(150)]
    found = poi.matches(spark.createDataFrame([(t,) for t in terms], "terms array<string>").distinct(), spark.createDataFrame(list(enumerate(texts)), "file_order long, hay string"), "hay").collect()
    want = {(tuple(t), k) for t in terms for k, text in enumerate(texts) if all(x in text for x in t)}
    assert len(found) == len(want) and {(tuple(r.terms), r.file_order) for r in found} == want


def test_reroute_without_a_usable_route(spark):
    rows = [(1, t, None, 500.0, 0.0, 0.0) for t in (0, 1000, 2800, 2900, 5700, 5701)] + [(1, 9000, None, 30.0, 0.0, 0.0), (1, 9100, 10.0, 500.0, 0.0, 0.0), (1, 22000, 10.0, 500.0, 800.0, 0.0)]
    got = progress.reroutes(spark.createDataFrame(rows, "player_id long, ts_ms long, off double, to_target double, map_x double, map_y double")).collect()
    assert sorted((r.ts_ms, r.reason) for r in got) == [(0, "no_route"), (2900, "no_route"), (5701, "no_route"), (22000, "moved")]


def test_chains_of_a_mask(spark):
    from trackgraph.operators import network

    line = [(x, 0) for x in range(14)]
    loop = [(x, y) for x in range(29, 36) for y in range(9, 16) if abs(x - 32) + abs(y - 12) == 3]
    star = [(50 + d, 50) for d in range(-4, 5)] + [(50, 50 + d) for d in range(1, 5)]
    pixels = spark.createDataFrame(line + loop + star, "x long, y long")
    rows = network.chains(pixels).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.pos):
        by.setdefault((r.loop, r.start, r.first), []).append((r.x, r.y))
    assert by[False, 0, 4] == line
    (ring,) = [p for (loop_, _, _), p in by.items() if loop_]
    assert ring[0] == (32, 9) and len(ring) == len(loop) and set(ring) == set(loop)
    near = lambda a, b: a != b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1
    steps = [frozenset(s) for p in by.values() for s in zip(p, p[1:])]
    points = line + loop + star
    every = {frozenset((a, b)) for a in points for b in points if near(a, b)}
    assert len(steps) == len(set(steps)) == len(every) - 1  # the loop stays open by one step
    classes = pixels.withColumn("road_class", F.lit("white"))
    pieces = network.segments(network.chains(pixels), classes)
    assert sorted((r.a.x, r.b.x) for r in pieces.where("start = 0").collect()) == [(0, 6), (6, 12), (12, 13)]
    assert network.chains(pixels.limit(0)).count() == 0


def test_blobs_of_a_mask(spark):
    from trackgraph.operators import network

    mask = spark.createDataFrame([(x, 0, 200) for x in range(79)] + [(x, 5, 200) for x in range(80)] + [(x, 6, 100) for x in range(9)], "x long, y long, grey long")
    assert {(r.y, r.size, r.kept) for r in network.blobs(mask).collect()} == {(0, 79, False), (5, 80, True)}


def test_stored_cost_needs_a_stored_length_or_an_unknown_class(spark):
    from trackgraph.operators import graph

    nodes = spark.createDataFrame([(1, 0.0, 0.0, "white"), (2, 10.0, 0.0, "white"), (3, 20.0, 0.0, "unknown")], "node_id long, map_x double, map_y double, road_class string")
    edges = spark.createDataFrame([(1, 2, None, 77.0, None, 0), (2, 3, None, 55.0, None, 1)], "a long, b long, length double, cost double, road_class string, seq long")
    assert {(r.a, r.b): r.cost for r in graph.normalised_edges(edges, nodes).collect()} == {(1, 2): 10.0, (2, 3): 55.0}


def test_classes_at_and_past_the_edge_of_the_image(spark):
    orange = [(x, y, 200, 120, 40) for x in range(8, 12) for y in range(8, 10)]
    pixels = spark.createDataFrame(orange, "x long, y long, r long, g long, b long")
    size = (12, 10)
    assert network.extent(pixels) == size and network.extent(pixels.limit(0)) == (0, 0)
    hint = network.orange_hint(pixels, size)
    assert max(r.x for r in hint.collect()) == 11
    points = spark.createDataFrame([(11, 9), (0, 0), (11, 0), (5, 9)], "x long, y long")
    got = {(r.x, r.y): r.road_class for r in network.pixel_classes(points, hint, size).collect()}
    assert got == {(11, 9): "orange", (0, 0): "white", (11, 0): "white", (5, 9): "orange"}
    for x, y in ((12, 9), (14, 9), (30_000, 0), (0, 10), (-1, 0)):
        with pytest.raises(Exception, match="outside the image"):
            network.pixel_classes(spark.createDataFrame([(x, y)], "x long, y long"), hint, size).collect()
        with pytest.raises(Exception, match="outside the image"):
            network.orange_hint(spark.createDataFrame([(x, y, 200, 120, 40)], pixels.schema), size).collect()


def test_nearest_segments_of_long_routes(spark):
    """By cells and against every segment: routes that wind, cross themselves, stand still, and rows far from them."""
    rnd = np.random.default_rng(6)
    lines, track = [], []
    for route in (1, 2, 3):
        x, y = np.cumsum(rnd.normal(0, 300 * route, 60)) + 9000, np.cumsum(rnd.normal(0, 300 * route, 60)) + 9000
        x[20:23], y[20:23] = x[20], y[20]
        lines += [(route, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
        for k in range(150):
            i, far = rnd.integers(0, 60), rnd.choice([0.0, 50.0, 600.0, 3000.0, 15000.0])
            track.append((route, len(track), 100 * k, route, float(x[i] + rnd.normal() * far), float(y[i] + rnd.normal() * far)))
    track.append((9, 1, 0, 1, None, None))
    lines = spark.createDataFrame(lines, "route_id long, pos int, x double, y double")
    rows = spark.createDataFrame(track, "player_id long, seq long, ts_ms long, route_id long, map_x double, map_y double")
    s = progress.segments(lines)
    near, whole = (sorted((tuple(r) for r in progress.nearest_segment(rows, s, few).collect()), key=lambda r: r[1::-1]) for few in (16, 10_000))
    assert near == whole and len(near) == len(track)


def test_places_along_routes(spark):
    line = [(1, 0, 0.0, 0.0), (1, 1, 300.0, 0.0), (1, 2, 300.0, 0.0), (1, 3, 300.0, 400.0), (1, 4, 300.0, 400.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]
    v = progress.vertices(spark.createDataFrame(line, "route_id long, pos int, x double, y double"))
    wanted = spark.createDataFrame([(1, w) for w in (-5.0, 0.0, 256.0, 300.0, 512.0, 700.0, 9e9)] + [(2, 1.0)], "route_id long, at double")
    got = {(r.route_id, r["at"]): (r.x, r.y) for r in progress.along_route(wanted, v).collect()}
    assert got == {(1, -5.0): (0.0, 0.0), (1, 0.0): (0.0, 0.0), (1, 256.0): (256.0, 0.0), (1, 300.0): (300.0, 0.0), (1, 512.0): (300.0, 212.0), (1, 700.0): (300.0, 400.0), (1, 9e9): (300.0, 400.0), (2, 1.0): (None, None)}


def test_parallel_edges_in_input_order(spark):
    """A later edge wins against the kept one's length by its class, not against its stored cost."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0, "white"), (2, 30.0, 0.0, "white")], "node_id long, map_x double, map_y double, road_class string")
    rows = [(1, 2, 10.0, 99.0, "white", 0), (2, 1, 12.0, 50.0, "orange", 1), (1, 2, 20.0, 9.0, "orange_dashed", 2), (2, 1, 40.0, 30.0, "white", 3)]
    edges = spark.createDataFrame(rows, "a long, b long, length double, cost double, road_class string, seq int")
    assert [tuple(r) for r in graph.normalised_edges(edges, nodes).collect()] == [(1, 2, 40.0, 30.0, "white")]
    assert [tuple(r) for r in graph.normalised_edges(edges, nodes, in_order=False).collect()] == [(1, 2, 20.0, 9.0, "orange_dashed")]


def test_radii_of_headers(spark):
    header = lambda **row: spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in zip(row, ("string", "int", "double"))))
    cells, pixels = "runtime_stitch_radius_cells", "runtime_component_bridge_radius_px"
    assert graph.radii(header(version="manual-1", **{cells: 3, pixels: 140.0})) == (3, 140.0)
    assert graph.radii(header(version="manual-1", **{cells: 0, pixels: None})) == (0, 0.0)
    assert graph.radii(header(version="Road-CV-2", **{cells: 0, pixels: 50.0})) == (4, 50.0)
    assert graph.radii(header(version="v1")) == (0, 0.0) and graph.radii(header(version="v1").limit(0)) == (0, 0.0)


def test_repair_without_radii_and_first_nodes_of_cells(spark):
    nodes = [(k, k, 0, k * 10.0, 0.0, "white") for k in (0, 1, 4, 5)] + [(9, 4, 0, 41.0, 0.0, "white"), (20, 30, 0, 300.0, 0.0, "orange"), (21, 31, 0, 310.0, 0.0, "orange"), (30, 90, 0, 900.0, 0.0, "white")]
    nodes = spark.createDataFrame(nodes, "node_id long, gx long, gy long, map_x double, map_y double, road_class string")
    edges = spark.createDataFrame([(0, 1, 10.0, 10.0, "white"), (4, 5, 10.0, 10.0, "white"), (20, 21, 10.0, 10.0, "orange")], "a long, b long, length double, cost double, road_class string")
    header = spark.createDataFrame([("cv",)], "version string")
    found = graph.repaired(nodes, edges, header)
    # node 9 shares its cell with the earlier node 4: it reaches out to 5, but none reaches it
    assert sorted((r.a, r.b) for r in found.stitches.collect()) == [(0, 4), (9, 5)]
    assert [(r.a, r.b, r.length) for r in found.bridges.collect()] == [(5, 20, 250.0)]
    assert {r.node_id: r.component for r in found.components.collect()} == {0: 0, 1: 0, 4: 0, 5: 0, 9: 0, 20: 0, 21: 0, 30: 30}
    plain = graph.repaired(nodes, edges, spark.createDataFrame([("manual",)], "version string"))
    assert plain.stitches.count() == plain.bridges.count() == 0 and plain.components.select("component").distinct().count() == 5
    assert plain.stitches.columns == found.stitches.columns


def test_search_next_to_queries_equals_a_scan(spark):
    """Many markers at one place, none, infinite places, ties by title, terms without hits, queries without a place, categories."""
    import random

    rnd = random.Random(5)
    spot = lambda: rnd.choice([(float(rnd.randint(0, 30)), float(rnd.randint(0, 30))), (7.0, 7.0), (None, 3.0), (None, None), (float("inf"), 2.0), (9e6, 9e6)])
    rows = [(k, rnd.choice(["Barn a", "barn b", None, "Tin"]), rnd.choice(["P", "Q", "", None]), "b", *spot()) for k in range(400)]
    asked = [(k, rnd.choice(["barn", "tin b", "b", "nowhere", "BARN  A"]), rnd.choice([None, "P", "R"]), *rnd.choice([(float(k % 30), 7.0), (None, 1.0), (-4e5, 3.0), (7.0, 7.0)])) for k in range(60)]
    markers = spark.createDataFrame(rows, "file_order long, title string, category string, parent_category string, map_x double, map_y double")
    queries_ = spark.createDataFrame(asked, "query_id long, text string, category string, x double, y double")

    def want(limit, same):
        out = set()
        for q, text, kind, x, y in asked:
            near = []
            for k, title, category, parent, mx, my in rows:
                hay = " ".join(t for t in (title, category, parent) if t is not None).lower()
                if all(t in hay for t in text.lower().split()) and (not same or kind is None or kind == category):
                    d = None if None in (x, y, mx, my) else round(math.sqrt((x - mx) ** 2 + (y - my) ** 2), 2)
                    near.append(((d is None, d or 0.0), (title is not None, (title or "").lower()), k))
            out |= {(q, k, r + 1) for r, (_, _, k) in enumerate(sorted(near)[:limit])}
        return out

    for limit, same in ((3, None), (25, "category")):
        found = poi.search(queries_, markers, limit, same)
        assert {(r.query_id, r.file_order, r["rank"]) for r in found.collect()} == want(limit, same)
        assert found.columns == ["query_id", *markers.columns, "distance", "rank"]


def _most_joined(found):
    """The rows of ``found``, and the most rows that a join in its plan made."""
    rows, most = found.collect(), 0
    plan = [found._jdf.queryExecution().executedPlan()]
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return rows, most


def test_searches_of_equal_queries_read_near_markers_only(spark):
    """3000 markers that all have the term and 400 queries at two places: never all pairs."""
    markers = spark.range(3000).selectExpr("id as file_order", "'tin' as title", "'P' as category", "'b' as parent_category", "cast(id % 1500 as double) as map_x", "cast(id * 7 % 1500 as double) as map_y")
    asked = spark.range(400).selectExpr("id as query_id", "'tin' as text", "cast(null as string) as category", "cast(id % 2 * 700 as double) as x", "3.0D as y")
    rows, most = _most_joined(poi.search(asked, markers, 8))
    assert len(rows) == 3200 and most <= 3200


def test_equal_boxes_read_the_first_markers_only(spark):
    """A box that is full after the first markers in file order meets no others; one that is never full meets all."""
    markers = spark.range(40_000).selectExpr("39999 - id as file_order", "'t' as title", "'P' as category", "cast(id * 7 % 100 as double) as map_x", "cast(id % 97 as double) as map_y")
    boxes = spark.range(50).selectExpr("id as box_id", "0.0D as x0", "0.0D as y0", "if(id = 3, 2.0D, 90.0D) as x1", "if(id = 3, 1.0D, 90.0D) as y1").union(spark.sql("select 99L, 5.0D, 5.0D, 1e12D, 4.0D"))
    rows, most = _most_joined(poi.in_boxes(boxes, markers, pad=0, most=20))
    inside = lambda x1, y1: [k for k in range(40_000) if (39_999 - k) * 7 % 100 <= x1 and (39_999 - k) % 97 <= y1][:20]
    want = {b: inside(2, 1) if b == 3 else inside(90, 90) for b in range(50)}
    assert {b: [r.file_order for r in sorted(rows, key=lambda r: r["rank"]) if r.box_id == b] for b in range(50)} == want
    assert len(rows) == 1000 and most <= 40_000


def test_nearest_of_equal_points_reads_near_places_only(spark):
    """4000 targets at 1000 places and 300 points at three: the same rows as all pairs, without them."""
    targets = spark.range(4000).selectExpr("id as t", "cast(id % 1000 * 7 % 1000 as double) as map_x", "cast(id % 1000 * 13 % 1000 as double) as map_y")
    points = spark.range(300).selectExpr("id as p", "cast(id % 3 * 400 as double) as x", "5.0D as y").union(spark.sql("select 1000L, cast('NaN' as double), 1.0D"))
    spots = [(k, k % 1000 * 7 % 1000, k % 1000 * 13 % 1000) for k in range(4000)]
    for radius in (None, 30.0):
        want = {i: [k for d, k in sorted((math.hypot(i * 400 - a, 5 - b), k) for k, a, b in spots)[:6] if radius is None or d <= radius] for i in range(3)}
        rows, most = _most_joined(poi.nearest(points, targets, "p", "t", 6, radius))
        assert {(r.p, r["rank"], r.t) for r in rows} == {(p, n + 1, k) for p in range(300) for n, k in enumerate(want[p % 3])} and most <= 4000


@pytest.mark.parametrize("few", [True, False])
def test_close_components_need_few_tables(spark, monkeypatch, few):
    """A long snake of pixels, stars, many small graphs, self edges and ends without an id; tables do not grow with the snake."""
    import random

    rnd, names = random.Random(1), []
    snake = [(i, i + 1) for i in range(5000)]
    more = [(9000, 9000 + rnd.randint(0, 400)) for _ in range(300)] + [(rnd.randint(20_000, 24_000), rnd.randint(20_000, 24_000)) for _ in range(1500)] + [(30_000, 30_000), (None, 5), (7, None)]
    rnd.shuffle(snake)
    edges = [e if rnd.random() < 0.5 else e[::-1] for e in snake + more]
    top = {}

    def find(k):
        while top.setdefault(k, k) != k:
            k = top[k]
        return k

    for u, v in edges:
        if None not in (u, v) and u != v:
            a, b = sorted((find(u), find(v)))
            top[b] = a
    monkeypatch.setattr(components, "staged", lambda df, name, real=components.staged: (names.append(name), real(df, name))[1])
    if not few:
        monkeypatch.setattr(components, "CHUNK", 0)
    found = components.close_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()
    assert len(found) == len(top) and {r.node: r.component for r in found} == {k: find(k) for k in top}
    assert len(names) <= (3 if few else 12)
    assert components.close_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert [(r.node, r.component) for r in components.close_components(spark.createDataFrame([("b", "a")], "a string, b string")).orderBy("node").collect()] == [("a", "a"), ("b", "a")]
