"""Routes for many requests at once: snapping, candidate pairs, shortest paths, scores and outcomes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.functions.storage import staged
from trackgraph.operators.lists import ancestors, ranked_lists
from trackgraph.operators.poi import nearest

SNAP_MOST, SNAP_RADIUS, PAIRS = 96, 1800.0, 4


def profile_costs(edges: DataFrame, profiles: dict = geo.PROFILES) -> DataFrame:
    """Both directions of every edge with its cost in each profile: ``profile, a, b, cost, length, road_class``."""
    kind = (F.when(F.col("road_class") != "synthetic_bridge", F.col("road_class")).when(F.col("length") <= 70, "synthetic_short")
            .when(F.col("length") <= 180, "synthetic_medium").otherwise("synthetic_bridge"))
    rows = [(p, rank, k, float(m)) for rank, (p, t) in enumerate(profiles.items()) for k, m in t.items()]
    dim = edges.sparkSession.createDataFrame(rows, "profile string, profile_rank int, kind string, multiplier double")
    both = edges.select("a", "b", "length", "road_class").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length", "road_class"))
    return both.withColumn("kind", kind).join(F.broadcast(dim), "kind").select("profile", "profile_rank", "a", "b", (F.col("length") * F.col("multiplier")).alias("cost"), "length", "road_class")


def snapped(requests: DataFrame, nodes: DataFrame, end: str, k: int = SNAP_MOST, radius: float = SNAP_RADIUS) -> DataFrame:
    """The nearest nodes of one end (``start`` or ``target``) of each request."""
    points = requests.select("request_id", F.col(f"{end}_x").alias("x"), F.col(f"{end}_y").alias("y"))
    return nearest(points, nodes, "request_id", "node_id", k, radius)


def candidate_pairs(start: DataFrame, goal: DataFrame, components: DataFrame, most: int = PAIRS) -> DataFrame:
    """The best start x goal pairs in one component: score is both snaps plus 600 / sqrt(component size)."""
    s = start.select("request_id", F.col("node_id").alias("s"), F.col("distance").alias("s_snap"), F.col("rank").alias("s_rank")).join(components.withColumnRenamed("node_id", "s"), "s")
    g = goal.select("request_id", F.col("node_id").alias("g"), F.col("distance").alias("g_snap"), F.col("rank").alias("g_rank")).join(components.select(F.col("node_id").alias("g"), "component"), "g")
    # a pair beyond the first `most` of either side in its component can never be among the best `most`
    top = lambda t, r: t.withColumn("i", F.row_number().over(Window.partitionBy("request_id", "component").orderBy(r))).where(F.col("i") <= most).drop("i")
    pairs = top(s, "s_rank").join(top(g, "g_rank"), ["request_id", "component"])
    pairs = pairs.withColumn("score", F.col("s_snap") + F.col("g_snap") + 600.0 / F.sqrt(F.col("size").cast("double")))
    order = Window.partitionBy("request_id").orderBy("score", "s_rank", "g_rank")
    return pairs.withColumn("pair_rank", F.row_number().over(order)).where(F.col("pair_rank") <= most).select("request_id", "pair_rank", "s", "g", "s_snap", "g_snap", "score")


def contracted(costs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Super-edges ``profile, a, b, cost, chain`` and ``chain, pos, node``, the nodes that each stands for, its first one included.

    Nodes with two neighbours that are no ``stops`` (column node) go; each run of them becomes one edge in either direction. Of several
    between two nodes the cheapest of a profile stays, then the one of the lesser chain (named by its last step). Runs that close
    without a stop or a crossing lead nowhere and go.
    """
    steps = costs.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    degree = steps.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).join(stops.withColumn("stop", F.lit(True)), "node", "left")
    key = staged(degree.select("node", ((F.col("n") != 2) | F.col("stop").isNotNull()).alias("key")), "keys")
    steps = steps.join(key.select(F.col("node").alias("u"), F.col("key").alias("u_key")), "u").join(key.select(F.col("node").alias("v"), F.col("key").alias("v_key")), "v")
    steps = staged(steps.select(F.struct("u", "v").alias("id"), "u", "v", "u_key", "v_key"), "steps")
    onward = steps.where("not u_key").select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("id").alias("next"))
    one = F.lit(1).cast("long").alias("weight")
    links = steps.where("not v_key").join(onward, "v").where("w <> u").select("id", "next", one)
    links = links.unionByName(steps.where("v_key").select("id", F.lit(None).cast(steps.schema["id"].dataType).alias("next"), one))
    ranked = ranked_lists(links)[0].join(steps, "id")
    first = ranked.where("u_key").select("end", F.col("u").alias("a"), F.col("hops").alias("most"))
    chain = staged(ranked.join(first, "end").where("a <> end.v").select(F.col("end").alias("chain"), "a", F.col("end.v").alias("b"), "u", "v", (F.col("most") - F.col("hops")).alias("pos")), "chains")
    priced = chain.join(costs.select("profile", F.col("a").alias("u"), F.col("b").alias("v"), F.col("cost").alias("w")), ["u", "v"])
    whole = priced.groupBy("profile", "a", "b", "chain").agg(F.round(F.sum("w"), 6).alias("cost"))
    best = whole.groupBy("profile", "a", "b").agg(F.min(F.struct("cost", "chain")).alias("m")).select("profile", "a", "b", "m.cost", "m.chain")
    return staged(best, "supers"), chain.select("chain", "pos", F.col("u").alias("node"))


#: Side of a cell of the search, crossings in it from which it is cut into quarters, and sources that one task takes through a cell.
CELL, CROWDED, SOURCES = 160.0, 256, 1024


def search_cells(crossings: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """``node, cell`` of crossings: squares of the map, smaller ones where they are crowded; without places each is a cell of its own."""
    own = F.concat(F.lit("n"), F.col("node").cast("string"))
    if nodes is None:
        return crossings.select("node", own.alias("cell"))
    at = crossings.join(nodes.select(F.col("node_id").alias("node"), "map_x", "map_y"), "node", "left").withColumns({"cx": geo.cell(F.col("map_x"), CELL), "cy": geo.cell(F.col("map_y"), CELL)})
    counts = at.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    level = F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n") / CROWDED) / 2))
    at = at.join(counts.select("cx", "cy", F.pow(F.lit(2.0), level).alias("cuts")), ["cx", "cy"], "left")
    part = lambda c: F.floor(F.col(c) / (CELL / F.col("cuts"))).cast("string")
    square = F.concat(F.col("cuts").cast("int").cast("string"), F.lit(":"), part("map_x"), F.lit(":"), part("map_y"))
    return at.select("node", F.coalesce(square, own).alias("cell"))


def _inside(edges: pd.DataFrame, ends: np.ndarray, hops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The nodes of a cell, the least costs between them inside it, and (if ``hops``) the next node on the way from each to each."""
    own = edges[edges["to_cell"].isna()]
    nodes = np.unique(np.concatenate([edges["a"].to_numpy(), own["b"].to_numpy(), ends]))
    cost = np.full((len(nodes), len(nodes)), np.inf)
    i, j = np.searchsorted(nodes, own["a"]), np.searchsorted(nodes, own["b"])
    np.minimum.at(cost, (i, j), own["w"].to_numpy())
    np.fill_diagonal(cost, 0.0)
    step = np.where(np.isfinite(cost), np.arange(len(nodes))[None, :], -1) if hops else None
    for k in range(len(nodes)):
        over = cost[:, k, None] + cost[k, None, :]
        if hops:
            less = over < cost
            step = np.where(less, step[:, k, None], step)
        np.minimum(cost, over, out=cost)
    return nodes, cost, step


_LABEL = "s long, profile string, node long, cost double, entry long, tail long, cell string"


def _through_cell(labels: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """What the sources' labels in a cell come to at the ends of its outgoing edges, with the label's node and the edge's first node."""
    names = ["s", "profile", "node", "cost", "entry", "tail", "cell"]
    out = edges[edges["to_cell"].notna()]
    if labels.empty or out.empty:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in names})
    nodes, cost, _ = _inside(edges, labels["node"].to_numpy())
    sources, row = np.unique(labels["s"].to_numpy(), return_inverse=True)
    entries, column = np.unique(labels["node"].to_numpy(), return_inverse=True)
    known = np.full((len(sources), len(entries)), np.inf)
    np.minimum.at(known, (row, column), labels["cost"].to_numpy())
    tails = np.searchsorted(nodes, out["a"])
    best, via = np.full((len(sources), len(out)), np.inf), np.zeros((len(sources), len(out)), np.int64)
    for e, place in enumerate(np.searchsorted(nodes, entries)):
        now = known[:, e, None] + (cost[place, tails] + out["w"].to_numpy())[None, :]
        less = now < best
        best[less], via[less] = now[less], e
    i, j = np.nonzero(np.isfinite(best))
    to, tail, cell = out["b"].to_numpy(), out["a"].to_numpy(), out["to_cell"].to_numpy()
    return pd.DataFrame({"s": sources[i], "profile": edges["profile"].iloc[0], "node": to[j], "cost": np.round(best[i, j], 6), "entry": entries[via[i, j]], "tail": tail[j], "cell": cell[j]})


def _ways_inside(wanted: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes from ``entry`` to ``tail`` inside a cell, in order."""
    rows = []
    if not wanted.empty:
        nodes, _, step = _inside(edges, np.concatenate([wanted["entry"].to_numpy(), wanted["tail"].to_numpy()]), hops=True)
        for cell, profile, entry, tail in wanted[["cell", "profile", "entry", "tail"]].itertuples(index=False):
            now, goal, pos = np.searchsorted(nodes, entry), np.searchsorted(nodes, tail), 0
            rows.append((cell, profile, entry, tail, pos, entry))
            while now != goal:
                now, pos = step[now, goal], pos + 1
                rows.append((cell, profile, entry, tail, pos, nodes[now]))
    return pd.DataFrame(rows, columns=["cell", "profile", "entry", "tail", "pos", "node"])


def shortest_paths(pairs: DataFrame, costs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Least-cost paths for distinct ``s, g`` in every profile: ``s, g, profile, pos, node, cost`` (cost of the whole path).

    The graph is contracted to its crossings and the pairs' ends, and these are dealt into cells of the map (``nodes`` has the places).
    A round takes all new labels of a cell through it at once and gives what they come to in the neighbouring cells, so rounds grow
    with the cells that a path crosses, not with its nodes; labels dearer than a source's dearest goal, once all are reached, go no
    further. A task has one cell and at most about a thousand sources. The ways back are put together by doubling, then the nodes
    inside cells and chains are put in. Ids are numbers.
    """
    goals = staged(pairs.select("s", "g").distinct(), "goals")
    profiles = costs.select("profile").distinct()
    supers, inner = contracted(costs, goals.select(F.explode(F.array("s", "g")).alias("node")).distinct())
    crossings = supers.select(F.explode(F.array("a", "b")).alias("node")).unionByName(goals.select(F.explode(F.array("s", "g")).alias("node"))).distinct()
    cells = staged(search_cells(crossings, nodes), "cells")
    of = lambda c, name: cells.select(F.col("node").alias(c), F.col("cell").alias(name))
    edges = supers.join(of("a", "cell"), "a").join(of("b", "to_cell"), "b").select("cell", "profile", "a", "b", F.col("cost").alias("w"), F.when(F.col("to_cell") != F.col("cell"), F.col("to_cell")).alias("to_cell"))
    # a goal is reached by an edge out of its cell to nowhere
    arrive = goals.select(F.col("g").alias("a")).distinct().join(of("a", "cell"), "a").join(profiles, F.lit(True)).select("cell", "profile", "a", F.col("a").alias("b"), F.lit(0.0).alias("w"), F.lit("").alias("to_cell"))
    edges = staged(edges.unionByName(arrive), "edges")
    of_source = goals.groupBy("s").agg(F.count("*").alias("goals"))
    buckets = -(-of_source.count() // SOURCES) or 1
    group, keys = ["cell", "profile", "bucket"], ["s", "profile", "node", "cell"]
    none = F.lit(None).cast("long")
    front = of_source.select("s").join(of("s", "cell"), "s").join(profiles, F.lit(True)).select("s", "profile", F.col("s").alias("node"), F.lit(0.0).alias("cost"), none.alias("entry"), none.alias("tail"), "cell")
    known = front = staged(front, "front")
    while True:
        reached = known.where("cell = ''").groupBy("s", "profile", "node").agg(F.min("cost").alias("cost")).groupBy("s", "profile").agg(F.count("*").alias("n"), F.max("cost").alias("limit"))
        limit = reached.join(of_source, "s").where("n = goals").select("s", "profile", "limit")
        open_ = front.where("cell <> ''").join(limit, ["s", "profile"], "left").where("limit is null or cost <= limit").drop("limit").withColumn("bucket", F.pmod(F.hash("s"), F.lit(buckets)))
        met = edges.join(open_.select(*[F.col(c).alias(c) for c in group]).distinct(), ["cell", "profile"])
        found = open_.groupBy(group).cogroup(met.groupBy(group)).applyInPandas(_through_cell, _LABEL)
        asked = goals.select("s", F.col("g").alias("node"), F.lit("").alias("cell"))
        found = found.where("cell <> ''").unionByName(found.where("cell = ''").join(asked, ["s", "node", "cell"], "left_semi").select(found.columns))
        found = found.groupBy(keys).agg(F.min(F.struct("cost", "entry", "tail")).alias("m")).select(*keys, "m.*")
        no_better = known.select(*[F.col(c).alias("k_" + c) for c in (*keys, "cost")])
        better = found.join(no_better, [*[F.col(c) == F.col("k_" + c) for c in keys], F.col("k_cost") <= F.col("cost")], "left_anti").select(front.columns)
        rows = Observation()
        front = staged(better.observe(rows, F.count("*").alias("n")), "front")
        if not rows.get["n"]:
            break
        known = known.unionByName(front)
    known = staged(known.groupBy(keys).agg(F.min(F.struct("cost", "entry", "tail")).alias("m")).select(*keys, "m.*"), "known")
    ends = staged(known.where("cell = ''").select("s", F.col("node").alias("g"), "profile", "cost", "entry"), "ends")
    labels = known.where("cell <> ''").select("s", "profile", "node", "entry", "tail")
    back = ancestors(ends.select("s", "g", "profile", F.col("entry").alias("node")), labels, ["s", "profile"], "node", "entry")
    # pieces of the way inside one cell each: up to the edge to the next cell, the last one up to the goal
    pieces = back.join(labels, ["s", "profile", "node"]).where("tail is not null").select("s", "g", "profile", (-F.col("back")).alias("part"), "entry", "tail")
    pieces = pieces.unionByName(ends.select("s", "g", "profile", F.lit(1).cast("long").alias("part"), "entry", F.col("g").alias("tail"))).join(of("entry", "cell"), "entry")
    pieces = staged(pieces, "pieces")
    wanted = pieces.select("cell", "profile", "entry", "tail").distinct()
    there = edges.where("to_cell is null or to_cell <> ''").join(wanted.select("cell", "profile").distinct(), ["cell", "profile"], "left_semi")
    inside = wanted.groupBy("cell", "profile").cogroup(there.groupBy("cell", "profile")).applyInPandas(_ways_inside, "cell string, profile string, entry long, tail long, pos long, node long")
    way = Window.partitionBy("s", "g", "profile").orderBy("part", "pos")
    crossed = pieces.join(inside, ["cell", "profile", "entry", "tail"]).select("s", "g", "profile", "part", "pos", "node", F.lead("node").over(way).alias("next"), F.row_number().over(way).alias("place"))
    crossed = staged(crossed, "ways")
    passed = crossed.where("next is not null").join(supers.select("profile", F.col("a").alias("node"), F.col("b").alias("next"), "chain"), ["profile", "node", "next"]).drop("node", "pos").join(inner, "chain")
    rows = passed.select("s", "g", "profile", "place", "pos", "node").unionByName(crossed.where("next is null").select("s", "g", "profile", "place", F.lit(0).cast("long").alias("pos"), "node"))
    order = Window.partitionBy("s", "g", "profile").orderBy("place", "pos")
    rows = rows.select("s", "g", "profile", (F.row_number().over(order) - 1).alias("pos"), "node")
    return staged(rows.join(ends.drop("entry"), ["s", "g", "profile"]), "paths")


def path_edges(paths: DataFrame, costs: DataFrame) -> DataFrame:
    """One row per edge of each path: ``s, g, profile, pos, length, road_class``."""
    step = paths.withColumn("b", F.lead("node").over(Window.partitionBy("s", "g", "profile").orderBy("pos"))).where("b is not null")
    return step.join(costs.select("profile", F.col("a").alias("node"), "b", "length", "road_class"), ["profile", "node", "b"]).select("s", "g", "profile", "pos", "length", "road_class")


def scored_routes(pairs: DataFrame, paths: DataFrame, costs: DataFrame, requests: DataFrame) -> DataFrame:
    """The best route of each request with its scores: lowest score, then earliest pair and profile."""
    e = path_edges(paths, costs)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0.0))
    syn = F.col("road_class") == "synthetic_bridge"
    sums = e.groupBy("s", "g", "profile").agg(F.sum("length").alias("length"), part((F.col("road_class") != "white") & ~syn).alias("off"), part(syn).alias("syn"), part(syn & (F.col("length") > 180)).alias("far"))
    whole = paths.where("pos = 0").select("s", "g", "profile", "cost").join(sums, ["s", "g", "profile"], "left").na.fill(0.0, ["length", "off", "syn", "far"])
    ranks = costs.select("profile", "profile_rank").distinct()
    r = pairs.join(whole, ["s", "g"]).join(F.broadcast(ranks), "profile").join(requests, "request_id")
    direct = geo.distance(F.col("start_x"), F.col("start_y"), F.col("target_x"), F.col("target_y"))
    physical = F.col("s_snap") + F.col("length") + F.col("g_snap")
    soft = F.greatest(direct * 1.35, direct + 950)
    detour = F.when(direct <= 1, 0.0).otherwise(F.greatest(physical - soft, F.lit(0.0)) * 8)
    score = 1.20 * F.col("s_snap") + F.col("cost") + 1.05 * F.col("g_snap") + detour + 0.08 * F.col("off") + 0.35 * F.col("syn") + 2.75 * F.col("far")
    r = r.withColumns({"route_score": score, "direct": direct, "physical": physical})
    best = r.groupBy("request_id").agg(F.min_by(F.struct("s", "g", "profile", "pair_rank", "length", "physical", "direct", "route_score"), F.struct("route_score", "pair_rank", "profile_rank")).alias("m")).select("request_id", "m.*")
    return best.withColumns({"metres": geo.half_up(geo.metres(F.col("physical"))), "detour_ratio": F.round(F.col("physical") / F.greatest(F.lit(1.0), F.col("direct")), 3)})


def road_profile(routes: DataFrame, paths: DataFrame, costs: DataFrame) -> DataFrame:
    """Edges and length of each class on each chosen route."""
    e = path_edges(paths, costs).join(routes.select("request_id", "s", "g", "profile"), ["s", "g", "profile"])
    return e.groupBy("request_id", "road_class").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 2).alias("length"))


def profile_texts(routes: DataFrame, profile: DataFrame) -> DataFrame:
    """``request_id, text``: the classes of :func:`road_profile` as ``class:edges`` in the order of classes, ``unknown`` for a route without edges."""
    each = F.struct(geo.road_rank(F.col("road_class")).alias("rank"), F.concat("road_class", F.lit(":"), F.col("edges").cast("string")).alias("part"))
    named = profile.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda p: p["part"]), ", ").alias("text"))
    return routes.select("request_id").join(named, "request_id", "left").select("request_id", F.coalesce("text", F.lit("unknown")).alias("text"))


def direct_routes(requests: DataFrame) -> DataFrame:
    """``request_id, distance_px, metres`` and the two points of the straight way, as far as places are known."""
    px = geo.distance(F.col("start_x"), F.col("start_y"), F.col("target_x"), F.col("target_y"))
    point = lambda end: F.struct(F.round(f"{end}_x", 3).alias("x"), F.round(f"{end}_y", 3).alias("y"))
    known = requests.where("start_x is not null and start_y is not null")
    return known.select("request_id", F.round(px, 2).alias("distance_px"), F.bround(geo.metres(px), 0).cast("long").alias("metres"), F.array(point("start"), point("target")).alias("points"))


def route_metrics(routes: DataFrame, paths: DataFrame, lines: DataFrame) -> DataFrame:
    """``request_id, distance_px, metres, detour_ratio, path_nodes, line_points``; ``lines`` are simplified."""
    p = routes.select("request_id", "s", "g", "profile").join(paths, ["s", "g", "profile"]).groupBy("request_id").agg(F.count("*").alias("path_nodes"))
    out = routes.join(p, "request_id").join(lines.groupBy("request_id").agg(F.count("*").alias("line_points")), "request_id")
    return out.select("request_id", F.round("physical", 2).alias("distance_px"), F.bround(geo.metres(F.col("physical")), 0).cast("long").alias("metres"), "detour_ratio", "path_nodes", "line_points")


def outcomes(requests: DataFrame, start: DataFrame, goal: DataFrame, pairs: DataFrame, routes: DataFrame, has_graph: bool = True) -> DataFrame:
    """Why a request has a route or not; without a graph (or one without nodes) the straight way is all there is."""
    if not has_graph:
        return requests.select("request_id", F.when(F.col("start_x").isNull(), "waiting_for_telemetry").otherwise("direct").alias("outcome"))
    has = lambda t, name: t.select("request_id").distinct().withColumn(name, F.lit(True))
    r = requests.select("request_id", "start_x")
    for t, name in ((start, "a"), (goal, "b"), (pairs, "c"), (routes, "d")):
        r = r.join(has(t, name), "request_id", "left")
    no = lambda c: F.col(c).isNull()
    return r.select("request_id", F.when(no("start_x"), "waiting_for_telemetry").when(no("a") | no("b"), "graph_snap_failed").when(no("c"), "graph_disconnected").when(no("d"), "graph_no_path").otherwise("graph").alias("outcome"))


def polylines(routes: DataFrame, paths: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, pos, x, y``: start, path nodes, and the target if the last node is more than a pixel away."""
    p = routes.select("request_id", "s", "g", "profile").join(paths, ["s", "g", "profile"]).join(nodes.select(F.col("node_id").alias("node"), "map_x", "map_y"), "node")
    inner = p.select("request_id", (F.col("pos") + 1).alias("pos"), F.col("map_x").alias("x"), F.col("map_y").alias("y"))
    r = requests.join(routes.select("request_id"), "request_id", "left_semi")
    first = r.select("request_id", F.lit(0).alias("pos"), F.col("start_x").alias("x"), F.col("start_y").alias("y"))
    end = inner.groupBy("request_id").agg(F.max_by(F.struct("pos", "x", "y"), "pos").alias("e"))
    last = r.join(end, "request_id").where(geo.distance(F.col("target_x"), F.col("target_y"), F.col("e.x"), F.col("e.y")) > 1)
    return first.unionByName(inner).unionByName(last.select("request_id", (F.col("e.pos") + 1).alias("pos"), F.col("target_x").alias("x"), F.col("target_y").alias("y")))


def douglas_peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Kept positions of one line."""
    keep, stack = {0, len(x) - 1}, [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        long = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / long, 0, 1) if long else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def simplified(lines: DataFrame, tolerance: float = 7.0, most: int = 2600) -> DataFrame:
    """Each route's line without points that lie within the tolerance; lines that stay too long keep every n-th point."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        keep = douglas_peucker(f["x"].to_numpy(), f["y"].to_numpy(), tolerance)
        if len(keep) > most:
            keep = np.union1d(keep[:: -(-len(keep) // most)], keep[-1:])
        return f.iloc[keep]

    return lines.groupBy("request_id").applyInPandas(one, lines.schema)
