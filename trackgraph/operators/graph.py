"""Repair of road graphs: normalised edges, components, stitches and bridges as spanning forests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.functions.storage import staged
from trackgraph.operators.components import close_components

MULTIPLIERS = geo.PROFILES["asphalt_practical"]


def multiplier(kind: str = "road_class", table: dict[str, float] = MULTIPLIERS):
    out = F
    for name, m in table.items():
        out = out.when(F.col(kind) == name, F.lit(float(m)))
    return out.otherwise(F.lit(float(table["unknown"])))


def normalised_edges(edges: DataFrame, nodes: DataFrame, in_order: bool = True) -> DataFrame:
    """Edges with both ends known, canonical ends, length and cost filled in, one for each pair.

    ``edges``: a, b, length, cost, road_class (nullable), seq (input order). A class that is not known is the less preferred one of the
    ends; a stored cost holds if the length is stored too or the class is still unknown, else the length is weighted by the class. Of
    several edges of a pair see :func:`one_for_each_pair`.
    """
    e = resolved_edges(edges, nodes).where("len > 0")
    best = one_for_each_pair(e, in_order)
    return best.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("m.len").alias("length"), F.col("m.weighted").alias("cost"), F.col("m.road_class").alias("road_class"))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, seq, len, weighted, road_class`` of edges between two different known nodes."""
    end = lambda s: nodes.select(F.col("node_id").alias(s), F.col("map_x").alias(s + "x"), F.col("map_y").alias(s + "y"), F.col("road_class").alias(s + "c"))
    e = edges.where("a <> b").withColumn("kind", geo.road_class(F.col("road_class"))).drop("road_class").join(end("a"), "a").join(end("b"), "b")
    own = F.when(geo.road_rank(F.col("bc")) > geo.road_rank(F.col("ac")), F.col("bc")).otherwise(F.col("ac"))
    e = e.withColumns({"road_class": F.when(F.col("kind") == "unknown", own).otherwise(F.col("kind")), "len": F.coalesce("length", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))})
    weighted = F.when(F.col("cost").isNotNull() & (F.col("length").isNotNull() | (F.col("road_class") == "unknown")), F.col("cost")).otherwise(F.col("len") * multiplier())
    return e.select("a", "b", "seq", "len", weighted.alias("weighted"), "road_class")


def one_for_each_pair(e: DataFrame, in_order: bool = True) -> DataFrame:
    """``u, v, m`` (len, weighted, road_class): the edge of each pair of nodes that is kept.

    In input order a later edge replaces the kept one if its cost is less than the kept one's length by the multiplier of its class,
    which need not be the kept one's stored cost. Only pairs with several edges are folded; the edges of one pair are held together
    there, as they are in a graph's file. Otherwise (not ``in_order``) the cheapest is kept, of these the first.
    """
    e = e.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
    edge = F.struct("len", "weighted", "road_class")
    if not in_order:
        return e.groupBy("u", "v").agg(F.min_by(edge, F.struct("weighted", "seq")).alias("m"))
    worth = F.struct("seq", "len", "weighted", "road_class", (F.col("len") * multiplier()).alias("worth"))
    several = e.groupBy("u", "v").agg(F.sort_array(F.collect_list(worth)).alias("all"))
    fold = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda kept, new: F.when(new["weighted"] < kept["worth"], new).otherwise(kept))
    kept = several.select("u", "v", F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(fold).alias("k"))
    return kept.select("u", "v", F.struct("k.len", "k.weighted", "k.road_class").alias("m"))


def grid_key(gx: Column, gy: Column, x: Column, y: Column, stride: float) -> Column:
    """``gx:gy`` where both are given, else the nearest grid lines of the place."""
    own = F.concat(gx.cast("long").cast("string"), F.lit(":"), gy.cast("long").cast("string"))
    return F.coalesce(own, F.concat(geo.grid_index(x, stride).cast("string"), F.lit(":"), geo.grid_index(y, stride).cast("string")))


def one_for_each_cell(nodes: DataFrame, stride: float = 10.0) -> DataFrame:
    """``grid_key, node_id``: the first node (in order of ids) of each grid key; ``nodes`` has gx and gy, which may be null."""
    key = grid_key(F.col("gx"), F.col("gy"), F.col("map_x"), F.col("map_y"), stride)
    return nodes.groupBy(key.alias("grid_key")).agg(F.min("node_id").alias("node_id"))


def from_detection(version: Column, detection: Column) -> Column:
    """Whether a graph's header tells that it was detected in images: "cv" in its version, or a detection entry that is not empty."""
    given = F.coalesce(F.regexp_replace(detection, r"\s", ""), F.lit("null"))
    return F.contains(F.lower(F.coalesce(version, F.lit(""))), F.lit("cv")) | ~given.isin("null", "{}", "")


def edit_strokes(edits: DataFrame) -> DataFrame:
    """``type, strokes``: strokes of edit files (``value``, JSON text) by type; a stroke without a type counts as unknown."""
    strokes = edits.select(F.explode(F.from_json("value", "strokes array<struct<type string>>").getField("strokes")).alias("s"))
    return strokes.groupBy(F.coalesce("s.type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("strokes"))


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component, size`` of every node; a component is named by its smallest node."""
    found = close_components(edges)
    named = nodes.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("node_id", "component", "size")


def class_counts(table: DataFrame, what: str) -> DataFrame:
    return table.groupBy("road_class").agg(F.count("*").alias("count")).withColumn("what", F.lit(what))


def status(nodes: DataFrame, edges: DataFrame, components: DataFrame, largest: int = 8) -> DataFrame:
    """One row: nodes, edges, components and the sizes of the largest components."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(largest).agg(F.sort_array(F.collect_list("n"), asc=False).alias("largest"))
    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")), F.lit(True)).join(sizes.agg(F.count("*").alias("components")), F.lit(True))
    return counts.join(top, F.lit(True))


def stitch_candidates(nodes: DataFrame, components: DataFrame, radius: int = 4, stride: float = 10.0) -> DataFrame:
    """A node and the first node of another cell at most ``radius`` cells away, in another component; with their order ``(a, step)``."""
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if (x > 0 or y > 0) and x * x + y * y <= radius * radius]
    n = nodes.join(components.select("node_id", "component"), "node_id").select("node_id", "gx", "gy", "map_x", "map_y", "component")
    left = n.select(F.col("node_id").alias("a"), F.col("component").alias("ca"), F.col("map_x").alias("ax"), F.col("map_y").alias("ay"), "gx", "gy", F.posexplode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("step", "s"))
    left = left.withColumns({"gx": F.col("gx") + F.col("s.x"), "gy": F.col("gy") + F.col("s.y")}).drop("s")
    first = n.groupBy("gx", "gy").agg(F.min(F.struct("node_id", "component", "map_x", "map_y")).alias("f"))
    right = first.select(F.col("f.node_id").alias("b"), F.col("f.component").alias("cb"), F.col("f.map_x").alias("bx"), F.col("f.map_y").alias("by"), "gx", "gy")
    d = left.join(right, ["gx", "gy"]).where("ca <> cb").withColumn("length", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return d.where((F.col("length") > 0) & (F.col("length") <= max(stride * radius + 0.01, 1.0))).select("a", "b", "ca", "cb", "length", F.struct(F.col("a").cast("double").alias("x"), F.col("step").cast("double").alias("y"), F.col("b").alias("z")).alias("order"))


def bridge_candidates(nodes: DataFrame, components: DataFrame, radius: float = 320.0) -> DataFrame:
    """The best pair of white or orange nodes for each pair of components of 2 nodes or more within ``radius``."""
    size = max(80.0, radius)
    n = nodes.where(F.col("road_class").isin("white", "orange")).join(components.where("size >= 2"), "node_id")
    n = n.select("node_id", "component", "road_class", "map_x", "map_y", geo.cell(F.col("map_x"), size).alias("cx"), geo.cell(F.col("map_y"), size).alias("cy"))
    ring = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    left = n.withColumn("dx", ring).withColumn("dy", ring).select(F.col("node_id").alias("a"), F.col("component").alias("ca"), F.col("road_class").alias("ka"), F.col("map_x").alias("ax"), F.col("map_y").alias("ay"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    right = n.select(F.col("node_id").alias("b"), F.col("component").alias("cb"), F.col("road_class").alias("kb"), F.col("map_x").alias("bx"), F.col("map_y").alias("by"), "cx", "cy")
    d = left.join(right, ["cx", "cy"]).where("ca < cb").withColumn("length", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    d = d.where((F.col("length") > 0) & (F.col("length") <= radius)).withColumn("score", F.round(F.col("length") + F.when(F.col("ka") != F.col("kb"), 35.0).otherwise(0.0), 6))
    best = d.groupBy("ca", "cb").agg(F.min(F.struct("score", "a", "b", "length")).alias("m"))
    return best.select("m.a", "m.b", "ca", "cb", "m.length", F.struct(F.col("m.score").alias("x"), F.col("m.a").cast("double").alias("y"), F.col("m.b").alias("z")).alias("order"))


def spanning_forest(candidates: DataFrame) -> DataFrame:
    """The candidates that a greedy pass in ``order`` accepts while they still join two components (``ca``, ``cb``)."""
    return merging_forest(candidates)[0]


def merging_forest(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`spanning_forest` and ``node, component``: what the components that it joins become.

    The forest under a total order is unique, so each component may take its least edge at once, round by round.
    """
    left = staged(candidates.withColumns({"u": F.col("ca"), "v": F.col("cb")}), "forest")
    chosen = None
    while True:
        ends = left.select(F.explode(F.array("u", "v")).alias("c"), "order", "a", "b", "ca", "cb", "length")
        pick = ends.groupBy("c").agg(F.min_by(F.struct("a", "b", "ca", "cb", "length", "order"), "order").alias("m")).select("m.*").distinct()
        chosen = staged(pick if chosen is None else chosen.unionByName(pick).distinct(), "forest")
        merged = close_components(chosen, "ca", "cb")
        name = lambda c, new: merged.select(F.col("node").alias(c), F.col("component").alias(new))
        rows = Observation()
        left = staged(left.drop("u", "v").join(name("ca", "u"), "ca").join(name("cb", "v"), "cb").where("u <> v").observe(rows, F.count("*").alias("n")), "forest")
        if not rows.get["n"]:
            return chosen.drop("order"), merged


def relabelled(components: DataFrame, merged: DataFrame) -> DataFrame:
    """Components after some of them were joined: ``merged`` has their new names."""
    now = components.drop("size").join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    now = now.select("node_id", F.coalesce("now", "component").alias("component"))
    return now.join(now.groupBy("component").agg(F.count("*").alias("size")), "component").select("node_id", "component", "size")


def synthetic(links: DataFrame) -> DataFrame:
    """Links as edges of class synthetic_bridge."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length", (F.col("length") * MULTIPLIERS["synthetic_bridge"]).alias("cost"), F.lit("synthetic_bridge").alias("road_class"))


# Radii of graphs that were detected in images and whose header names none.
DETECTED_RADII = (4, 320.0)


def radii(header: DataFrame) -> tuple[int, float]:
    """Stitch radius (cells) and bridge radius (pixels) of a graph's one-row header: its own, else those of detected graphs, else 0.

    Columns that the header lacks count as null; a radius of 0 counts as missing, and so does a header without a row.
    """
    given = lambda c: F.col(c) if c in header.columns else F.lit(None)
    own = lambda c, kind: F.nullif(given(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    cells, pixels = "runtime_stitch_radius_cells", "runtime_component_bridge_radius_px"
    row = header.select(own(cells, "int"), own(pixels, "double"), from_detection(given("version").cast("string"), given("detection").cast("string")).alias("detected")).first()
    missing = DETECTED_RADII if row and row["detected"] else (0, 0.0)
    return (row[cells] or missing[0], row[pixels] or missing[1]) if row else missing


@dataclass(frozen=True)
class Repair:
    """A graph with its synthetic links: ``edges`` has them, ``components`` are those with them."""

    nodes: DataFrame
    edges: DataFrame
    components: DataFrame
    stitches: DataFrame
    bridges: DataFrame
    radii: tuple[int, float]


def repaired(nodes: DataFrame, edges: DataFrame, header: DataFrame, stride: float = 10.0) -> Repair:
    """Stitches between components, then bridges between those that are left, as the header's radii allow.

    ``nodes`` has grid cells (gx, gy) besides its places; ``edges`` are normalised.
    """
    cells, reach = radii(header)
    components = staged(node_components(nodes, edges), "components")
    links: list[DataFrame] = []
    for radius, candidates in ((cells, lambda c: stitch_candidates(nodes, c, max(cells, 1), stride)), (reach, lambda c: bridge_candidates(nodes, c, reach))):
        found = candidates(components)
        if radius > 0:
            found, merged = merging_forest(found)
            edges = edges.unionByName(synthetic(found))
            components = staged(relabelled(components, merged), "components")
        links.append(found.drop("order") if radius > 0 else found.drop("order").limit(0))
    return Repair(nodes, edges, components, *links, (cells, reach))


def repair_status(raw: DataFrame, repair: Repair, largest: int = 8) -> DataFrame:
    """One row: counts of nodes, edges (each raw edge and link), raw edges, stitches, bridges and components, radii, largest components.

    ``raw`` are the edges of :func:`resolved_edges`, before those without a length go and one for each pair is kept.
    """
    count = lambda t, name: t.agg(F.count("*").alias(name))
    edges = raw.agg(F.count("*").alias("raw_edges"), F.count_if(F.col("len") > 0).alias("edges"))
    out = status(repair.nodes, repair.edges, repair.components, largest).drop("edges").join(edges, F.lit(True))
    out = out.join(count(repair.stitches, "stitches"), F.lit(True)).join(count(repair.bridges, "bridges"), F.lit(True))
    radii_ = [F.lit(repair.radii[0]).alias("stitch_radius_cells"), F.lit(repair.radii[1]).alias("bridge_radius_px")]
    return out.select("nodes", (F.col("edges") + F.col("stitches") + F.col("bridges")).alias("edges"), "raw_edges", "stitches", "bridges", *radii_, "components", "largest")
