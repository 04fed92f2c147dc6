"""Progress of tracks along routes: nearest segment, remaining way, arrival and rerouting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.functions.storage import staged

OFF_ROUTE, ARRIVE_M, ARRIVE_SLOW_M, ARRIVE_MS = 170.0, 30.0, 62.0, 1100


def _line() -> WindowSpec:
    return Window.partitionBy("route_id").orderBy("pos")


def _so_far() -> WindowSpec:
    return Window.partitionBy("player_id").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)


def segments(lines: DataFrame) -> DataFrame:
    """``route_id, pos, ax, ay, bx, by, length, before, total``: segments with the length before them and the line's."""
    s = lines.withColumns({"bx": F.lead("x").over(_line()), "by": F.lead("y").over(_line())}).where("bx is not null")
    s = s.withColumn("length", geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")))
    before = F.coalesce(F.sum("length").over(_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("length").over(Window.partitionBy("route_id"))
    return s.select("route_id", "pos", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", "length", before.alias("before"), total.alias("total"))


#: Segments of a route up to which each of its rows meets all of them, and sides of cells (pixels) by which rows meet longer routes.
FEW, CELLS = 16, (256.0, 1024.0, 4096.0)


def _nearest(met: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest of the segments that each row has met; nulls for a row that met none."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("map_x") - F.col("ax")) * dx + (F.col("map_y") - F.col("ay")) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    j = met.withColumn("t", t).withColumns({"px": F.col("ax") + F.col("t") * dx, "py": F.col("ay") + F.col("t") * dy})
    j = j.withColumn("off", geo.distance(F.col("map_x"), F.col("map_y"), F.col("px"), F.col("py")))
    j = j.withColumn("remaining", F.col("total") - F.col("before") - F.col("t") * F.col("length"))
    best = j.groupBy(*keys).agg(F.min_by(F.struct("off", "px", "py", "pos", "t", "remaining"), F.when(F.col("off").isNotNull(), F.struct("off", "pos"))).alias("m"))
    return best.select(*keys, "m.*")


def _in_cells(segments_: DataFrame, side: float) -> DataFrame:
    """Segments with the cells (``cx, cy``) that have a place within ``side`` of them: those around each piece no longer than a cell."""
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / side).cast("int"))
    s = segments_.withColumn("__n", count).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("__n")

    def span(a: str, b: str):
        one, two = at(a, b, F.col("__i")), at(a, b, F.col("__i") + 1)
        return F.explode(F.sequence(geo.cell(F.least(one, two) - side, side), geo.cell(F.greatest(one, two) + side, side)))

    return s.withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "by")).drop("__n", "__i").distinct()


def nearest_segment(track: DataFrame, segments_: DataFrame, few: int = FEW) -> DataFrame:
    """For each row of a track (``player_id, seq, ts_ms, route_id, map_x, map_y``) the first nearest segment of its route.

    Gives off (pixels), the projected point, the segment's pos, t, and the remaining pixels along the line. Rows of a route of up to
    ``few`` segments meet all of them. Those of longer routes meet the segments near their cell of the map; a row farther from them
    than a cell's side looks again with larger cells, and the rest, thousands of pixels off their route, meet all. Rows without a
    place have null results there.
    """
    keys = track.columns
    counts = segments_.groupBy("route_id").agg((F.count("*") <= few).alias("short"))
    marked = staged(segments_.join(counts, "route_id"), "segments")
    out = _nearest(track.join(marked.where("short").drop("short"), "route_id"), keys)
    long = marked.where("not short").drop("short")
    if not long.take(1):
        return out
    left = track.join(counts.where("not short").select("route_id"), "route_id", "left_semi").select(keys)
    for side in CELLS:
        cells = {"cx": geo.cell(F.col("map_x"), side), "cy": geo.cell(F.col("map_y"), side)}
        tried = staged(_nearest(left.withColumns(cells).join(_in_cells(long, side), ["route_id", "cx", "cy"], "left"), keys), "nearest")
        out = out.unionByName(tried.where(F.col("off") <= side))
        left = tried.where((F.col("off") > side) | F.col("off").isNull()).select(keys)
    return out.unionByName(_nearest(left.join(long, "route_id"), keys))


def vertices(lines: DataFrame) -> DataFrame:
    """``route_id, pos, x, y`` with the next vertex (``nx, ny, step``), the length before a vertex and after it (``tail``), and those that follow."""
    v = lines.withColumns({"nx": F.lead("x").over(_line()), "ny": F.lead("y").over(_line())})
    v = v.withColumn("step", F.coalesce(geo.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")), F.lit(0.0)))
    rest = _line().rowsBetween(0, Window.unboundedFollowing)
    so_far = F.coalesce(F.sum("step").over(_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return v.withColumns({"tail": F.sum("step").over(rest), "follow": F.count("*").over(rest) - 1, "before": so_far})


def remaining_route(rows: DataFrame, vertices_: DataFrame, near: float = 160.0, close: float = 3.0, past: float = 0.72) -> DataFrame:
    """``points`` and ``length`` (pixels, from the car) of what is left of a route, for rows of :func:`nearest_segment` with their route_id.

    On the route (``off`` below ``near``) it starts with the projected point, then the next vertex, or the one after that behind
    ``past`` of a segment; else with the second vertex. A first point within ``close`` of the car is left out.
    """
    on = F.col("off") < near
    k = F.when(on, F.col("pos") + F.when(F.col("t") > past, 2).otherwise(1)).otherwise(1)
    v = vertices_.select(F.col("route_id"), F.col("pos").alias("k"), F.col("x").alias("vx"), F.col("y").alias("vy"), "nx", "ny", "step", "tail", "follow")
    j = rows.withColumn("k", k).join(v, ["route_id", "k"], "left")
    to = lambda x, y: geo.distance(F.col("map_x"), F.col("map_y"), F.col(x), F.col(y))
    there, projected = F.col("vx").isNotNull(), to("px", "py") >= close
    onwards = F.coalesce(geo.distance(F.col("px"), F.col("py"), F.col("vx"), F.col("vy")) + F.col("tail"), F.lit(0.0))
    whole, behind = F.coalesce(to("vx", "vy") + F.col("tail"), F.lit(0.0)), F.coalesce(to("nx", "ny") + F.col("tail") - F.col("step"), F.lit(0.0))
    left = F.when(there, F.col("follow") + 1).otherwise(0)
    skip = ~on & there & (to("vx", "vy") < close)
    length = F.when(on & projected, to("px", "py") + onwards).when(skip, behind).otherwise(whole)
    points = F.when(on & projected, left + 1).when(skip, left - 1).otherwise(left)
    return j.select(*rows.columns, points.cast("long").alias("points"), length.alias("length"))


#: Length of the pieces of a route by which places along it meet its segments.
PIECE = 256.0
LOOK_M, LOOK_S = 170.0, 4.0


def along_route(wanted: DataFrame, vertices_: DataFrame) -> DataFrame:
    """``wanted`` (with route_id, ``at``: pixels from the route's start) with the place ``x, y``, null for a route without length.

    Segments without length are passed over; past the end it is the last vertex. An equi-join on the route and a piece of 256 pixels
    of its length, so that no task holds a whole route with all the places asked for on it.
    """
    s = vertices_.withColumn("until", F.lead("before").over(_line())).where("step > 0")
    own = {"x": "ax", "y": "ay", "nx": "bx", "ny": "by", "step": "step", "before": "from", "until": "until"}
    s = s.select(F.col("route_id").alias("__route"), *[F.col(c).alias("__" + n) for c, n in own.items()], (F.col("tail") - F.col("step") == 0).alias("__end"))
    s = s.withColumn("__part", F.explode(F.sequence(F.floor(F.col("__from") / PIECE), F.floor(F.col("__until") / PIECE))))
    totals = vertices_.groupBy("route_id").agg(F.max(F.col("before") + F.col("step")).alias("__total"))
    w = wanted.join(totals, "route_id").withColumn("__at", F.greatest(F.lit(0.0), F.least("at", "__total"))).withColumn("__piece", F.floor(F.col("__at") / PIECE))
    inside = (F.col("__from") <= F.col("__at")) & ((F.col("__at") < F.col("__until")) | (F.col("__end") & (F.col("__at") == F.col("__until"))))
    met = w.join(s, (F.col("route_id") == F.col("__route")) & (F.col("__piece") == F.col("__part")) & inside, "left")
    place = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("__at") - F.col("__from")) / F.col("__step")
    return met.select(*wanted.columns, place("__ax", "__bx").alias("x"), place("__ay", "__by").alias("y"))


def look_ahead(rows: DataFrame, vertices_: DataFrame, near: float = 160.0, close: float = 3.0, past: float = 0.72) -> DataFrame:
    """``look_px, look_x, look_y``: the place ahead on the way from the car along what is left of its route (:func:`remaining_route`).

    It is as far as the car comes in 4 s at its ``speed_kmh``, 170 m at least; past the end it is the last point; null if nothing is left.
    """
    on = F.col("off") < near
    k = F.when(on, F.col("pos") + F.when(F.col("t") > past, 2).otherwise(1)).otherwise(1)
    v = vertices_.select("route_id", F.col("pos").alias("k"), F.col("x").alias("vx"), F.col("y").alias("vy"), "nx", "ny", "step", "before", "follow")
    j = rows.withColumn("k", k).join(v, ["route_id", "k"], "left")
    to = lambda x, y: geo.distance(F.col("map_x"), F.col("map_y"), F.col(x), F.col(y))
    projected = on & (to("px", "py") >= close)
    skip = ~on & (to("vx", "vy") < close)
    onwards = lambda x, y: F.when(skip, F.col(y)).otherwise(F.col(x))
    j = j.withColumns({"look_px": geo.pixels(F.greatest(F.lit(LOOK_M), F.coalesce("speed_kmh", F.lit(0.0)) / 3.6 * LOOK_S)), "wx": onwards("vx", "nx"), "wy": onwards("vy", "ny"), "begin": F.col("before") + F.when(skip, F.col("step")).otherwise(0.0)})
    leg = F.when(projected, to("px", "py")).otherwise(0.0)
    j = j.withColumn("leg", leg).withColumn("rest", F.when(projected, geo.distance(F.col("px"), F.col("py"), F.col("wx"), F.col("wy"))).otherwise(to("wx", "wy")))
    j = j.withColumn("at", F.col("begin") + F.col("look_px") - F.col("leg") - F.col("rest"))
    found = along_route(j, vertices_)
    fx, fy = F.when(projected, F.col("px")).otherwise(F.col("map_x")), F.when(projected, F.col("py")).otherwise(F.col("map_y"))

    def place(car: str, first: Column, second: str, on_route: str) -> Column:
        one = F.col(car) + (first - F.col(car)) * F.col("look_px") / F.col("leg")
        two = first + (F.col(second) - first) * (F.col("look_px") - F.col("leg")) / F.col("rest")
        last = F.coalesce(F.col(on_route), F.col(second))
        return F.when(projected & (F.col("look_px") <= F.col("leg")), one).when(F.col("wx").isNull(), F.when(projected, first)).when((F.col("at") <= F.col("begin")) & (F.col("rest") > 0), two).otherwise(last)

    return found.select(*rows.columns, "look_px", place("map_x", fx, "wx", "x").alias("look_x"), place("map_y", fy, "wy", "y").alias("look_y"))


def to_target(rows: DataFrame, vertices_: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` with ``px``, the pixels to the target: the least of the straight way and what is left of the route, if anything is.

    ``targets`` has route_id, target_x, target_y.
    """
    left = remaining_route(rows, vertices_).join(targets, "route_id")
    direct = geo.distance(F.col("map_x"), F.col("map_y"), F.col("target_x"), F.col("target_y"))
    return left.select(*[c for c in rows.columns if c != "px"], F.least(direct, F.when(F.col("points") >= 1, F.col("length"))).alias("px"))


def point_at(wanted: DataFrame, segments_: DataFrame) -> DataFrame:
    """The point ``want`` pixels along a route, for rows ``route_id, want``; past the end the last point."""
    j = wanted.join(segments_.where("length > 0"), "route_id").where((F.col("before") <= F.col("want")) | (F.col("before") == 0))
    last = j.groupBy(*wanted.columns).agg(F.max_by(F.struct("ax", "ay", "bx", "by", "length", "before"), F.struct("before", "pos")).alias("m"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("want") - F.col("m.before")) / F.col("m.length")))
    return last.select(*wanted.columns, (F.col("m.ax") + t * (F.col("m.bx") - F.col("m.ax"))).alias("x"), (F.col("m.ay") + t * (F.col("m.by") - F.col("m.ay"))).alias("y"))


def off_route_episodes(rows: DataFrame, limit: float = OFF_ROUTE) -> DataFrame:
    """Runs of rows with ``off`` above the limit: start, end, duration, largest off."""
    on = (F.col("off") <= limit).cast("long")
    r = rows.withColumn("episode", F.sum(on).over(_so_far())).where(F.col("off") > limit)
    return r.groupBy("player_id", "episode").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"), F.max("off").alias("max_off"))


def arrival_marks(rows: DataFrame) -> DataFrame:
    """Rows with ``near`` and ``clear`` of the target, from ``px`` (pixels to the target) and ``speed_kmh``."""
    limit = F.when(F.col("speed_kmh") <= 8, ARRIVE_SLOW_M).otherwise(ARRIVE_M) * geo.PIXELS_PER_METRE
    return rows.withColumns({"near": F.col("px") <= limit, "clear": F.col("px") > 1.35 * limit})


def arrivals(rows: DataFrame) -> DataFrame:
    """The first arrival of each player from ``px`` (pixels to the target) and ``speed_kmh``."""
    r = arrival_marks(rows)
    r = r.withColumn("run", F.sum(F.col("clear").cast("long")).over(_so_far()))
    timer = F.min(F.when(F.col("near"), F.col("ts_ms"))).over(Window.partitionBy("player_id", "run").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("timer", timer).where(F.col("near") & (F.col("ts_ms") - F.col("timer") >= ARRIVE_MS))
    return r.groupBy("player_id").agg(F.min("ts_ms").alias("arrived_ms"))


#: What a player's reroute decisions remember: time of the last request, start of the time off the route, place of the last request.
REROUTE_STATE = "last long, since long, anchor_x double, anchor_y double"
NO_REROUTE = (None, None, None, None)


def reroute_step(state: tuple, t: int, off: float, goal: float, x: float, y: float) -> tuple[tuple, str | None]:
    """The state after a row, and the reason of a request that the row makes."""
    last, since, ax, ay = state
    if ax is None:
        ax, ay = x, y
    if pd.isna(off):
        if not goal < 35 and (last is None or t - last > 2800):
            return (t, None, x, y), "no_route"
        return (last, since, ax, ay), None
    since = None if off <= OFF_ROUTE else t if since is None else since
    if goal < 35:
        return (last, since, ax, ay), None
    wait, gone = float("inf") if last is None else t - last, 0 if since is None else t - since
    far = since is not None and wait >= 14000 and ((off > 650 and gone > 3500) or (off > 360 and gone > 9000) or gone > 22000)
    moved = since is None and wait > 16000 and (x - ax) ** 2 + (y - ay) ** 2 > 760**2
    if far or moved:
        return (t, since, x, y), "off_route" if far else "moved"
    return (last, since, ax, ay), None


def reroutes(rows: DataFrame) -> DataFrame:
    """Reroute decisions from ``off, to_target, map_x, map_y`` (V7): a fold over the rows of each player, with its reason.

    A null ``off`` stands for no usable route, which asks again after 2.8 s. Rows are read in order, one Arrow batch after another, so a
    player's track is never held as a whole.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, state = None, NO_REROUTE
        for f in frames:
            out = []
            for p, *row in zip(f["player_id"], f["ts_ms"], f["off"], f["to_target"], f["map_x"], f["map_y"]):
                if p != player:
                    player, state = p, NO_REROUTE
                state, reason = reroute_step(state, *row)
                if reason:
                    out.append((p, row[0], reason))
            yield pd.DataFrame(out, columns=["player_id", "ts_ms", "reason"])

    order = rows.select("player_id", "ts_ms", "off", "to_target", "map_x", "map_y").repartition("player_id").sortWithinPartitions("player_id", "ts_ms")
    return order.mapInPandas(fold, "player_id long, ts_ms long, reason string")


def suspicious(pairs: DataFrame) -> DataFrame:
    """``rejected`` for a new route (``new_length, remaining, off, off_ms, forced``) that is much longer without need."""
    longer = F.col("new_length") > F.greatest(F.col("remaining") * 1.25, F.col("remaining") + 350)
    return pairs.withColumn("rejected", ~F.col("forced") & longer & (F.col("off") < 520) & (F.col("off_ms") < 32000))
