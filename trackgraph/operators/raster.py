"""Road cells from coloured pixels, clean masks, grid nodes and neighbour edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgraph.functions import geo
from trackgraph.functions.storage import staged
from trackgraph.operators.components import close_components
from trackgraph.operators.network import pixel


def colour_masks(r: Column, g: Column, b: Column, alpha: Column) -> dict[str, Column]:
    """Light, orange and magenta road pixels, and white as light or magenta."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (alpha >= 35) & (top >= 188) & (top - low <= 48) & (low >= 145)
    orange = (r >= 185) & (g >= 75) & (g <= 175) & (b <= 115) & (r - b >= 85) & (r - g >= 8) & (alpha >= 35)
    magenta = (r >= 150) & (b >= 105) & (g <= 120) & (r - g >= 45) & (b - g >= 35) & (alpha >= 35)
    return {"light": light, "orange": orange, "magenta": magenta, "white": light | magenta}


def cell_ratios(pixels: DataFrame, stride: int = 10, least: float = 0.16) -> DataFrame:
    """Shares of road pixels by tile and cell; cells with too few go. A partial aggregation, so pixels are not shuffled."""
    m = colour_masks(F.col("r"), F.col("g"), F.col("b"), F.col("alpha"))
    share = lambda c: F.avg(c.cast("double"))
    rows = pixels.withColumns({"cell_x": F.floor(F.col("x") / stride), "cell_y": F.floor(F.col("y") / stride)})
    out = rows.groupBy("tile_x", "tile_y", "cell_x", "cell_y").agg(share(m["white"] | m["orange"]).alias("road_ratio"), share(m["white"]).alias("white_ratio"), share(m["orange"]).alias("orange_ratio"))
    return out.where(F.col("road_ratio") >= least)


def cell_class(white: Column, orange: Column, least: float = 0.16) -> Column:
    return F.when((white >= 0.13) & (white >= 0.55 * orange), "white").when(orange >= 0.28, "orange").when(orange >= least, "orange_dashed").otherwise("unknown")


def grid_nodes(cells: DataFrame, stride: int = 10, scale: float = 1.0) -> DataFrame:
    """Nodes of a common grid; a cell that several tiles cover keeps the first one's shares and the most preferred class."""
    kind = cell_class(F.col("white_ratio"), F.col("orange_ratio"))
    line = lambda t, c: F.bround((F.col(t) * geo.TILE_SIZE + F.col(c) * stride + stride / 2.0) / stride, 0).cast("long")
    rows = cells.withColumns({"road_class": kind, "gx": line("tile_x", "cell_x"), "gy": line("tile_y", "cell_y")}).where("road_class <> 'unknown'")
    first = F.struct("tile_y", "tile_x", "cell_y", "cell_x")
    out = rows.groupBy("gx", "gy").agg(
        F.min_by(F.struct("road_ratio", "white_ratio", "orange_ratio"), first).alias("r"), F.min(geo.road_rank(F.col("road_class"))).alias("rank"))
    name = F.element_at(F.array(*[F.lit(c) for c in geo.ROAD_CLASSES]), F.col("rank") + 1)
    return out.select("gx", "gy", (F.col("gx") * stride / scale).alias("map_x"), (F.col("gy") * stride / scale).alias("map_y"), name.alias("road_class"), "r.*")


def neighbour_edges(nodes: DataFrame, factors: dict[str, float], diagonal: bool = True) -> DataFrame:
    """Edges between grid neighbours: ``a, b`` (ids), length, class of the less preferred end, cost."""
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    left = nodes.select(F.col("node_id").alias("a"), "gx", "gy", F.col("map_x").alias("ax"), F.col("map_y").alias("ay"), F.col("road_class").alias("ac"))
    left = left.withColumn("s", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])))
    left = left.withColumns({"gx": F.col("gx") + F.col("s.x"), "gy": F.col("gy") + F.col("s.y")})
    right = nodes.select(F.col("node_id").alias("b"), "gx", "gy", F.col("map_x").alias("bx"), F.col("map_y").alias("by"), F.col("road_class").alias("bc"))
    met = left.join(right, ["gx", "gy"])
    kind = F.when(geo.road_rank(F.col("bc")) > geo.road_rank(F.col("ac")), F.col("bc")).otherwise(F.col("ac"))
    length = geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    factor = F.lit(None)
    for name, f in factors.items():
        factor = F.when(F.col("road_class") == name, F.lit(f)).otherwise(factor)
    met = met.withColumns({"road_class": kind, "exact": length})
    return met.select("a", "b", F.round("exact", 3).alias("length"), F.round(F.col("exact") * factor, 3).alias("cost"), "road_class")


#: Side of a block of pixels, and the pixels around it that closing and opening look at.
SIDE, HALO = 32, 4
_WIDE = SIDE + 2 * HALO
_FULL = (1 << _WIDE) - 1


def _block_rows(pixels: DataFrame) -> DataFrame:
    """``bx, by, rows`` of blocks of 32 x 32 pixels: each of their rows and the four above and below, as a number with a bit for each pixel.

    A pixel near a block's border is in the neighbouring blocks too. Bits are combined before the shuffle.
    """
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - HALO) / SIDE), F.floor((F.col(c) + HALO) / SIDE)))
    p = pixels.select("x", "y", near("x").alias("bx")).select("x", "y", "bx", near("y").alias("by"))
    place = lambda c, b: (F.col(c) - F.col(b) * SIDE + HALO).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(x - bx * {SIDE} + {HALO} as int))")
    rows = p.groupBy("bx", "by", place("y", "by").alias("row")).agg(F.bit_or(bit).alias("bits"))
    known = rows.groupBy("bx", "by").agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("m"))
    return known.select("bx", "by", F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("rows"))


def _frames(tile: int | None) -> Column:
    """For each row of a block the bits inside the image: the block's own tile, or everything."""
    if tile is None:
        return F.array_repeat(F.lit(_FULL).cast("long"), _WIDE)
    low = lambda b: F.greatest(F.floor(F.col(b) * SIDE / tile) * tile - F.col(b) * SIDE + HALO, F.lit(0))
    high = lambda b: F.least((F.floor(F.col(b) * SIDE / tile) + 1) * tile - F.col(b) * SIDE + HALO, F.lit(_WIDE))
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), high("bx").cast("int")) - F.call_function("shiftleft", F.lit(1).cast("long"), low("bx").cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda i: F.when((i >= low("by")) & (i < high("by")), bits).otherwise(F.lit(0).cast("long")))


def _spread(df: DataFrame, bits: Column) -> DataFrame:
    """``df`` with ``w``: rows of ``bits`` and their neighbours to the left and right."""
    full = F.lit(_FULL).cast("long")
    return df.withColumn("w", F.transform(bits, lambda w: w.bitwiseOR(F.shiftleft(w, 1)).bitwiseOR(F.shiftright(w, 1)).bitwiseAND(full)))


def _around(i: Column) -> Column:
    at = lambda k: F.coalesce(F.get(F.col("w"), k), F.lit(0).cast("long"))
    return at(i).bitwiseOR(at(i - 1)).bitwiseOR(at(i + 1))


def _grown(blocks: DataFrame) -> DataFrame:
    """Every pixel of the image that has a set one among its 3 x 3."""
    return _spread(blocks, F.col("rows")).withColumn("rows", F.transform("frame", lambda f, i: _around(i).bitwiseAND(f)))


def _shrunk(blocks: DataFrame) -> DataFrame:
    """Every pixel of the image that has no unset one among its 3 x 3; there are none outside the image."""
    unset = F.zip_with("frame", "rows", lambda f, r: f.bitwiseAND(F.bitwise_not(r)))
    return _spread(blocks, unset).withColumn("rows", F.transform("frame", lambda f, i: F.bitwise_not(_around(i)).bitwiseAND(f)))


def smoothed_runs(pixels: DataFrame, tile: int | None = geo.TILE_SIZE) -> DataFrame:
    """``x0, x1, y``: runs of pixels (``x, y`` on the map) after closing and opening by 3 x 3, inside blocks of 32 pixels.

    ``tile``: the side of tiles that do not see each other, None for one image. Blocks meet their surroundings by one shuffle of bits.
    """
    framed = _block_rows(pixels).withColumn("frame", _frames(tile)).withColumn("rows", F.zip_with("rows", "frame", lambda r, f: r.bitwiseAND(f)))
    done = _grown(_shrunk(_shrunk(_grown(framed))))
    row = done.select("bx", "by", F.posexplode(F.slice("rows", HALO + 1, SIDE)).alias("i", "w"))
    row = row.select("bx", (F.col("by") * SIDE + F.col("i")).alias("y"), F.shiftright("w", HALO).bitwiseAND(F.lit((1 << SIDE) - 1).cast("long")).alias("w")).where("w <> 0")
    places = lambda bits: F.filter(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda b: F.call_function("shiftright", bits, b).bitwiseAND(F.lit(1).cast("long")) == 1)
    w = F.col("w")
    ends = F.arrays_zip(places(w.bitwiseAND(F.bitwise_not(F.shiftleft(w, 1)))).alias("a"), places(w.bitwiseAND(F.bitwise_not(F.shiftright(w, 1)))).alias("b"))
    runs = row.select("bx", "y", F.explode(ends).alias("r"))
    return runs.select((F.col("bx") * SIDE + F.col("r.a")).alias("x0"), (F.col("bx") * SIDE + F.col("r.b")).alias("x1"), "y")


def _touching(runs: DataFrame, tile: int | None) -> DataFrame:
    """``a, b``: runs that touch, also at corners; equi-joins on rows and blocks."""
    runs = runs.withColumn("id", pixel(F.col("x0"), F.col("y")))
    name = lambda s: runs.select(*[F.col(c).alias(c + s) for c in ("id", "x0", "x1", "y")])
    left, right = name("a"), name("b")
    beside = left.join(right, (F.col("yb") == F.col("ya")) & (F.col("x0b") == F.col("x1a") + 1))
    blocks = F.explode(F.sequence(F.floor((F.col("x0a") - 1) / SIDE), F.floor((F.col("x1a") + 1) / SIDE)))
    under = left.withColumns({"block": blocks, "yb": F.col("ya") + 1}).join(right.withColumn("block", F.floor(F.col("x0b") / SIDE)), ["block", "yb"])
    under = under.where((F.col("x0b") <= F.col("x1a") + 1) & (F.col("x1b") >= F.col("x0a") - 1))
    columns = ["ida", "idb", "x0a", "x0b", "ya", "yb"]
    met = beside.select(columns).unionByName(under.select(columns))
    if tile is not None:
        same = lambda p, q: F.floor(F.col(p) / tile) == F.floor(F.col(q) / tile)
        met = met.where(same("x0a", "x0b") & same("ya", "yb"))
    return met.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


@dataclass(frozen=True)
class Shape:
    """What a blob must be to count as a road; fixed values as the defaults."""

    area: int = 55
    span: int = 26
    elongation: float = 1.8
    large: int = 1200
    fill: float = 0.52

    def kept(self) -> Column:
        span = F.greatest("width", "height")
        long = span / F.least("width", "height")
        fill = F.col("area") / (F.col("width") * F.col("height"))
        compact = (F.col("area") < self.large) & (long < self.elongation)
        filled = (fill > self.fill) & (long < max(self.elongation * 1.35, 3.2))
        return (F.col("area") >= self.area) & (span >= self.span) & ~compact & ~filled


ORANGE_SHAPE, WHITE_SHAPE = Shape(), Shape(elongation=2.35, large=4200, fill=0.36)


def road_blobs(runs: DataFrame, shape: Shape, tile: int | None = geo.TILE_SIZE) -> DataFrame:
    """``x0, x1, y`` of runs with their blob, its area, width, height, and whether it is ``kept``. Stage the runs before."""
    found = close_components(_touching(runs, tile))
    own = pixel(F.col("x0"), F.col("y"))
    named = runs.withColumn("node", own).join(found, "node", "left").withColumn("blob", F.coalesce("component", "node")).drop("node", "component")
    extent = lambda high, low: (F.max(high) - F.min(low) + 1)
    blobs = named.groupBy("blob").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), extent("x1", "x0").alias("width"), extent("y", "y").alias("height"))
    return named.join(blobs.withColumn("kept", shape.kept()), "blob")


def clean_mask(pixels: DataFrame, shape: Shape, tile: int | None = geo.TILE_SIZE) -> DataFrame:
    """``x, y`` on the map of the pixels (``x, y``) of a mask that are left after closing, opening and dropping blobs that are no roads."""
    runs = staged(smoothed_runs(pixels, tile), "runs")
    kept = road_blobs(runs, shape, tile).where("kept")
    return kept.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def on_the_map(pixels: DataFrame, tile: int = geo.TILE_SIZE) -> DataFrame:
    """Pixels of tiles with their places among all tiles' pixels."""
    return pixels.withColumns({"x": F.col("tile_x") * tile + F.col("x"), "y": F.col("tile_y") * tile + F.col("y")})


def clean_cell_ratios(pixels: DataFrame, stride: int = 10, least: float = 0.16, tile: int = geo.TILE_SIZE, across: bool = False) -> DataFrame:
    """:func:`cell_ratios` from clean masks of whole tiles (``tile_x, tile_y, x, y, r, g, b, alpha``); ``across``: blobs may cross tiles."""
    m = colour_masks(F.col("r"), F.col("g"), F.col("b"), F.col("alpha"))
    placed = on_the_map(pixels, tile)
    side = None if across else tile
    parts = [clean_mask(placed.where(m[kind]), shape, side).withColumn("kind", F.lit(kind)) for kind, shape in (("white", WHITE_SHAPE), ("orange", ORANGE_SHAPE))]
    flags = parts[0].unionByName(parts[1]).groupBy("x", "y").agg(F.bool_or(F.col("kind") == "white").alias("white"), F.bool_or(F.col("kind") == "orange").alias("orange"))
    part = lambda c: F.floor(F.col(c) / tile)
    inner = lambda c: F.floor(F.pmod(F.col(c), F.lit(tile)) / stride)
    hits = lambda c: F.count_if(F.col(c))
    cells = flags.groupBy(part("x").alias("tile_x"), part("y").alias("tile_y"), inner("x").alias("cell_x"), inner("y").alias("cell_y")).agg(F.count("*").alias("n"), hits("white").alias("w"), hits("orange").alias("o"))
    length = lambda c: F.least(F.lit(stride), tile - F.col(c) * stride)
    area = length("cell_x") * length("cell_y")
    out = cells.select("tile_x", "tile_y", "cell_x", "cell_y", (F.col("n") / area).alias("road_ratio"), (F.col("w") / area).alias("white_ratio"), (F.col("o") / area).alias("orange_ratio"))
    return out.where(F.col("road_ratio") >= least)
