"""Column functions: projections, headings, units, tiles, grids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# World to map transform, map scale, image to map transform.
AFFINE = (0.652837, 0.000763, 10387.027, -0.003754, -0.657135, 9846.097)
PIXELS_PER_METRE = 0.655
MAP_SIZE, TILE_SIZE, MAX_ZOOM, MIN_ZOOM = 20000, 256, 18, 12
IMAGE = (6.58487266, 4594.21749925, 6.60554791, 3225.79270983)


def map_x(x: Column, z: Column, affine=AFFINE) -> Column:
    return x * affine[0] + z * affine[1] + affine[2]


def map_y(x: Column, z: Column, affine=AFFINE) -> Column:
    return x * affine[3] + z * affine[4] + affine[5]


def kmh(mps: Column) -> Column:
    return mps * 3.6


def percent(raw: Column) -> Column:
    return raw / 255.0 * 100.0


def heading(speed_mps: Column, vx: Column, vz: Column, yaw: Column, affine=AFFINE) -> Column:
    """Degrees in (-180, 180]: of the velocity if faster than 1.5 m/s, else of the yaw, both through the map's linear part."""
    moving = speed_mps > 1.5
    x, z = F.when(moving, vx).otherwise(F.sin(yaw)), F.when(moving, vz).otherwise(F.cos(yaw))
    return F.degrees(F.atan2(x * affine[0] + z * affine[1], -(x * affine[3] + z * affine[4])))


def normal_angle(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def metres(pixels: Column) -> Column:
    return pixels / PIXELS_PER_METRE


def pixels(metres_: Column) -> Column:
    return metres_ * PIXELS_PER_METRE


def image_to_map(x: Column, y: Column) -> tuple[Column, Column]:
    return F.round(x * IMAGE[0] + IMAGE[1], 3), F.round(y * IMAGE[2] + IMAGE[3], 3)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def tile(value: Column, zoom: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), zoom - MAX_ZOOM) / TILE_SIZE)


def covering_tiles(x0: Column, x1: Column, zoom: Column, margin: int = 1) -> Column:
    """Array of the tile numbers along one axis that cover ``x0 .. x1``, clipped to the map."""
    scale = F.pow(F.lit(2.0), zoom - MAX_ZOOM)
    last = F.ceil(MAP_SIZE * scale / TILE_SIZE) - 1
    low = F.greatest(F.floor(x0 * scale / TILE_SIZE) - margin, F.lit(0))
    high = F.least(F.ceil(x1 * scale / TILE_SIZE) + margin, last)
    return F.when(low <= high, F.sequence(low, high))


def cell(value: Column, size: float = 320.0) -> Column:
    return F.floor(value / size)


def grid_index(value: Column, stride: float) -> Column:
    """Nearest grid line, ties to even; a stride of 0 or less stands for 10."""
    return F.bround(value / (stride if stride > 0 else 10.0), 0).cast("long")


def gear_label(gear: Column) -> Column:
    """Label of a gear given as number or text."""
    number, text = gear.try_cast("double"), F.upper(F.trim(gear.cast("string")))
    return (F.when(number.isNull(), F.when(F.coalesce(text, F.lit("")) == "", "N").otherwise(text))
            .when(number == 0, "N").when(number < 0, "R").otherwise(half_up(number).cast("string")))


def distance_label(metres_: Column) -> Column:
    return F.when(half_up(metres_) >= 1000, F.concat(F.format_string("%.1f", metres_ / 1000), F.lit(" km"))).otherwise(F.concat(half_up(metres_).cast("string"), F.lit(" m")))


def eta_minutes(metres_: Column, speed_kmh: Column) -> Column:
    return F.greatest(F.lit(1), half_up(metres_ / 1000 / F.greatest(F.lit(15.0), speed_kmh) * 60))


# Road classes from most to least preferred, and their other names.
ROAD_CLASSES = ["white", "orange", "orange_dashed", "synthetic_bridge", "unknown"]
ROAD_ALIASES = {
    "white": ["white", "light", "road", "street", "main", "primary", "magenta", "pink", "purple", "highway"],
    "orange": ["orange", "salmon", "secondary"],
    "orange_dashed": ["orange_dashed", "dashed", "trail", "dirt", "path"],
    "synthetic_bridge": ["synthetic", "synthetic_bridge", "bridge", "stitch", "stitch_bridge", "component_bridge", "gap_bridge", "runtime_bridge"],
}
# Cost multipliers by profile.
PROFILES = {
    "asphalt_practical": {"white": 1.00, "orange": 1.08, "orange_dashed": 2.60, "synthetic_short": 2.40, "synthetic_medium": 7.00, "synthetic_bridge": 34.00, "unknown": 9.50},
    "detour_escape": {"white": 1.00, "orange": 1.02, "orange_dashed": 1.85, "synthetic_short": 1.65, "synthetic_medium": 4.20, "synthetic_bridge": 22.00, "unknown": 11.00},
    "shortest_sane": {"white": 1.00, "orange": 1.00, "orange_dashed": 1.25, "synthetic_short": 1.25, "synthetic_medium": 2.80, "synthetic_bridge": 18.00, "unknown": 14.00},
}


def road_class(text: Column) -> Column:
    name, out = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "- ", "__"), F
    for kind, names in ROAD_ALIASES.items():
        out = out.when(name.isin(names), kind)
    return out.otherwise("unknown")


def road_rank(kind: Column) -> Column:
    out = F
    for rank, name in enumerate(ROAD_CLASSES):
        out = out.when(kind == name, rank)
    return out.otherwise(len(ROAD_CLASSES) - 1)
