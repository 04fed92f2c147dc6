import struct
import zlib

import numpy as np
import pytest

from trackgraph.operators import raster
from trackgraph.sources import files


def png(pixels):
    """A PNG file of an array of height x width x channels (1, 3 or 4) bytes."""
    height, width, channels = pixels.shape
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    kind = {1: 0, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two tiles side by side with a white stripe across their border, an orange one in the second, and files that are no tiles."""
    top = tmp_path_factory.mktemp("tiles")
    folder = top / "1" / "760" / "18"
    folder.mkdir(parents=True)
    left, right = (np.zeros((256, 256, 4), np.uint8) for _ in range(2))
    left[100:104, 206:] = right[100:104, :20] = (220, 221, 222, 255)
    right[20:24, 10:90] = (220, 120, 60, 255)  # in the first tile, cells lie on ties of the grid
    left[50:62, 50:62] = (230, 230, 230, 255)  # a compact block is no road
    left[200:204, 10:90] = (220, 220, 220, 10)  # not opaque enough
    for name, image in (("0-0", left), ("1-0", right), ("-2-5", np.full((4, 3, 3), (9, 8, 7), np.uint8)), ("7-7", np.full((2, 2, 1), 5, np.uint8)), ("preview", left), ("1-x", left)):
        (folder / f"{name}.png").write_bytes(png(image))
    (folder / "3-3.png").write_bytes(b"no image")
    (folder / "4-4.jpg").write_bytes(png(left))
    return str(top)


def test_tiles_are_read_as_pixels(spark, root):
    got = files.read_tiles(spark, root, 1, 760, 18)
    assert {(r.tile_x, r.tile_y): r["count"] for r in got.groupBy("tile_x", "tile_y").count().collect()} == {(0, 0): 65536, (1, 0): 65536, (-2, 5): 12, (7, 7): 4}
    assert [tuple(r) for r in got.where("tile_x = 0 and x = 206 and y = 100").collect()] == [(0, 0, 206, 100, 220, 221, 222, 255)]
    assert {tuple(r)[4:] for r in got.where("tile_x = -2").collect()} == {(9, 8, 7, 255)} and {tuple(r)[4:] for r in got.where("tile_x = 7").collect()} == {(5, 5, 5, 255)}
    assert files.read_tiles(spark, root, 1, 760, 17).count() == 0


def test_from_images_to_edges(spark, root):
    pixels = files.read_tiles(spark, root, 1, 760, 18).where("tile_x in (0, 1)")
    m = raster.colour_masks(*[pixels[c] for c in ("r", "g", "b", "alpha")])
    placed = raster.on_the_map(pixels)
    white = {(r.x, r.y) for r in raster.clean_mask(placed.where(m["white"]), raster.WHITE_SHAPE).collect()}
    assert white == {(x, y) for x in range(206, 256) for y in range(100, 104)}  # the 20 pixels in the other tile are too short a road
    both = {(r.x, r.y) for r in raster.clean_mask(placed.where(m["white"]), raster.WHITE_SHAPE, tile=None).collect()}
    assert both == {(x, y) for x in range(206, 276) for y in range(100, 104)}
    nodes = raster.grid_nodes(raster.clean_cell_ratios(pixels)).withColumnRenamed("map_x", "x").selectExpr("gx * 1000 + gy as node_id", "gx", "gy", "x as map_x", "map_y", "road_class").cache()
    kinds = {(r.gy, r.road_class) for r in nodes.collect()}
    assert {k for _, k in kinds} == {"white", "orange"} and {y for y, k in kinds if k == "white"} == {10}
    edges = raster.neighbour_edges(nodes, {"white": 1.0, "orange": 1.12, "orange_dashed": 2.35, "unknown": 8.0}).collect()
    assert edges and {(r.length, r.cost) for r in edges if r.road_class == "orange" and r.length == 10} == {(10.0, 11.2)}


def morphology(mask, grow):
    """Dilation or erosion by 3 x 3; pixels outside the image count as unset or set."""
    p = np.pad(mask, 1, constant_values=not grow)
    parts = [p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return np.any(parts, axis=0) if grow else np.all(parts, axis=0)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_closing_and_opening(spark, share):
    """Tiles of 64 pixels, at negative places too, against whole arrays."""
    rnd = np.random.default_rng(1)
    image = rnd.random((128, 192)) < share
    rows = [(int(x) - 64, int(y) - 64) for y, x in zip(*np.nonzero(image))]
    runs = raster.smoothed_runs(spark.createDataFrame(rows, "x long, y long"), tile=64).collect()
    got = np.zeros_like(image)
    for r in runs:
        assert not got[r.y + 64, r.x0 + 64 : r.x1 + 65].any()
        got[r.y + 64, r.x0 + 64 : r.x1 + 65] = True
    for top in range(0, 128, 64):
        for left in range(0, 192, 64):
            m = image[top : top + 64, left : left + 64]
            for grow in (True, False, False, True):
                m = morphology(m, grow)
            assert (got[top : top + 64, left : left + 64] == m).all()


def test_no_pixels(spark):
    assert raster.clean_mask(spark.createDataFrame([], "x long, y long"), raster.ORANGE_SHAPE).count() == 0
