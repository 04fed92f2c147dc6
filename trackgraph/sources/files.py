"""Marker, graph, calibration and tile image files, and the tables that jobs write."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgraph.functions import geo

MARKERS = "markerId string, id string, title string, category string, parent_category string, description string, desc string, map_x double, map_y double, color string"
CALIBRATION = "name string, forza_x double, forza_z double, yaw_deg double, map_x double, map_y double"
GRAPH = "version string, generated_at string, map_id int, layer_id int, zoom int, scale double, stride_px double, runtime_stitch_radius_cells int, runtime_component_bridge_radius_px double, nodes array<string>, edges array<string>"


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Markers of JSON arrays; a missing path or a file that is no array of objects gives no rows."""
    try:
        rows = spark.read.schema(MARKERS).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKERS)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns]).isNotNull())


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV file with a header, with or without a byte order mark."""
    return spark.read.schema(CALIBRATION).option("header", True).csv(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and header of graph files. Nodes and edges are objects, under any of their field names, or arrays.

    A node without an id takes its position as its id; nodes without a place are left out. ``seq`` is an edge's position.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", GRAPH).alias("g"))
    first = lambda *paths: F.coalesce(*[F.get_json_object("item", f"${p}") for p in paths])
    kind = first(".road_class", ".kind", ".type")
    nodes = whole.select(F.posexplode("g.nodes").alias("pos", "item")).select(
        F.coalesce(first(".id"), F.col("pos").cast("string")).alias("node_id"), first(".map_x", ".x", "[0]").cast("double").alias("map_x"),
        first(".map_y", ".y", "[1]").cast("double").alias("map_y"), geo.road_class(kind).alias("road_class"))
    edges = whole.select(F.posexplode("g.edges").alias("seq", "item")).select(
        first(".from", ".a", "[0]").alias("a"), first(".to", ".b", "[1]").alias("b"), first(".length").cast("double").alias("length"),
        first(".cost", "[2]").cast("double").alias("cost"), kind.alias("road_class"), "seq")
    return nodes.where("map_x is not null and map_y is not null"), edges, whole.select("g.*").drop("nodes", "edges")


PIXELS = "tile_x long, tile_y long, x long, y long, r int, g int, b int, alpha int"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixel rows of tile images; their bytes come in the order blue, green, red, alpha, or as one grey byte."""
    for batch in batches:
        for tile in batch.to_pylist():
            height, width, channels = tile["height"], tile["width"], tile["nChannels"]
            raw = np.frombuffer(tile["data"], np.uint8).reshape(height * width, channels).astype(np.int32)
            bgr = raw[:, [0, 1, 2]] if channels >= 3 else np.repeat(raw[:, :1], 3, axis=1)
            alpha = raw[:, 3] if channels == 4 else np.full(len(raw), 255, np.int32)
            y, x = np.divmod(np.arange(len(raw)), width)
            columns = [np.full(len(raw), tile["tile_x"]), np.full(len(raw), tile["tile_y"]), x, y, bgr[:, 2], bgr[:, 1], bgr[:, 0], alpha]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile_x", "tile_y", "x", "y", "r", "g", "b", "alpha"])


def read_tiles(spark: SparkSession, root: str, map_id: int, layer: int, zoom: int) -> DataFrame:
    """``tile_x, tile_y, x, y, r, g, b, alpha``: the pixels of tile images ``{root}/{map_id}/{layer}/{zoom}/{x}-{y}.png``.

    Files of other names and files that are no images are skipped; a missing folder gives no rows. Each image is unpacked by the task
    that reads it, one at a time. An image without alpha is opaque; a grey one has three equal colours.
    """
    try:
        files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.png").load(f"{root}/{map_id}/{layer}/{zoom}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PIXELS)
    name = lambda k: F.regexp_extract("image.origin", r"/([+-]?\d+)-([+-]?\d+)\.png$", k)
    tiles = files.select(name(1).alias("a"), name(2).alias("b"), "image.height", "image.width", "image.nChannels", "image.data").where("a <> ''")
    tiles = tiles.select(F.col("a").cast("long").alias("tile_x"), F.col("b").cast("long").alias("tile_y"), "height", "width", "nChannels", "data")
    return tiles.mapInArrow(_unpacked, PIXELS)


def write_graph(nodes: DataFrame, edges: DataFrame, header: dict[str, str], path: str) -> None:
    """``nodes`` and ``edges`` as Parquet and ``header`` as one line of JSON with the counts of each road class."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession

    def counts(name: str) -> DataFrame:
        found = spark.read.parquet(f"{path}/{name}").groupBy("road_class").count()
        return found.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("road_class", "count")))).alias(f"{name[:-1]}_class_counts"))

    line = counts("nodes").join(counts("edges"), F.lit(True)).select(*[F.lit(v).alias(k) for k, v in header.items()], "*")
    line.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def write_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Rows as Parquet, in folders by the given columns; each folder's rows meet first, so that it gets few files."""
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
