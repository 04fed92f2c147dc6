"""Telemetry, graph, marker, request and pixel tables derived from the driver's business tables by exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user: ``player_id, seq, ts_ms`` and sensor columns; every 20 packets there is a gap of 2 s."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("player_id"), "event_id", "ts", "value")
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("player_id").orderBy("ts", "event_id")).cast("long"))
    i, s = F.col("event_id"), F.col("seq")
    paused = s % 11 == 0
    speed = F.when(paused, 0.0).otherwise(F.least(F.coalesce("value", F.lit(0.0)), F.lit(400.0)))
    return e.select(
        "player_id", "seq", (s * 100 + F.floor(s / 20) * 2000).alias("ts_ms"),
        (s * 3 + i % 17).cast("double").alias("position_x"), ((i * 11 % 50) / 10).alias("position_y"), (s * 2 - i % 13).cast("double").alias("position_z"),
        (speed / 3.6).alias("speed_mps"), (i % 21 - 10).cast("double").alias("velocity_x"), ((i * 7 % 41 - 20) / 10).alias("velocity_y"), (i % 19 - 9).cast("double").alias("velocity_z"),
        ((i % 628) / 100).alias("yaw_rad"), F.when(paused, 0).otherwise(i % 7).cast("int").alias("gear"),
        (i * 37 % 9000).cast("double").alias("rpm"), F.when(i % 3 == 0, 0.0).otherwise((7000 + i % 5 * 500).cast("double")).alias("engine_max_rpm"),
        F.when(s % 37 == 0, 0).otherwise(s * 10 % 4000).cast("double").alias("distance_traveled_m"),
        (i * 29 % 256).cast("int").alias("accel_raw"), (i * 13 % 256).cast("int").alias("brake_raw"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("file_order"), F.when(k % 5 != 0, k.cast("string")).alias("marker_id"), F.when(k % 3 == 0, (k % 100).cast("string")).alias("id"),
        F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("parent_category"),
        (k * 7919 % 20000).cast("double").alias("map_x"), (k * 104729 % 20000).cast("double").alias("map_y"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("request_id"), (k * 37 % 500).cast("double").alias("start_x"), (k * 53 % 400).cast("double").alias("start_y"),
        ((k * 91 + n * 17) % 500).cast("double").alias("target_x"), ((k * 71 + n * 29) % 400).cast("double").alias("target_y"), F.col("s_name").alias("name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes with stride 10; parts of small size leave holes, so that there are several components."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(size < 35, "white").when(size < 45, "orange").otherwise("orange_dashed")
    return table(spark, sf_dir, "part").where("p_size > 12").select(
        k.alias("node_id"), (k % 50).alias("gx"), F.floor(k / 50).alias("gy"), (k % 50 * 10).cast("double").alias("map_x"), (F.floor(k / 50) * 10).cast("double").alias("map_y"), kind.alias("road_class"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes in blocks of 10 x 10: pairs of blocks 4 cells apart, pairs 16 cells apart, rows of ten blocks 21 cells apart."""
    k, size = F.col("p_partkey"), F.col("p_size")
    block = F.floor(k / 100)
    gx = k % 10 + F.floor(block % 10 / 2) * 38 + block % 2 * 13
    gy = F.floor(k % 100 / 10) + F.floor(block / 10) * 30
    kind = F.when(size < 35, "white").when(size < 45, "orange").otherwise("orange_dashed")
    return table(spark, sf_dir, "part").where("p_size > 12").select(
        k.alias("node_id"), gx.alias("gx"), gy.alias("gy"), (gx * 10).cast("double").alias("map_x"), (gy * 10).cast("double").alias("map_y"), kind.alias("road_class"))


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a graph detected in images, without radii of its own."""
    return table(spark, sf_dir, "part").agg(F.concat(F.lit("road-CV-"), F.count("*").cast("string")).alias("version"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured pixels of 256 x 256 tiles."""
    o, p, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("long")
    x, y = (o * 7 + F.col("l_linenumber") * 31) % 256, (p * 11 + q) % 256
    kind = (o + p) % 3
    channel = lambda white, orange, other: F.when(kind == 0, white).when(kind == 1, orange).otherwise(other)
    return table(spark, sf_dir, "lineitem").select(
        (o % 4).alias("tile_x"), (p % 3).alias("tile_y"), x.alias("x"), y.alias("y"),
        channel(200 + q % 50, 190 + q, 10 + q).cast("int").alias("r"), channel(200 + q % 40, 90 + q, 60 + q).cast("int").alias("g"), channel(195 + q % 50, 40 + q, 90 + q).cast("int").alias("b"), (q * 5).cast("int").alias("alpha"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of tiles with thick dashed lines in road colours and grey, with gaps, pinholes and steps."""
    k = F.col("o_orderkey")
    line, along = F.floor(k / 80), k % 80
    period = F.when(line % 5 == 4, 5).otherwise(17)
    length = F.when(k % period == 0, 0).when(k % 29 == 0, 3).otherwise(4)
    thick = F.when(line % 6 == 5, 8).otherwise(3)
    spots = table(spark, sf_dir, "orders").select(k.alias("k"), line.alias("line"), (along * 4 + line % 3 * 100).alias("x"), (line * 9 + F.floor(along / 20) % 2).alias("y"), thick.alias("thick"), F.explode(F.sequence(F.lit(0), length - 1)).alias("dx"), length.alias("length")).where("length > 0")
    spots = spots.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("thick") - 1)))
    x, y = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    colour = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("line") % 4 + 1).cast("int"))
    rows = spots.select(F.floor(x / 256).alias("tile_x"), F.floor(y / 256).alias("tile_y"), (x % 256).alias("x"), (y % 256).alias("y"), colour(220, 220, 200, 90).alias("r"), colour(220, 120, 60, 90).alias("g"), colour(215, 60, 160, 90).alias("b"), F.when(F.col("k") % 41 == 0, 10).otherwise(255).alias("alpha"))
    return rows.groupBy("tile_x", "tile_y", "x", "y").agg(F.max(F.struct("r", "g", "b", "alpha")).alias("c")).select("tile_x", "tile_y", "x", "y", "c.*")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pixels along crossing lines with gaps, and their colours: ``x, y, grey, r, g, b``; every 8 lines form a map of their own."""
    k = F.col("o_orderkey")
    line, along = F.floor(k / 200), k % 200
    own = line % 8
    flat = own % 2 == 0
    x, y = F.when(flat, along + 10 * (own % 3)).otherwise(own * 20) + F.floor(line / 8) * 1000, F.when(flat, own * 6).otherwise(along)
    grey = F.when(k % 53 == 0, 40).otherwise(255)
    rows = table(spark, sf_dir, "orders").select(x.alias("x"), y.alias("y"), F.struct(grey.alias("grey"), (120 + k % 120).alias("r"), (80 + k * 7 % 80).alias("g"), (k * 3 % 90).alias("b")).alias("c"))
    return rows.groupBy("x", "y").agg(F.max("c").alias("c")).select("x", "y", "c.*")


def mask_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the image that :func:`mask` draws on: 1000 pixels for each map, side by side."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return ((last or 0) // 1600 + 1) * 1000, 1000


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of diamonds of 40 pixels, some of which are open: ``x, y``."""
    k = F.col("o_orderkey")
    ring, side, j = F.floor(k / 40), F.floor(k % 40 / 10), k % 10
    x = F.when(side == 0, j).when(side == 1, 10 - j).when(side == 2, -j).otherwise(j - 10)
    y = F.when(side == 0, 10 - j).when(side == 1, -j).when(side == 2, j - 10).otherwise(j)
    return table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select((ring % 50 * 24 + 12 + x).alias("x"), (F.floor(ring / 50) * 24 + 12 + y).alias("y"))
