"""Gapless ranks of large groups without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, groups: list[str], order: Column, ties: list[str], name: str = "rank", buckets: int = 1024) -> DataFrame:
    """``df`` with ``name``, 0, 1, 2, ... in each group in the order of ``order`` (a hash) modulo ``buckets``, then ``order``, ``ties``.

    Only the counts of (group, bucket) pairs meet in one window, so a group of N rows is sorted in pieces of N / buckets. ``df`` is
    read twice. The number of groups must be small, for the counts are broadcast: groups x buckets rows.
    """
    df = df.withColumns({"__o": order, "__b": F.pmod(order, F.lit(buckets)).cast("int")})
    keys = [*groups, "__b"]
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = df.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__o", *ties)) - 1
    return df.join(F.broadcast(offset), keys).withColumn(name, (F.col("__at") + place).cast("long")).drop("__o", "__b", "__at")
