"""Joins of rows with a table of their groups where one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most, and rows of a group that is.
MOST_GROUPS, LEAST_ROWS = 100_000, 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str = "group_rows", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each value of ``keys``, with the number ``size`` of its rows) without that number.

    Groups of at least 1,000 and ``total / 100,000`` rows, so 100,000 at most, are broadcast and their rows stay where they are; the
    others meet their rows by a shuffle. ``total`` is a bound on the rows of all groups. Both tables are read twice: stage them. Rows
    with a null key are in no group. ``how`` is inner or left.
    """
    least = max(LEAST_ROWS, -(-total // MOST_GROUPS))
    hot = groups.where(F.col(size) >= least)
    new = [c for c in groups.columns if c not in keys and c != size]
    marked = hot.select(*keys, *new, F.lit(True).alias("__hot"))
    met = rows.join(F.broadcast(marked), keys, "left").where("__hot").select(*rows.columns, *new)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return met.unionByName(others.join(groups.where(F.col(size) < least).select(*keys, *new), keys, how).select(*rows.columns, *new))
