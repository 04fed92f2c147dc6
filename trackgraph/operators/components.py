"""Connected components of an undirected graph by alternating star contraction, after a pass over chunks where neighbours' ids are close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that are contracted at once in a task's memory.
CHUNK = 1_000_000


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and for each the smallest node that it is connected to."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        ta, tb = top[a], top[b]
        open_ = ta != tb
        if not open_.any():
            return nodes, nodes[top]
        a, b, ta, tb = a[open_], b[open_], ta[open_], tb[open_]
        top[np.maximum(ta, tb)] = np.minimum(ta, tb)  # a larger top goes under one of the smaller ones it meets
        while True:
            further = top[top]
            if (further == top).all():
                break
            top = further


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` for the nodes of each chunk of edges ``u, v``."""

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots = _least(*(np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1)))
        yield from (pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(roots[i : i + 65_536])], names=["node", "root"]) for i in range(0, len(nodes), 65_536))

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield from solved(held)
            held, rows = [], 0
    if held:
        yield from solved(held)


def close_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """:func:`connected_components` of a graph whose ids are close to each other where nodes are neighbours, as on a map.

    Edges in order of ids are contracted chunk by chunk, then the chunks' components that share a node: in one task if they are few,
    else by star contraction. The number of jobs does not grow with the diameter of the graph. Other orders of ids cost time only; ids of
    another type are left to star contraction.
    """
    if {edges.schema[c].dataType.typeName() for c in (a, b)} != {"long"}:
        return connected_components(edges, a, b)
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pieces = staged(staged(now, "edges").repartitionByRange("u", "v").mapInArrow(_in_chunks, "node long, root long"), "pieces")
    shared = pieces.groupBy("node").agg(F.collect_set("root").alias("roots")).where(F.size("roots") > 1)
    links = shared.select(F.array_min("roots").alias("u"), F.explode("roots").alias("v")).where("u <> v").distinct()
    rows = Observation()
    links = staged(links.observe(rows, F.count("*").alias("n")), "links")
    if rows.get["n"] <= CHUNK:
        found = links.coalesce(1).mapInArrow(_in_chunks, "node long, root long").select("node", F.col("root").alias("component"))
    else:
        found = connected_components(links, "u", "v")
    least = pieces.groupBy("node").agg(F.min("root").alias("root"))
    found = found.select(F.col("node").alias("root"), "component")
    return least.join(found, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; component is the smallest node of it.

    Self-edges, repeated edges and edges with a null end are ignored. Each round is one job of groupings and equi-joins on the node,
    whose result is written to the shared folder and summed up while it is written; rounds grow with the logarithm of the graph's
    size and end when one changes nothing. An edge table without rows gives no rows. Ids may be of any orderable type.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = staged(now, "components"), None
    while True:
        seen = Observation()
        now = staged(_small_star(_large_star(now)).observe(seen, F.count("*").alias("rows"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")), "components")
        mark = seen.get
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
