"""Whitening of embedding columns by a covariance that is computed tile by tile.

Pairs of dimensions are dealt into tiles of ``WIDTH x WIDTH``. Rows travel as column blocks (``WIDTH`` dimensions of up to ``ROWS``
rows) keyed by row block and tile; the two column blocks of a tile are multiplied where they meet and products are summed tile by
tile. Only the assembled matrix of all pairs of dimensions, whose size does not depend on the rows, reaches the driver. All sums are
of whole numbers and exact, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Scaled entries from here on cannot be told apart from their neighbours; vectors that hold one count as not finite.
LARGEST = 2.0**40
ROWS, WIDTH = 2048, 32
#: Below it, sums of whole numbers are exact in floating point.
EXACT = 2**53
LONG = 2**63


@dataclass(frozen=True)
class Fit:
    """Rows, sums of x by dimension, the covariance's eigenvalues (falling) and its unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def components(self, most: int) -> int:
        """The first components, up to ``most``, whose variance is not zero to double precision."""
        least = max(self.values.max(initial=0), 0) * len(self.values) * np.finfo(float).eps
        return int((self.values[:most] > least).sum())

    def projected(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened components of rows of x."""
        whole = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, whole)])
        return ((x - whole) - rest) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - S)**2``, exact; None beyond a long."""
        sums = np.array(self.sums, object)
        y = x.astype(object) * self.n - sums if self.n * int(np.abs(x).max(initial=0)) >= LONG // 4 else x * self.n - sums.astype(np.int64)
        if int(np.abs(y).max(initial=0)) ** 2 * max(x.shape[1], 1) < LONG:
            return (y * y).sum(axis=1).tolist()
        return [v if v < LONG else None for v in (y.astype(object) ** 2).sum(axis=1).tolist()]


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """``id, v`` (doubles) of rows whose vector has entries, all of them finite, and the most frequent length (of these the longest)."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < LARGEST), F.lit(False))
    rows = table.select(F.col(id_).alias("id"), entries.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """x of a batch's vectors, one row each."""
    v = batch.column("v")
    return np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(len(v), -1) + SHIFT


def _sums(rows: DataFrame) -> list[int]:
    """The number of rows and the sum of each dimension."""

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"s": pa.array([[b.num_rows, *_matrix(b).sum(axis=0).tolist()]], pa.list_(pa.int64()))})

    parts = rows.select("v").mapInArrow(batch_sums, "s array<long>").select(F.posexplode("s").alias("place", "s"))
    found = parts.groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("place").collect()
    return [int(r["s"]) for r in found]


def column_blocks(rows: DataFrame, centre: list[int]) -> DataFrame:
    """``block, left, right, side, height, size, data``: column blocks of x less ``centre``, once for each tile they take part in.

    A row block is named by its task and its number there, so names hold within one run of a job only.
    """
    middle = np.array(centre, np.int64)
    bands = range(-(-len(centre) // WIDTH))
    types = {"block": pa.int64(), "left": pa.int32(), "right": pa.int32(), "side": pa.int32(), "height": pa.int32(), "size": pa.int32(), "data": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = _matrix(b.slice(at, ROWS)) - middle
                out = []
                for i in bands:
                    data = y[:, i * WIDTH : (i + 1) * WIDTH]
                    data = np.ascontiguousarray(data, np.int32 if np.abs(data).max() < 2**31 else np.int64)
                    out += [(name, min(i, j), max(i, j), int(i > j), len(y), data.itemsize, data.tobytes()) for j in bands]
                name += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

    return rows.select("v").mapInArrow(cut, "block long, left int, right int, side int, height int, size int, data binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact ``a.T @ b`` of whole numbers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(len(a), 1)
    if bound < EXACT:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    return a.T @ b if bound < LONG else a.astype(object).T @ b.astype(object)


def tile_sums(blocks: DataFrame) -> DataFrame:
    """``left, right, place, high, low``: entries ``high * 2**32 + low`` of each tile's product over all row blocks."""

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(r.data, np.dtype(f"i{r.size}")).reshape(r.height, -1).astype(np.int64) for r in group.sort_values("side").itertuples()]
        p = products(sides[0], sides[-1]).ravel()
        tile = group[["left", "right"]].iloc[:1].reset_index(drop=True)
        return tile.assign(high=[[int(v) for v in p >> 32]], low=[[int(v) for v in p & 0xFFFFFFFF]])

    met = blocks.groupBy("block", "left", "right").applyInPandas(multiply, "left int, right int, high array<long>, low array<long>")
    entries = met.select("left", "right", F.posexplode(F.arrays_zip("high", "low")).alias("place", "e"))
    return entries.groupBy("left", "right", "place").agg(F.sum("e.high").alias("high"), F.sum("e.low").alias("low"))


def covariance(n: int, sums: list[int], centre: list[int], tiles: DataFrame) -> np.ndarray:
    """The covariance (divisor n) from the tiles of products of x less ``centre``, each entry rounded once."""
    d = len(sums)
    off = [s - n * m for s, m in zip(sums, centre)]
    out = np.zeros((d, d))
    for r in tiles.toLocalIterator():
        across = min(WIDTH, d - r["right"] * WIDTH)
        i, j = r["left"] * WIDTH + r["place"] // across, r["right"] * WIDTH + r["place"] % across
        out[i, j] = out[j, i] = (n * ((r["high"] << 32) + r["low"]) - off[i] * off[j]) / (n * n)
    return out


def fit(rows: DataFrame) -> Fit:
    """The fit over all rows of :func:`usable`."""
    n, *sums = _sums(rows) or [0]
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    values, vectors = np.linalg.eigh(covariance(n, sums, centre, tile_sums(column_blocks(rows, centre))))
    return Fit(n, sums, values[::-1].copy(), vectors[:, ::-1].copy())


def identity_error(rows: DataFrame, model: Fit, k: int) -> float | None:
    """The largest absolute entry of the covariance of the first ``k`` whitened components less the identity."""
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = model.projected(_matrix(b), k)
                yield pa.RecordBatch.from_pydict({"s": pa.array([[*w.sum(axis=0), *(w.T @ w).ravel()]], pa.list_(pa.float64()))})

    parts = rows.select("v").mapInArrow(moments, "s array<double>").select(F.posexplode("s").alias("place", "s"))
    s = np.array([r["s"] for r in parts.groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").collect()]) / model.n
    mean, second = s[:k], s[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """``id_, component, n, deviation, whitened, explained, identity_error`` of each usable row and each of the first ``most`` components.

    Entries c become ``x = floor(1024 c) + 100000``. Rows whose vector is null or empty, holds a null or an entry that is not finite
    (or is 2**30 or more), or has another length than most, go. Components without variance (fewer rows than dimensions, equal
    vectors) have a null ``whitened`` and are left out of the identity's error. Repeated rows count as often as they come; ids may be
    null or repeat. ``deviation`` is null where it exceeds a long. An empty table gives no rows.
    """
    rows = usable(table, id_, vector)
    model = fit(rows)
    shown = min(most, len(model.values))
    k = model.components(most)
    error = identity_error(rows, model, k)
    trace = float(model.values.sum())
    share = [float(e / trace) if trace > 0 else None for e in model.values[:shown]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and shown:
                x = _matrix(b)
                w = np.full((len(x), shown), np.nan)
                w[:, :k] = model.projected(x, k)
                rows_ = np.repeat(np.arange(len(x)), shown)
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(rows_)), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))), pa.array(model.deviations(x), pa.int64()).take(pa.array(rows_)),
                     pa.array(flat, pa.float64(), mask=np.isnan(flat))], names=["id", "component", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(project, f"id {kind}, component int, deviation long, whitened double")
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("component")) if share else F.lit(None).cast("double")
    return out.select(F.col("id").alias(id_), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
