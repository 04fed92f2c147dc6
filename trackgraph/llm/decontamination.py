"""Benchmark decontamination by the q-gram lemma on diagonal bands.

Texts are compared in lower case with every run of other characters than letters and digits as one space. Benchmark items are cut
into overlapping segments of ``segment`` characters (a shorter item is one segment) at half their length, and of four fifths of
``quote`` characters at steps of one fifth. Every quote of ``quote`` characters or more of an item that is longer than a segment
thus holds a whole short segment wherever it begins; it is found if that segment has edits in 5 % (``rate``) of its characters at
most, as a verbatim quote always is. Items of at most one segment are found as a whole only. A segment of L characters that occurs in a
document with at most ``e`` edits shares at least ``L - q + 1 - q * e`` q-grams with it whose diagonals (place in the document
minus place in the segment) lie in a band of ``e`` diagonals. Bands of ``2 * (e + 1)`` diagonals that overlap by half are counted;
those that reach the bound are verified by a banded alignment. A document is contaminated by an item if a segment of it occurs.

The benchmark is broadcast in parts of at most ``part_bytes`` bytes of text, one pass over the documents for each.

Items with fewer characters than a q-gram are compared exactly, as runs of whole words.

Defined cases: a null text, and an item without letters and digits, match nothing; repeated documents and items are each matched; a
null doc_id or item_id is matched like any other; other columns are ignored; if either table is empty the result is empty. Whether a
document stays depends on its text alone, so rows that share a doc_id, or have none, are judged each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged
from trackgraph.llm.textblocks import mix

#: Checksums of texts (32 characters each) that may be broadcast. Beyond it they meet the documents by a shuffle join.
BROADCAST_TEXTS = 200_000
_OTHER = re.compile(r"[\W_]+")
_BLOCK_CHARS = 1 << 20
_TABLE_BITS = 22


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` code points."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    step, have, done, out = code.astype(np.uint64), 1, 0, None
    count = len(code) - q + 1
    step = mix(step + np.uint64(1))
    while True:
        if q & have:
            piece = step[done : done + count]
            out = piece if out is None else mix(out * np.uint64(3) + piece)
            done += have
        if have * 2 > q:
            return out
        step = step[:-have] * np.uint64(0x9E3779B97F4A7C15) + step[have:]
        step ^= step >> np.uint64(29)
        have *= 2


@dataclass
class Patterns:
    """Segments of benchmark items, and an index of their q-grams in order of hash. short: segments that are shorter than a q-gram."""

    item: list[int | None]
    text: list[str]
    longest: int
    short: dict[str, list[int]]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    table: np.ndarray


def segments_of(text: str, segment: int, quote: int) -> list[str]:
    """Segments of an item; any ``quote`` characters of an item above ``segment`` characters hold one of them."""
    if len(text) <= segment:
        return [text]
    step = max(1, quote // 5)
    cuts = set()
    for size, stride in ((segment, segment // 2), (max(1, quote - step), step)):
        size = min(size, len(text))
        cuts |= {(s, size) for s in (*range(0, len(text) - size, stride), len(text) - size)}
    return [text[s : s + size] for s, size in sorted(cuts)]


def patterns(items: list[tuple[int | None, str]], q: int, rate: float, segment: int, quote: int) -> Patterns:
    item, text = [], []
    for i, t in items:
        t = normalised(t)
        if not t:
            continue
        own = segments_of(t, segment, quote)
        item += [i] * len(own)
        text += own
    length = np.array([len(t) for t in text], np.int64)
    edits = np.maximum(np.minimum(np.floor(length * rate), (length - q) // q), 0).astype(np.int64)
    short: dict[str, list[int]] = {}
    for k in np.flatnonzero(length < q).tolist():
        short.setdefault(text[k], []).append(k)
    bound = length - q + 1 - q * edits
    hashes = [grams(points(t), q) for t in text]
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    seg = np.repeat(np.arange(len(text)), [len(x) for x in hashes]) if hashes else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    keys, at = np.unique(h[order], return_index=True)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[keys >> np.uint64(64 - _TABLE_BITS)] = True
    return Patterns(item, text, max(map(len, text), default=0), short, edits, bound, keys, np.r_[at, len(order)], seg[order], place[order], table)


def banded_edits(pattern: np.ndarray, region: np.ndarray, low: int, width: int, most: int) -> int:
    """Least edits that turn ``pattern`` into a part of ``region`` whose diagonals stay in ``low .. low + width - 1``.

    ``most + 1`` stands for anything above ``most``.
    """
    far = most + 1
    offsets = np.arange(width)
    row = np.where((low + offsets >= 0) & (low + offsets <= len(region)), 0, far)
    for i in range(1, len(pattern) + 1):
        column = i + low + offsets  # characters of the region that are used up
        valid = (column >= 0) & (column <= len(region))
        taken = (column >= 1) & (column <= len(region))
        same = np.zeros(width, bool)
        same[taken] = region[column[taken] - 1] == pattern[i - 1]
        next_ = np.where(taken, row + ~same, far)
        next_[:-1] = np.minimum(next_[:-1], row[1:] + 1)
        next_ = np.minimum.accumulate(np.where(valid, next_, far) - offsets) + offsets
        row = np.minimum(np.where(valid, next_, far), far)
        if row.min() >= far:
            return far
    return int(row.min())


def _matches(p: Patterns, rows: list[int], texts: list[str], q: int) -> Iterator[tuple[int, int, int]]:
    """``(row, segment, edits)`` in a block of normalised texts."""
    for r, t in zip(rows, texts) if p.short else ():
        own = t.split(" ")
        for k in {x.count(" ") + 1 for x in p.short}:
            for run in p.short.keys() & {" ".join(x) for x in zip(*(own[i:] for i in range(k)))}:
                yield from ((r, s, 0) for s in p.short[run])
    if not len(p.keys):
        return
    joined = "\0".join(texts)
    code = points(joined)
    h = grams(code, q)
    near = np.flatnonzero(p.table[h >> np.uint64(64 - _TABLE_BITS)])
    if not len(near):
        return
    slot = np.minimum(np.searchsorted(p.keys, h[near]), len(p.keys) - 1)
    hit = p.keys[slot] == h[near]
    near, slot = near[hit], slot[hit]
    times = p.at[slot + 1] - p.at[slot]
    if not times.sum():
        return
    shift = 4 * p.longest
    entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(p.at[slot], times)
    segment, diagonal = p.segment[entry], np.repeat(near, times) - p.place[entry] + shift
    reach = p.edits[segment] + 1
    band = diagonal // reach
    key = np.concatenate([segment << 40 | band, segment << 40 | (band - 1)])
    key, count = np.unique(key, return_counts=True)
    segment, band = key >> 40, key & ((1 << 40) - 1)
    good = count >= p.bound[segment]
    at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    for s, b in zip(segment[good].tolist(), band[good].tolist()):
        reach, length, e = int(p.edits[s]) + 1, len(p.text[s]), int(p.edits[s])
        low = b * reach - shift - e
        width = 2 * reach + 2 * e
        middle = min(max(low + width // 2 + length // 2, 0), len(joined) - 1)
        r = int(np.searchsorted(at, middle, side="right")) - 1
        begin, end = max(int(at[r]), low), min(int(at[r + 1]) - 1, low + width + length + e)
        if begin >= end:
            continue
        edits = 0 if p.text[s] in joined[begin:end] else banded_edits(points(p.text[s]), code[begin:end], low - begin, width, e)
        if edits <= e:
            yield rows[r], s, edits


def contaminations(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05, segment: int = 100, part_bytes: int = 8 << 20, quote: int = 100) -> DataFrame:
    """``doc_id, item_id, segments, edits``: documents with an item; segments found, least edits of one."""
    found = _found(docs, F.col("doc_id").cast("long").alias("doc_id"), benchmark, q, rate, segment, part_bytes, quote)
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("segment").alias("segments"), F.min("edits").alias("edits"))


def _found(docs: DataFrame, key: Column, benchmark: DataFrame, q: int, rate: float, segment: int, part_bytes: int, quote: int) -> DataFrame:
    """The key column (of its own name), ``item_id, segment, edits`` for every segment of an item that is found in a row's text."""
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    out = None
    for k in range(parts):
        own = benchmark.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else benchmark
        shared = spark.sparkContext.broadcast(patterns([(r[0], r[1]) for r in own.select("item_id", "text").collect()], q, rate, segment, quote))
        source = docs.select(key, "text")
        schema = f"{source.columns[0]} {source.schema[0].dataType.simpleString()}, item_id long, segment string, edits int"
        found = source.mapInArrow(_finder(shared, q, k, source.columns[0]), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, q: int, number: int, key: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            ids, found = batch.column(0), []
            rows, texts, size = [], [], 0
            for r in range(len(batch) + 1):
                if r < len(batch):
                    text = normalised(batch.column(1)[r].as_py())
                    if text:
                        rows.append(r)
                        texts.append(text)
                        size += len(text)
                if texts and (size > _BLOCK_CHARS or r == len(batch)):
                    if p.text:
                        found += _matches(p, rows, texts, q)
                    rows, texts, size = [], [], 0
            if found:
                at, seg, edits = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([p.item[k] for k in seg], pa.int64()), pa.array([f"{number}.{k}" for k in seg]), pa.array(edits, pa.int32())], [key, "item_id", "segment", "edits"])

    return find


def decontaminated(docs: DataFrame, benchmark: DataFrame, q: int = 12, rate: float = 0.05, segment: int = 100, part_bytes: int = 8 << 20, quote: int = 100) -> DataFrame:
    """The rows whose text has no item of the benchmark, all columns kept."""
    name = next(f"_{k}" for k in range(len(docs.columns) + 1) if f"_{k}" not in docs.columns)
    bad = staged(_found(docs, F.md5("text").alias("__text"), benchmark, q, rate, segment, part_bytes, quote).select(F.col("__text").alias(name)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_TEXTS else bad
    return docs.withColumn(name, F.md5("text")).join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
