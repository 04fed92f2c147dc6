"""Substring deduplication over super-k-mers of words.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash among its runs of ``_RUN`` words.
Consecutive windows with one minimiser travel together as one packed string (their words, joined by spaces) to the bucket of the
minimiser, so a word is sent about three times and not ``width`` times. Equal strings of one pack are sent once: the later
ones are already known to be repeats. In a bucket, equal strings are joined first; the windows of the rest are sorted by hash and
position, neighbours with equal hashes are compared word by word, and all but the earliest window of a run are repeats. The words
that repeated windows cover are then removed from their documents.

A window is a repeat if its word sequence also starts earlier: in a smaller doc_id, or in the same document at a smaller
position. Windows are judged on the input, not on what is left of it.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a null doc_id counts as larger than any other;
rows that share a doc_id but not the text are ordered by the hash of the text; rows that repeat doc_id and text are one document
and all get its result; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged
from trackgraph.llm.textblocks import Words, blocks, mix, spaced, words

_RUN = 3
#: Windows of one string at most: longer runs of one minimiser are cut, and their parts go to the same bucket.
_LONGEST = 64
#: Bytes of text for each bucket, and of super-k-mers that a task holds before it packs them.
BUCKET_BYTES = 4 << 20
PACK_BYTES = 48 << 20
_LAST = (1 << 63) - 1


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of every ``n`` consecutive ones."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def super_windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of every super-k-mer of a block."""
    h = w.hash
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, np.zeros(0, np.uint64)
    run = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
    least = _sliding_least(run, width - _RUN + 1)
    left = np.repeat(w.first[1:], np.diff(w.first))[: len(least)] - np.arange(len(least))
    at = np.flatnonzero(left >= width)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (w.row[at[1:]] != w.row[at[:-1]])
    place = np.arange(len(at))
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    new |= since % _LONGEST == 0
    first = np.flatnonzero(new)
    return at[first], np.diff(np.r_[first, len(at)]), value[first]


def _pack(kind: int, *arrays: np.ndarray, text: bytes = b"") -> bytes:
    parts = [a.astype(np.int64).tobytes() for a in arrays]
    return zstandard.compress(struct.pack("<4q", kind, len(arrays), len(arrays[0]), len(text)) + b"".join(parts) + text, 3)


def _unpack(blob: bytes) -> tuple[int, list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    kind, count, size, length = struct.unpack_from("<4q", raw)
    body = np.frombuffer(raw, np.int64, count * size, 32).reshape(count, size)
    return kind, list(body), raw[len(raw) - length :] if length else b""


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """One row per document with its merged word ranges; ``doc`` holds ``_LAST`` for a null id."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], (start + size)[order]
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64()))], ["doc", "th", "lo", "hi"])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    opens = new.copy()
    opens[1:] |= start[1:] > reach[:-1]
    lo_at = np.flatnonzero(opens)
    hi = np.maximum.reduceat(end, lo_at)
    docs_at = np.flatnonzero(new[lo_at])
    offsets = pa.array(np.r_[docs_at, len(lo_at)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start[lo_at], hi)]
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(key[new]), *lists], ["doc", "th", "lo", "hi"])


def _words(texts: list[bytes]) -> tuple[bytes, Words]:
    """The texts one after another, each a row, and their words; only a block's arrays are held besides."""
    body, parts, at, row = b"".join(texts), [], 0, 0
    for _, data, offsets in blocks(pa.array(texts, pa.large_binary())):
        w = words(data, offsets)
        parts.append(Words(w.start + at, w.end + at, w.row + row, w.first[1:] + (parts[-1].first[-1] if parts else 0), w.hash))
        at, row = at + len(data), row + len(offsets) - 1
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return body, Words(join("start"), join("end"), join("row"), np.r_[0, join("first")], join("hash"))


class _Pack:
    """Super-k-mers of a batch, equal strings once with their earliest place."""

    def __init__(self):
        self.text, self.who, self.start, self.size, self.bucket, self.seen, self.again, self.bytes = [], [], [], [], [], {}, [], 0

    def add(self, x: bytes, place: tuple[int, int, int], row: int, size: int, bucket: int, doc: list, th: list) -> None:
        k = self.seen.get(x)
        if k is None:
            self.seen[x] = len(self.text)
            self.text.append(x)
            self.who.append(row)
            self.start.append(place[2])
            self.size.append(size)
            self.bucket.append(bucket)
            self.bytes += len(x)
            return
        now = (doc[self.who[k]], th[self.who[k]], self.start[k])
        if place < now:
            self.again.append((self.who[k], self.start[k], size))
            self.who[k], self.start[k] = row, place[2]
        elif place > now:
            self.again.append((row, place[2], size))

    def out(self, doc: np.ndarray, th: np.ndarray, buckets: int) -> pa.RecordBatch:
        """A packed string for each bucket, and the ranges that are known to be repeats."""
        names, blobs = [], []
        if self.text:
            who, start, size, bucket = (np.array(x, np.int64) for x in (self.who, self.start, self.size, self.bucket))
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            for a, b in zip(cut, np.r_[cut[1:], len(order)]):
                own = order[a:b]
                names.append(int(bucket[own[0]]))
                blobs.append(_pack(0, doc[who[own]], th[who[own]], start[own], size[own], text=b"\n".join(self.text[i] for i in own.tolist())))
        if self.again:
            r, s, n = np.array(self.again, np.int64).T
            for part in np.array_split(np.arange(len(r)), -(-len(r) // 20_000)):
                names.append(int((th[r[part[0]]] + part[0]) % buckets))
                blobs.append(_pack(1, doc[r[part]], th[r[part]], s[part], n[part]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _send(width: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            docs, ths, pack = doc.tolist(), th.tolist(), _Pack()
            for first, data, offsets in blocks(batch.column(2)):
                w = words(data, offsets)
                at, count, least = super_windows(w, width)
                if len(at):
                    body, pos = spaced(data, w)
                    body, row = body.tobytes(), w.row[at]
                    ends = pos[at + count + width - 1] - 1
                    for r, s, a, b, n, m in zip((row + first).tolist(), (at - w.first[row]).tolist(), pos[at].tolist(), ends.tolist(), (count + width - 1).tolist(), (least % np.uint64(buckets)).tolist()):
                        pack.add(body[a:b], (docs[r], ths[r], s), r, n, m, docs, ths)
                if pack.bytes > PACK_BYTES:
                    yield pack.out(doc, th, buckets)
                    pack = _Pack()
            yield pack.out(doc, th, buckets)

    return send


def _repeats(width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        text, doc, th, start, size = [], [], [], [], []
        for batch in batches:
            for blob in batch.column(1):
                kind, (d, t, s, n), raw = _unpack(blob.as_buffer())
                if kind:
                    yield _ranges(d, t, s, n)
                    continue
                later: list[tuple[int, int, int, int]] = []
                for x, *own in zip(raw.split(b"\n"), d.tolist(), t.tolist(), s.tolist(), n.tolist()):
                    k = seen.get(x)
                    if k is None:
                        seen[x] = len(text)
                        text.append(x)
                        doc.append(own[0])
                        th.append(own[1])
                        start.append(own[2])
                        size.append(own[3])
                        continue
                    now = (doc[k], th[k], start[k])
                    if tuple(own[:3]) < now:
                        later.append((*now, own[3]))
                        doc[k], th[k], start[k] = own[:3]
                    elif tuple(own[:3]) > now:
                        later.append(tuple(own))
                if later:
                    yield _ranges(*np.array(later, np.int64).T)
        if not text:
            return
        seen.clear()
        body, w = _words(text)
        del text
        h = w.hash
        value = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            value = mix(value + h[k : k + len(value)] + np.uint64(k))
        left = np.repeat(w.first[1:], np.diff(w.first))[: len(value)] - np.arange(len(value))
        at = np.flatnonzero(left >= width)
        own = w.row[at]
        doc_, th_, start_ = (np.array(x, np.int64)[own] for x in (doc, th, start))
        start_ = start_ + at - w.first[own]
        order = np.argsort(value[at], kind="stable")
        same = np.flatnonzero(np.diff(value[at][order]) == 0)
        if not len(same):
            return
        mark = np.zeros(len(order), bool)
        mark[same] = mark[same + 1] = True
        order = order[mark]  # only windows that share their hash are sorted by position
        order = order[np.lexsort((start_[order], th_[order], doc_[order], value[at][order]))]
        value = value[at][order]
        head = np.maximum.accumulate(np.where(np.r_[True, value[1:] != value[:-1]], np.arange(len(order)), 0))
        repeat = np.flatnonzero(head != np.arange(len(order)))
        one, two = order[repeat], order[head[repeat]]
        bytes_of = lambda i: body[w.start[at[i]] : w.end[at[i] + width - 1]]
        equal = np.fromiter((bytes_of(i) == bytes_of(j) for i, j in zip(one.tolist(), two.tolist())), bool, len(one))
        equal &= (doc_[one] != doc_[two]) | (th_[one] != th_[two]) | (start_[one] != start_[two])
        one = one[equal]
        yield _ranges(doc_[one], th_[one], start_[one], np.full(len(one), width))

    return find


def repeated_ranges(docs: DataFrame, width: int) -> DataFrame:
    """``doc, th, lo, hi``: for documents with repeated windows, arrays of the word ranges they cover (ranges may overlap)."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    sent = source.mapInArrow(_send(width, buckets), "bucket int, blob binary")
    found = sent.repartitionById(buckets, "bucket").mapInArrow(_repeats(width), "doc long, th long, lo array<long>, hi array<long>")
    return found.groupBy("doc", "th").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text`` (the kept words, joined by one space)."""
    return _apply(docs, width, "kept_text string", lambda kept: kept.decode("utf-8", "replace"))


def without_repeats_digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """As :func:`without_repeats`, with ``kept_sha256``, the SHA-256 of the kept words' UTF-8 bytes, for the text."""
    return _apply(docs, width, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _apply(docs: DataFrame, width: int, column: str, form) -> DataFrame:
    ranges = staged(repeated_ranges(docs, width), "ranges")
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    joined = source.join(ranges, ["doc", "th"], "left").select(F.col("doc_id").cast("long"), "text", "lo", "hi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column(2), batch.column(3)
            n_words, n_removed, out = [], [], []
            for first, data, offsets in blocks(batch.column(1)):
                w = words(data, offsets, hashes=False)
                body, pos = spaced(data, w)
                for r in range(len(offsets) - 1):
                    a, b = w.first[r], w.first[r + 1]
                    n = int(b - a)
                    gone = np.zeros(n + 1, np.int64)
                    if lo[first + r].is_valid:
                        np.add.at(gone, lo[first + r].values.to_numpy(), 1)
                        np.add.at(gone, hi[first + r].values.to_numpy(), -1)
                        drop = np.cumsum(gone)[:n] > 0
                        kept = body[pos[a] : pos[b]][np.repeat(~drop, np.diff(pos[a : b + 1]))]
                        n_removed.append(int(drop.sum()))
                    else:
                        kept = body[pos[a] : pos[b]]
                        n_removed.append(0)
                    n_words.append(n)
                    out.append(form(kept.tobytes()[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", column.split()[0]])

    return joined.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {column}")
