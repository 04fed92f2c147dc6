"""Line deduplication by a deletion-neighbourhood join.

A line is what stands between newlines and has a word; A-Z count as a-z and runs of white space as one space. Edits are words
inserted, deleted or replaced: two lines of ``least_words`` words or more are copies if one edit at most turns one into the other.
Pairs with a shorter line are copies if one character (of UTF-8) inserted, deleted or replaced at most turns one into the other;
with ``short_edits`` = 0 such pairs have to be equal. A line goes if an earlier line (smaller doc_id, then line number) is a copy of it, whether
that one stays or not. Edit bounds above one word or one character are not offered.

1. Equal lines become one row with their first place.
2. A line within one edit of another shares its first or its last half with it, so only lines with a shared half go on.
3. These emit hashed keys for all variants: the line itself, the line without its word i (it meets lines that are one word
   shorter), and the line without its word i, tagged with i and the length (it meets lines that differ in word i).
   Lines of at most ``least_words`` words (a space may be the character) do the same with their characters, halves included.
4. Equal variants are joined by their earliest line: within a tagged key all lines are copies of each other, and an untagged key
   holds one line and the longer lines that contain it, so the earliest of either kind decides and no pairs are made.
5. The edit distance of each line and its earlier partner is verified on their words or characters.

Defined cases: null texts and lines without words have no lines; rows that share a doc_id are ordered by the hash of the text, and
rows that repeat doc_id and text count as one; null doc_ids come last; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged
from trackgraph.llm.textblocks import blocks, mix, powers, words

_LAST = (1 << 63) - 1
#: Line places that may be broadcast (16 bytes each); beyond it texts are fetched by a shuffle join.
BROADCAST_PLACES = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = int(powers(2)[1])
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))
#: Keeps keys of characters apart from keys of words.
_CHARACTER = np.uint64(0x632BE59BD9B4E018)


def _rows_of_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets that cut the block at newlines too, and the row of each piece."""
    breaks = np.flatnonzero(data == 10)
    cuts = np.concatenate([offsets[:-1], breaks])
    order = np.argsort(cuts, kind="stable")
    cuts = cuts[order]
    row = np.cumsum(order < len(offsets) - 1) - 1
    return np.r_[cuts, len(data)].astype(np.int64), row


class _Lines:
    """Hashes of the lines of a block. number counts a text's lines with words from 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        at, row = _rows_of_lines(data, offsets)
        self.words = w = words(data, at, lower=True)
        n = np.diff(w.first)
        self.keep = np.flatnonzero(n > 0)
        self.row, self.n = row[self.keep], n[self.keep]
        self.start, self.end = at[self.keep], at[self.keep + 1]
        starts = np.r_[True, self.row[1:] != self.row[:-1]] if len(self.row) else np.zeros(0, bool)
        place = np.arange(len(self.row))
        self.number = place - np.maximum.accumulate(np.where(starts, place, 0)) if len(place) else place
        self.begin = w.first[:-1][self.keep]
        inside = np.arange(len(w.hash)) - np.repeat(self.begin, self.n)
        self.power = powers(int(self.n.max()) + 2 if len(self.n) else 2)
        self.sums = np.r_[np.uint64(0), np.cumsum(w.hash * self.power[inside], dtype=np.uint64)]
        self.other = np.r_[np.uint64(0), np.cumsum(mix(w.hash + inside.astype(np.uint64)), dtype=np.uint64)]

    def total(self, begin, end):
        return self.sums[end] - self.sums[begin]


def content(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(total + n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class _Characters:
    """Hashes of the characters of chosen lines of a block, words joined by one space. n counts a line's characters."""

    def __init__(self, data: np.ndarray, x: _Lines, pick: np.ndarray):
        raw, lines = data.tobytes(), []
        for k in pick.tolist():
            lines.append(b" ".join(raw[x.start[k] : x.end[k]].translate(_LOWER).split()).decode("utf-8", "surrogateescape"))
        self.n = np.array([len(t) for t in lines], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inside = np.arange(len(code)) - np.repeat(self.begin, self.n)
        self.power = powers(int(self.n.max()) + 2 if len(self.n) else 2)
        self.sums = np.r_[np.uint64(0), np.cumsum(mix(code + _CHARACTER) * self.power[inside], dtype=np.uint64)]

    total = _Lines.total


def _halves(total, begin: np.ndarray, n: np.ndarray, tag: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Hashes of the first and last halves, both ways of rounding, of lines of ``n`` units from ``begin``."""
    end, halves = begin + n, []
    for h in (n // 2, (n - 1) // 2):
        head = mix(total(begin, begin + h) + mix(h.astype(np.uint64) * np.uint64(2) + tag))
        tail = mix(total(end - h, end) * _inverse_powers(n - h) + mix(h.astype(np.uint64) * np.uint64(2) + np.uint64(1) + tag))
        halves += [head, tail]
    return np.stack(halves, axis=1).view(np.int64)


def _keys(total, begin: np.ndarray, n: np.ndarray, pick: np.ndarray, tag: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, kinds and lines of all variants of the lines ``pick`` of ``n`` units from ``begin``."""
    end = begin + n
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    b, e, m = np.repeat(begin, n), np.repeat(end, n), np.repeat(n, n)
    less = total(b, b + i) + total(b + i + 1, e) * _BACK
    key = [content(total(begin, end) + tag, n), content(less + tag, m - 1), mix(less + tag + mix(i.astype(np.uint64) * np.uint64(1 << 32) + m.astype(np.uint64)))]
    kind = [np.zeros(len(pick), np.int64), np.ones(len(i), np.int64), np.full(len(i), 2)]
    return np.concatenate(key), np.concatenate(kind), np.concatenate([pick, np.repeat(pick, n), np.repeat(pick, n)])


def line_table(docs: DataFrame, least_words: int, short_edits: int) -> DataFrame:
    """``doc, th, line, n, c1, c2, halves``: place, words, content hashes and hashed halves (of lines with variants) of every line."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(2)):
                x = _Lines(data, offsets)
                if not len(x.row):
                    continue
                end = x.begin + x.n
                c1 = content(x.total(x.begin, end), x.n)
                c2 = mix(x.other[end] - x.other[x.begin] + x.n.astype(np.uint64))
                long = np.flatnonzero(x.n >= least_words)
                table, who = [_halves(x.total, x.begin[long], x.n[long])], [np.repeat(long, 4)]
                if short_edits:
                    short = np.flatnonzero(x.n <= least_words)
                    c = _Characters(data, x, short)
                    table.append(_halves(c.total, c.begin, c.n, _CHARACTER))
                    who.append(np.repeat(short, 4))
                who = np.concatenate(who)
                values = np.concatenate([t.ravel() for t in table])[np.argsort(who, kind="stable")]
                at = np.r_[0, np.cumsum(np.bincount(who, minlength=len(x.row)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(values))
                rows = pa.array(x.row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.number.astype(np.int64)), pa.array(x.n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], ["doc", "th", "line", "n", "c1", "c2", "halves"])

    return docs.mapInArrow(make, "doc long, th long, line long, n long, c1 long, c2 long, halves array<long>")


def _inverse_powers(n: np.ndarray) -> np.ndarray:
    most = int(n.max()) if len(n) else 0
    table = np.cumprod(np.r_[np.uint64(1), np.full(most, _BACK)], dtype=np.uint64)
    return table[n]


def _variants(docs: DataFrame, wanted: DataFrame, least_words: int, short_edits: int) -> DataFrame:
    """``key, kind, doc, th, line, text`` of the wanted lines (``doc, th, lines``); kind 0: itself, 1: one word less, 2: tagged.

    The text goes with kind 0 only.
    """
    need = wanted.groupBy("doc", "th").agg(F.collect_set("line").alias("lines"))  # at most the lines of one document

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for first, data, offsets in blocks(batch.column(2)):
                x = _Lines(data, offsets)
                if not len(x.row):
                    continue
                chosen = np.zeros(len(x.row), bool)
                base = np.searchsorted(x.row, np.arange(len(offsets) - 1))
                for r in range(len(offsets) - 1):
                    chosen[base[r] + lists[first + r].values.to_numpy()] = True
                pick = np.flatnonzero(chosen)
                long = pick[x.n[pick] >= least_words]
                key, kind, who = _keys(x.total, x.begin[long], x.n[long], long)
                if short_edits:
                    short = pick[x.n[pick] <= least_words]
                    c = _Characters(data, x, short)
                    key, kind, who = (np.concatenate(pair) for pair in zip((key, kind, who), _keys(c.total, c.begin, c.n, short, _CHARACTER)))
                raw = data.tobytes()
                own = np.flatnonzero(kind == 0)
                text = pa.array([raw[x.start[k] : x.end[k]].translate(_LOWER) for k in who[own].tolist()], pa.binary())
                place = np.full(len(key), -1)
                place[own] = np.arange(len(own))
                row = pa.array(x.row[who] + first)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), batch.column(0).take(row), batch.column(1).take(row), pa.array(x.number[who].astype(np.int64)), text.take(pa.array(place, mask=place < 0))], ["key", "kind", "doc", "th", "line", "text"])

    need = staged(need, "places")
    side = F.broadcast(need) if wanted.count() <= BROADCAST_PLACES else need
    joined = docs.join(side, ["doc", "th"]).select("doc", "th", "text", "lines")
    return joined.mapInArrow(make, "key long, kind int, doc long, th long, line long, text binary")


def within_one_edit(a: Sequence, b: Sequence) -> bool:
    """Whether one unit (word of a list, character of a text) inserted, deleted or replaced at most turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def are_copies(x: list[bytes], y: list[bytes], least_words: int, short_edits: int) -> bool:
    """Whether two lines, given by their words, are copies of each other."""
    if min(len(x), len(y)) >= least_words:
        return within_one_edit(x, y)
    if not short_edits:
        return x == y
    return within_one_edit(*(b" ".join(w).decode("utf-8", "surrogateescape") for w in (x, y)))


def _verified(pairs: DataFrame, least_words: int, short_edits: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [are_copies(x.split(), y.split(), least_words, short_edits) for x, y in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist())]
            yield batch.select(["doc", "th", "line"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(check, "doc long, th long, line long").distinct()


def removed_lines(docs: DataFrame, least_words: int = 8, short_edits: int = 1) -> DataFrame:
    """``doc, th, n_lines, removed`` (sorted line numbers, null if none) of every document that has lines."""
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    lines = staged(line_table(source, least_words, short_edits), "lines")
    place = F.struct("doc", "th", "line")
    groups = lines.groupBy("c1", "c2", "n").agg(F.min(place).alias("first"))
    groups = staged(groups.select("c1", "c2", "n", "first.*"), "groups")
    distinct = lines.where(F.size("halves") > 0).join(groups, ["c1", "c2", "n", "doc", "th", "line"]).dropDuplicates(["doc", "th", "line"])
    halves = distinct.select("doc", "th", "line", F.explode(F.array_distinct("halves")).alias("half"))
    common = halves.groupBy("half").count().where("count > 1").select("half")
    wanted = staged(halves.join(common, "half", "left_semi").select("doc", "th", "line").distinct(), "wanted")
    variants = staged(_variants(source, wanted, least_words, short_edits).dropDuplicates(["key", "kind", "doc", "th", "line"]), "variants")
    slim = variants.select("key", "kind", "doc", "th", "line")
    best = slim.groupBy("key").agg(F.count("*").alias("count"), *[F.min(F.when(F.col("kind") == k, place)).alias(f"k{k}") for k in (0, 1, 2)]).where("count > 1").drop("count")
    met = slim.join(best, "key")
    partner = F.when(F.col("kind") == 2, F.col("k2")).when(F.col("kind") == 1, F.col("k0")).otherwise(F.col("k1"))
    pairs = met.withColumn("p", partner).where(F.col("p") < place).select("doc", "th", "line", F.col("p.doc").alias("d2"), F.col("p.th").alias("t2"), F.col("p.line").alias("l2")).distinct()
    pairs = staged(pairs, "pairs")  # few rows; the shuffles of all variants end here, before those of all lines begin
    texts = variants.where("kind = 0").dropDuplicates(["doc", "th", "line"]).select("doc", "th", "line", "text")  # lines of least_words words are twice there
    other = texts.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), F.col("line").alias("l2"), F.col("text").alias("other"))
    near = _verified(pairs.join(texts, ["doc", "th", "line"]).join(other, ["d2", "t2", "l2"]), least_words, short_edits)
    near = staged(near, "near").withColumn("near", F.lit(True))
    verdict = groups.join(near, ["doc", "th", "line"], "left").select("c1", "c2", "n", F.struct("doc", "th", "line").alias("first"), "near")
    judged = lines.join(verdict, ["c1", "c2", "n"]).withColumn("gone", F.coalesce("near", F.lit(False)) | (place != F.col("first")))
    judged = judged.select("doc", "th", "line", "gone").distinct()
    return judged.groupBy("doc", "th").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))


def line_report(docs: DataFrame, least_words: int = 8, short_edits: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, removed`` (numbers of the lines with words that go, from 0)."""
    found = removed_lines(docs, least_words, short_edits)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"))
    out = rows.join(found, ["doc", "th"], "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<bigint>)"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, least_words: int = 8, short_edits: int = 1) -> DataFrame:
    """``docs`` with the kept lines, joined by newlines, as text; lines without words go too. Null texts stay null."""
    found = removed_lines(docs, least_words, short_edits).select("doc", "th", "removed")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("th"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, "\t\x0b\x0c\r ", "") != "")
    kept = F.transform(F.array(lines), lambda a: F.filter(a, lambda x, i: ~F.coalesce(F.array_contains("removed", i.cast("long")), F.lit(False))))
    out = packed.join(found, ["doc", "th"], "left").withColumn("text", F.array_join(F.element_at(kept, 1), "\n"))
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
