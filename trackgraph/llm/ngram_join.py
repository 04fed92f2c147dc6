"""N-gram Jaccard join over a token-group matrix.

A document's set holds the hashes (64 bits) of its distinct runs of ``width`` words, A-Z in lower case. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The components are exact: every step below only skips pairs that cannot link or whose ends
are already connected. So only a spanning set of the links is computed; neither all links nor a document's number of links is.

1. Equal sets become one node (the smallest doc_id), so a group of copies of any size is one row from here on.
2. Each node keeps a prefix: its first ``n - ceil(n * percent / 100) + 1`` tokens in a global order (those of one document first,
   then by the number of documents, as far as tables of a fixed size tell, then by hash). Two linking sets share a prefix token,
   whatever the order. Of the prefix only tokens are stored that may be in two documents; counts of all tokens tell those that are not.
3. Nodes are partitioned into groups of similar documents (first shared prefix token and size band, split into blocks of
   ``block`` documents); documents of a block, and the head of its family, are compared in one task, and linked blocks merge.
4. The matrix: groups are now the components so far, and the unlinked documents of each block, which need no second comparison
   with each other. Each group stores its union of prefix tokens, its size range and a bitmap of its union of all tokens. Groups
   that share a token meet in an equi-join if their sizes and the tokens after the shared one allow enough overlap. They meet once
   and not at every shared token: a row of the matrix also holds the ``EARLIER`` tokens of its group before it, and two rows with a
   common earlier token met there already. (For that, sizes and overlaps of a row are those of its token and all later ones; a large
   group's tokens are dealt to lanes, each in order by itself.) A member of the smaller group is a query on the other: its tokens outside the
   group's bitmap bound the overlap, first on 1024 bits, then on bitmaps as wide as the sets need, and only qualifying groups are
   opened, block by block.

Defined cases: a text that is null or without words has an empty set, links with nothing and is its own component; a null doc_id
has a null component; rows that share a doc_id are one document id and hence one component; ties need no rule; columns of the
input other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackgraph.functions.storage import scratch, staged
from trackgraph.llm.groups import join_groups
from trackgraph.llm.textblocks import blocks, mix, shingle_hashes, words
from trackgraph.operators.components import connected_components

WORDS_OF_BITS = 16
#: Ids that may be broadcast: 8 bytes each. Beyond it the sets are fetched by a shuffle join.
BROADCAST_IDS = 400_000
#: Tokens before a token that its row of the matrix holds, and members of a group for each lane. Fewer only make groups meet more often.
EARLIER = 16
LANE_MEMBERS = 4096
#: The order of tokens: rows, buckets (cells) of a row, bits that tell a row's tokens apart (3 bytes each between tasks).
ROW_BITS, CELL_BITS, PLACE_BITS = 12, 10, 24
ROWS, CELLS = 1 << ROW_BITS, 1 << CELL_BITS
BUCKETS = ROWS * CELLS
#: Levels of the order: the documents of a token that reach it, and bits of a row's cells at it. 10.5 MB in all.
LEVELS = [(2, 14), (4, 12), (16, 10)]
#: Ranks of one level. Those of tokens that reach no level are smaller.
ONE_LEVEL = 32
#: Tokens that a task gathers before it hands them on.
TOKENS_A_BATCH = 1 << 21
#: Bytes of sets that a Python task holds before it hands them on.
BATCH_BYTES = 8 << 20


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, number of tokens, sorted distinct tokens)`` for every row."""
    for first, data, offsets in blocks(texts):
        value, row = shingle_hashes(words(data, offsets, lower=True), width)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        at = np.searchsorted(row, np.arange(len(offsets)))
        for r in range(len(offsets) - 1):
            yield first + r, at[r + 1] - at[r], value[at[r] : at[r + 1]]


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap with twice as many bits as tokens at least, a power of two."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    flags = np.zeros(width, bool)
    flags[tokens & np.uint64(width - 1)] = True
    return np.packbits(flags)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of the same tokens with fewer bits."""
    return bits if len(bits) == width else np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def _or(maps: list[bytes]) -> bytes:
    arrays = [np.frombuffer(m, np.uint8) for m in maps]
    width = min(len(a) for a in arrays)
    return np.bitwise_or.reduce([_folded(a, width) for a in arrays]).tobytes()


def _union_maps(rows: DataFrame) -> DataFrame:
    """``part, union``: the bitmaps of each part's rows (``part, bits``) in one. Each batch is summed before the shuffle."""

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(part, []).append(bits)
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([_or(x) for x in by.values()], pa.binary())], ["part", "bits"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"][:1], "union": pa.array([_or(table["bits"].to_pylist())], pa.binary())})

    return rows.select("part", "bits").mapInArrow(batch_sums, "part long, bits binary").groupBy("part").applyInArrow(total, "part long, union binary")


def _qualify(rows: DataFrame, percent: int) -> DataFrame:
    """``component, answers, node, n, size`` of the rows whose ``bits`` lie inside ``union`` but for as many as a link allows."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, a, b in zip(*(batch.column(c).to_pylist() for c in ("n", "bits", "union"))):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                width = min(len(a), len(b))
                outside = np.bitwise_count(_folded(a, width) & ~_folded(b, width)).sum()
                keep.append(outside <= n - least_overlap(n, percent))
            yield batch.select(["component", "answers", "node", "n", "size"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(check, "component long, answers long, node long, n long, size long")


def least_overlap(n, percent: int):
    """Fewest common tokens of a set of n tokens with any set it links with."""
    return -(-n * percent // 100)


@dataclass
class TokenOrder:
    """Rows by the ``ROW_BITS`` bits of a token above its ``CELL_BITS`` last ones.

    ``ranks``: binary digits of the number of tokens in each bucket, a token's last bits. ``reached``: for each level of ``LEVELS`` bits
    for which a token of that cell is in so many documents. ``room``: cells of a row whose tokens the first level covers.
    """

    ranks: np.ndarray
    reached: list[np.ndarray]
    room: np.ndarray

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        """Levels reached, then digits. Tokens in one document come first, if the first level covers them; others count as shared."""
        row, at = _place(tokens)
        cell, level = at >> CELL_BITS, np.zeros(len(tokens), np.int64)
        some = np.arange(len(tokens))
        for k, (flags, (_, bits)) in enumerate(zip(self.reached, LEVELS)):
            c = cell[some] & ((1 << bits) - 1)
            hit = flags[row[some], c >> 3] >> (c & 7) & 1 > 0
            if k == 0:
                hit |= (at & (CELLS - 1)) >= self.room[row]
            some = some[hit]
            level[some] = k + 1
        return (ONE_LEVEL * level + np.minimum(self.ranks[row * CELLS + (at & (CELLS - 1))], ONE_LEVEL - 1)).astype(np.int8)


def _place(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token's row and its place of ``PLACE_BITS`` bits in it: its last ``CELL_BITS`` bits, and above them those beyond the row's."""
    t = tokens.view(np.int64)
    beyond = (t >> (CELL_BITS + ROW_BITS)) & ((1 << (PLACE_BITS - CELL_BITS)) - 1)
    return (t >> CELL_BITS) & (ROWS - 1), beyond << CELL_BITS | t & (CELLS - 1)


def token_order(docs: DataFrame, width: int) -> TokenOrder:
    """The order of tokens by the number of their documents. Every token of every document is counted, by 36 of its bits.

    Any order gives the same links; this one keeps shared phrases out of prefixes. A token below the first level is in one row of ``docs``. Each row's tokens are counted in a task of their own,
    and only the tables come to the driver, which have the same size for any number of documents. In a row with more shared tokens than
    cells the first level covers a part of the tokens, chosen by their bits.
    """

    def packed(sets: list[np.ndarray]) -> pa.RecordBatch:
        row, at = _place(np.concatenate(sets))
        key = np.sort(row << PLACE_BITS | at)
        ends = np.searchsorted(key, np.arange(ROWS + 1) << PLACE_BITS)
        full = np.flatnonzero(np.diff(ends))
        data = np.ascontiguousarray(key.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        offsets = (3 * np.append(ends[full], ends[-1])).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["row", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, n, tokens in _sets(batch.column(0), width):
                if n:
                    held.append(tokens)
                    size += int(n)
                if size > TOKENS_A_BATCH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def total(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table["places"].to_pylist()), np.uint8).reshape(-1, 3)
        at = np.zeros((len(raw), 4), np.uint8)
        at[:, :3] = raw
        at, n = np.unique(at.view("<u4").reshape(-1), return_counts=True)
        digits = np.frexp(np.bincount(at & (CELLS - 1), n, CELLS))[1].astype(np.int8)
        shared = np.count_nonzero(n >= LEVELS[0][0])
        room = min(CELLS, max(1, (CELLS << LEVELS[0][1]) // max(shared, 1)))
        out = {"row": table["row"][:1], "ranks": pa.array([digits.tobytes()], pa.binary()), "room": pa.array([room], pa.int32())}
        for k, (least, bits) in enumerate(LEVELS):
            take = (n >= least) & ((at & (CELLS - 1)) < room) if k == 0 else n >= least
            flags = np.zeros(1 << bits, bool)
            flags[(at[take] >> CELL_BITS) & ((1 << bits) - 1)] = True
            out[f"level{k}"] = pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())
        return pa.table(out)

    levels = [f"level{k}" for k in range(len(LEVELS))]
    schema = "row int, ranks binary, room int, " + ", ".join(f"{x} binary" for x in levels)
    found = docs.select("text").mapInArrow(gather, "row int, places binary").groupBy("row").applyInArrow(total, schema).toArrow()
    ranks, room = np.zeros((ROWS, CELLS), np.int8), np.full(ROWS, CELLS, np.int32)
    reached = [np.zeros((ROWS, (1 << bits) // 8), np.uint8) for _, bits in LEVELS]
    rows = found["row"].to_numpy()
    room[rows] = found["room"].to_numpy()
    for name, table in zip(["ranks", *levels], [ranks, *reached]):
        for row, x in zip(rows, found[name]):
            table[row] = np.frombuffer(x.as_buffer(), table.dtype)
    return TokenOrder(ranks.reshape(-1), reached, room)


def token_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """The rank of each bucket of tokens: the binary digits of the number of its tokens in all documents, each once a document."""
    return token_order(docs, width).ranks


def sketches(docs: DataFrame, width: int, percent: int, order: TokenOrder | Broadcast, lone: bool = True) -> DataFrame:
    """``doc_id, n, s1, s2, prefix, ranks, places, bits, b0..b15``: size, 128-bit digest, prefix tokens with ranks and places, and bitmaps of each set.

    Without ``lone``, prefix tokens go that ``order`` knows to be in one row of ``docs`` only, so no other row's prefix holds them. The
    others keep their places.
    """
    shared = order if isinstance(order, Broadcast) else docs.sparkSession.sparkContext.broadcast(order)
    bits = [f"b{i}" for i in range(WORDS_OF_BITS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            size = len(batch)
            n, s1, s2 = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            bitmap, prefix, levels, wide = np.zeros((size, WORDS_OF_BITS), np.uint64), [None] * size, [None] * size, [b""] * size
            places = [None] * size
            for r, count, tokens in _sets(batch.column(1), width):
                n[r] = count
                if not count:
                    continue
                s1[r], s2[r] = np.sum(mix(tokens), dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens + np.uint64(17)))
                flags = np.zeros(64 * WORDS_OF_BITS, bool)
                flags[tokens & np.uint64(64 * WORDS_OF_BITS - 1)] = True
                bitmap[r] = np.packbits(flags).view(np.uint64)
                wide[r] = _bitmap(tokens).tobytes()
                take = count - least_overlap(int(count), percent) + 1
                rank = order.rank(tokens)
                first = np.argsort(rank, kind="stable")
                tokens, rank = tokens[first][:take], rank[first][:take]
                place = np.flatnonzero(lone | (rank >= ONE_LEVEL))
                prefix[r], levels[r], places[r] = _signed(tokens[place]), rank[place], place.astype(np.int32)
            out = [batch.column(0), pa.array(n), pa.array(_signed(s1)), pa.array(_signed(s2)), pa.array(prefix, pa.list_(pa.int64())), pa.array(levels, pa.list_(pa.int8())), pa.array(places, pa.list_(pa.int32())), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(_signed(np.ascontiguousarray(bitmap[:, i]))) for i in range(WORDS_OF_BITS)], ["doc_id", "n", "s1", "s2", "prefix", "ranks", "places", "bits", *bits])

    schema = "doc_id long, n long, s1 long, s2 long, prefix array<long>, ranks array<byte>, places array<int>, bits binary, " + ", ".join(f"{b} long" for b in bits)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, schema)


def _with_sets(work: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``work`` rows with the whole token set of their node; sets are made from the texts of the needed documents only."""
    ids = work.select("node").distinct()
    need = staged(ids, "ids")
    source = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    side = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    source = source.join(side, "node", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, first = [], 0, 0
            for r, n, tokens in _sets(batch.column(1), width):
                out.append(tokens.tobytes())
                size += 8 * int(n)
                if size > BATCH_BYTES or r + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), pa.array(out, pa.binary())], ["node", "tokens"])
                    out, size, first = [], 0, r + 1

    return work.join(source.mapInArrow(make, "node long, tokens binary"), "node")


def _compare(work: DataFrame, percent: int, inner: bool = True) -> DataFrame:
    """Links found inside each work item.

    ``work`` has (item, role, node, part, tokens); role 0 rows are compared with each other if ``inner``, role 1 rows with the role 0 rows.
    ``part`` is the component known so far (null: unknown): pairs already in one component are skipped.
    A work item holds a bounded number of documents.
    """

    def block(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["role", "node"], kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in frame["tokens"]]
        n = np.array([len(x) for x in sets])
        boss = list(range(len(sets)))

        def top(i: int) -> int:
            while boss[i] != i:
                boss[i] = boss[boss[i]]
                i = boss[i]
            return i

        known: dict = {}
        for i, p in enumerate(frame["part"]):
            if p == p and p is not None:
                boss[i] = top(known.setdefault(p, i))
        node, role = frame["node"].to_numpy(), frame["role"].to_numpy()
        members = int((role == 0).sum())
        found: list[tuple[int, int]] = []
        for i in range(0 if inner else members, len(sets)):
            for j in range(min(i, members)):
                small, large = (n[i], n[j]) if n[i] < n[j] else (n[j], n[i])
                if 100 * small < percent * large or node[i] == node[j] or top(i) == top(j):
                    continue
                common = n[i] + n[j] - len(np.union1d(sets[i], sets[j])) if small else 0
                if small and 100 * common >= percent * (n[i] + n[j] - common):
                    boss[top(i)] = top(j)
                    found.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return work.groupBy("item").applyInArrow(block, "a long, b long")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 128) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``. Only this table stays in the shared folder."""
    with scratch(docs.sparkSession) as kept:
        return kept(_components(docs, width, percent, block), "ngram-components")


def _components(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    bits = [f"b{i}" for i in range(WORDS_OF_BITS)]
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(token_order(docs, width))
    rows = staged(sketches(docs, width, percent, order, lone=False), "sketches")
    order.destroy()  # else the driver holds its blocks through all steps below
    total = rows.count()
    same = rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("group_rows"))
    same = staged(same, "same")
    full = rows.select("s1", "s2", "n", F.col("doc_id").alias("node"), "prefix", "ranks", "places", "bits", *bits).join(same.drop("group_rows"), ["s1", "s2", "n", "node"]).dropDuplicates(["s1", "s2", "n", "node"])
    full = staged(full.drop("s1", "s2"), "nodes")

    # prefix tokens that two nodes or more share
    # reach: most tokens that a set has in common with another one if this is the first common one
    exploded = full.select("node", "n", F.explode(F.arrays_zip("prefix", "ranks", "places")).alias("at"))
    exploded = exploded.select("node", "n", F.col("at.prefix").alias("token"), F.col("at.ranks").alias("rank"), (F.col("n") - F.col("at.places")).alias("reach"))
    shared = exploded.groupBy("token").count().where("count > 1").select("token")
    tokens = staged(exploded.join(shared, "token"), "tokens")

    # families of similar nodes, in blocks
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    key = tokens.groupBy("node", "n").agg(F.min("token").alias("key")).withColumn("band", band)
    family = key.groupBy("key", "band").agg(F.count("*").alias("members"), F.min(F.struct("node")).getField("node").alias("head")).where("members > 1")
    cut = F.ceil(F.col("members") / F.lit(block))
    placed = staged(key.join(family, ["key", "band"]).withColumn("item", F.xxhash64("key", "band", F.pmod(F.xxhash64("node"), cut))), "families")
    item = placed.select("item", F.lit(0).alias("role"), "node").unionByName(placed.where("members > " + str(block)).select("item", F.lit(0).alias("role"), F.col("head").alias("node"))).distinct()
    first_links = staged(_compare(_with_sets(item.withColumn("part", F.lit(None).cast("long")), docs, width), percent), "links")
    parts = connected_components(first_links)

    # the matrix: groups are the components so far
    alone = placed.join(parts, "node", "left_anti").select("node", "item").distinct()
    rest = alone.join(alone.groupBy("item").agg(F.min("node").alias("rest")), "item").select("node", "rest")
    grouped = full.join(parts, "node", "left").join(rest, "node", "left")
    grouped = grouped.withColumn("part", F.coalesce("component", "rest", "node")).drop("rest", "prefix", "ranks", "places")
    grouped = staged(grouped, "grouped")
    unions = grouped.groupBy("part").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), *[F.bit_or(b).alias(b) for b in bits])
    unions = staged(unions, "unions")
    by_token = tokens.join(grouped.select("node", "part").distinct(), "node").groupBy("token", "part").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"), F.first("rank").alias("rank"))
    by_token = staged(by_token, "by_token")
    several = by_token.groupBy("token").count().where("count > 1").select("token")
    large = staged(unions.where(F.col("size") > LANE_MEMBERS).select("part", F.ceil(F.col("size") / F.lit(LANE_MEMBERS)).alias("lanes")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    laned = by_token.join(several, "token", "left_semi").join(large, "part", "left")
    laned = laned.withColumn("lane", F.coalesce(F.pmod(F.xxhash64("token"), F.col("lanes")), F.lit(0))).drop("lanes")
    later = Window.partitionBy("part", "lane").orderBy(F.desc("rank"), F.expr("token < 0").desc(), F.desc("token"))
    from_here, before = later.rowsBetween(Window.unboundedPreceding, 0), later.rowsBetween(1, EARLIER)
    matrix = staged(laned.select(
        "token", "part", F.min("low").over(from_here).alias("low"), F.max("high").over(from_here).alias("high"),
        F.max("reach").over(from_here).alias("reach"), F.collect_list("token").over(before).alias("earlier")), "matrix")
    left, right = matrix.alias("l"), matrix.alias("r")
    enough = percent * F.greatest("l.low", "r.low")
    fits = (100 * F.least("l.high", "r.high") >= enough) & (100 * F.least("l.reach", "r.reach") >= enough)
    new = ~F.arrays_overlap("l.earlier", "r.earlier")
    meet = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.part") < F.col("r.part")) & fits & new)
    meet = staged(meet.select(F.col("l.part").alias("p"), F.col("r.part").alias("q")).distinct(), "meet")

    # the smaller group asks, the other answers
    sizes = unions.select("part", "size")
    asked = meet.join(sizes.select(F.col("part").alias("p"), F.col("size").alias("ps")), "p").join(sizes.select(F.col("part").alias("q"), F.col("size").alias("qs")), "q")
    asks = F.col("ps") <= F.col("qs")
    asked = asked.select(F.when(asks, F.col("p")).otherwise(F.col("q")).alias("asks"), F.when(asks, F.col("q")).otherwise(F.col("p")).alias("answers"))
    query = grouped.select(F.col("part").alias("asks"), "node", "n", "component", *[F.col(b).alias("q" + b) for b in bits])
    open_ = asked.join(query, "asks").join(unions.withColumnRenamed("part", "answers"), "answers")
    outside = sum((F.bit_count(F.col("q" + b).bitwiseAND(F.bitwise_not(b))) for b in bits), F.lit(0))
    open_ = open_.where((outside <= F.col("n") - F.ceil(F.col("n") * percent / 100)) & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low")))
    open_ = staged(open_.select("component", "answers", "node", "n", "size"), "bounded")
    answers = grouped.select("part", "bits").join(open_.select(F.col("answers").alias("part")).distinct(), "part", "left_semi")
    wide = open_.join(grouped.select("node", "n", "bits"), ["node", "n"]).join(_union_maps(answers).withColumnRenamed("part", "answers"), "answers")
    open_ = staged(_qualify(wide, percent), "opened")
    cuts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    seats = staged(open_.groupBy("answers", "size").agg(F.count("*").alias("queries")).withColumn("cuts", cuts).withColumn("turns", F.ceil(F.col("queries") / F.lit(block)).cast("int")), "seats")
    name = F.xxhash64("answers", "cut", "turn").alias("item")
    queries = open_.join(seats.drop("size"), "answers").withColumn("turn", F.pmod(F.xxhash64("node"), F.col("turns")).cast("int")).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    queries = queries.select(name, F.lit(1).alias("role"), "node", F.col("component").alias("part"))
    members = grouped.select(F.col("part").alias("answers"), "node", "component").join(seats, "answers").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    members = members.select(name, F.lit(0).alias("role"), "node", F.col("component").alias("part"))
    more_links = _compare(_with_sets(staged(queries.unionByName(members).distinct(), "work"), docs, width), percent, inner=False)
    links = staged(first_links.unionByName(more_links), "links")

    final = connected_components(links)
    named = same.join(final, "node", "left").select("s1", "s2", "n", "group_rows", F.coalesce("component", "node").alias("c"))
    member = join_groups(rows.where("n > 0 and doc_id is not null").select("doc_id", "s1", "s2", "n"), staged(named, "named"), ["s1", "s2", "n"], total)
    whole = member.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is the smallest of its component, all columns kept; rows with a null doc_id stay.

    Of rows that share doc_id and text one stays (the least hash of the row); other texts of that doc_id stay as well.
    """
    found = ngram_components(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    order = Window.partitionBy("doc_id", F.xxhash64("text"), F.md5("text")).orderBy(whole)
    place = next(f"_{k}" for k in range(len(docs.columns) + 1) if f"_{k}" not in docs.columns)
    once = kept.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
