"""Sharding by balanced label propagation (DataFrame operations only).

Vertices are rows, edges link rows that should share a shard; a label is a shard. Linked vertices start evenly spread. In each
round a vertex counts its neighbours' labels and asks for the most frequent one; requests are admitted in a fixed order up to the
target shard's free quota, so no shard ever holds more linked vertices than its quota. Vertices that move in a round are never
neighbours of each other: those above all their neighbours, those below all of them, and, where a graph has vertices in between,
those whose hash in that round is the smallest among their neighbours take turns. So each move saves cut edges, and rounds go on
until no kind of turn moves a vertex. Rows without links then fill what is left of the quotas, which makes the sizes even.
Law ``rows``: the quotas, and so the counts, are at most one apart.

Edges of documents with equal texts are stars: each row of a group is linked with its first row, and a group larger than half a
quota is dealt to as many stars as needed.

Defined cases: a null text has size 16 and crc32 null, and is linked with nothing; null or repeated doc_ids are rows of their own;
repeated rows are linked like all equal texts; columns other than doc_id and text are passed through by :func:`sharded` under any
name, but for those of result columns, which are replaced; an empty table gives an empty result; with fewer rows than shards
some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged
from trackgraph.llm.groups import join_groups
from trackgraph.llm.ranks import ranked

RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _at(values: list[int], key: str):
    """The entry of a short list at column ``key``."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(key) + 1)


def _held(labels: DataFrame, shards: int) -> list[int]:
    rows = dict(labels.groupBy("shard").count().collect())  # one row for each shard
    return [rows.get(s, 0) for s in range(shards)]


def propagated(linked: DataFrame, edges: DataFrame, quotas: list[int]) -> DataFrame:
    """``vid, shard`` for the vertices of ``linked`` (``vid, h``: unique id and hash), moved along ``edges`` (``a, b``)."""
    shards, total = len(quotas), linked.count()
    start = ranked(linked, [], F.col("h"), ["vid"])
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    ends, around = both.count(), both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count("*").alias("group_rows"))
    turns = 3 if around.where("least < a and a < most").take(1) else 2  # stars have no vertices in between
    first = start.select("vid", F.floor(F.col("rank") * shards / F.lit(max(total, 1))).cast("int").alias("shard"))
    labels = staged(first.join(around.select(F.col("a").alias("vid"), "group_rows"), "vid", "left"), "labels")
    k = idle = 0
    while idle < turns:
        # a vertex with many neighbours is broadcast to its edges
        near = join_groups(both, labels.withColumnRenamed("vid", "b"), ["b"], ends)
        votes = near.groupBy("a", "shard").agg(F.count("*").alias("n"), F.min("b").alias("least"), F.max("b").alias("most"), F.min(F.xxhash64("b", F.lit(k))).alias("hash"))
        wish = votes.groupBy("a").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("to"))).alias("best"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("hash").alias("hash"),
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by"))  # at most one entry for each shard
        turn = [F.col("most") < F.col("a"), F.col("a") < F.col("least"), F.xxhash64("a", F.lit(k)) < F.col("hash")][k % turns]
        ask = wish.where(turn).join(labels.withColumnRenamed("vid", "a"), "a").select(
            F.col("a").alias("vid"), (-F.col("best.to")).alias("to"), "least",
            (F.col("best.n") - F.coalesce(F.col("by")[F.col("shard")], F.lit(0))).alias("gain"))
        ask = staged(ask.where("gain > 0").select("vid", "to", "least"), "asks")
        free = [q - h for q, h in zip(quotas, _held(labels, shards))]
        moved = ranked(ask, ["to"], F.xxhash64("least.h"), ["least", "vid"]).where(F.col("rank") < _at(free, "to"))
        moved = staged(moved.select("vid", "to"), "moves")
        k, idle = k + 1, 0 if moved.take(1) else idle + 1
        if not idle:
            labels = staged(labels.join(moved, "vid", "left").select("vid", F.coalesce("to", "shard").alias("shard"), "group_rows"), "labels")
    return labels.select("vid", "shard")


def equal_text_stars(rows: DataFrame, most: int) -> DataFrame:
    """Edges ``a, b`` between rows (``vid, key``) with equal keys; a group of more than ``most`` rows forms several stars."""
    total = rows.count()
    groups = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    groups = staged(groups.withColumn("stars", F.ceil(F.col("group_rows") / F.lit(most))), "groups")
    dealt = join_groups(rows, groups, ["key"], total).select("vid", "key", F.pmod(F.xxhash64("vid"), F.col("stars")).alias("star"))
    dealt = staged(dealt, "dealt")
    hubs = staged(dealt.groupBy("key", "star").agg(F.min("vid").alias("b"), F.count("*").alias("group_rows")), "hubs")
    return join_groups(dealt, hubs, ["key", "star"], total).where("vid <> b").select(F.col("vid").alias("a"), "b")


def assigned(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (with ``vid, key, h``) and their ``shard`` and ``slot``. Read several times: stage it first."""
    total = rows.count()
    quotas = _quotas(total, shards)
    edges = staged(equal_text_stars(rows.select("vid", "key"), max(1, total // shards // 2)), "stars")
    ends = edges.select(F.col("a").alias("vid")).unionByName(edges.select(F.col("b").alias("vid"))).distinct()
    linked = staged(rows.select("vid", "h").join(ends, "vid", "left_semi"), "linked")
    labels = propagated(linked, edges, quotas)
    left, bounds = 0, []
    for q, h in zip(quotas, _held(labels, shards)):
        left += q - h
        bounds.append(left)
    rest = ranked(rows.select("vid", "h").join(labels, "vid", "left_anti"), [], F.col("h"), ["vid"])
    over = sum((F.when(F.col("rank") >= b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    placed = staged(labels.unionByName(rest.select("vid", over.cast("int").alias("shard"))), "placed")
    slots = ranked(placed, ["shard"], F.xxhash64("vid.h"), ["vid"], name="slot")
    return rows.join(slots, "vid")


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """``vid, key, h, size, text_crc32`` and the columns ``keep`` of every row, written once so that vid stays fixed.

    vid is ordered by a hash of doc_id and text, so only rows that share both depend on partitions, and they can stand for each other.
    """
    text = F.col("text")
    crc = F.crc32(F.encode(text, "utf-8"))
    slim = docs.select("doc_id", *[c for c in keep if c != "doc_id"], (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"), crc.alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    h = F.xxhash64("doc_id", "key")
    slim = slim.withColumn("h", h).withColumn("vid", F.struct("h", F.monotonically_increasing_id().alias("row")))
    return staged(slim.drop("doc_id") if "doc_id" not in keep else slim, "described")


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    out = assigned(described(docs, "doc_id"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All columns of ``docs`` and the result columns of :func:`shard_table`."""
    keep = [c for c in docs.columns if c not in RESULT]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"))
    out = assigned(described(packed, "__row"), shards)
    return out.select("__row.*", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
