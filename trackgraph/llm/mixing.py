"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Each source has a target number of words; a document of it is to be taken ``target / source size`` times on average. The whole
part of that is taken for sure; the fraction is rounded by the pivotal method: two documents at a time trade mass (size times
fraction) in a random direction until one fraction is 0 or 1, which keeps the source's expected words and each document's expected
copies. What is left of a chunk goes on to the next level of a tree of chunks, up to one document of each source, which is drawn.
Documents with more than 1/64 of their source's words (fewer than 64 of a source) are rounded first, the largest against each other;
what they then take too much or too little is taken from, or added to, the fractions of the others. That keeps the expectations and
leaves at most 1/64 of the source between its words and its target. Where the others' fractions could make up for only one outcome of
the last large document, it gets that outcome; where for none, the nearer one, and the rest of the difference stays.

Targets: the budget is shared by weight; a source stops at ``most`` times its size and its excess is reshared by weight.

Defined cases: a null text has size 0 and is taken 0 words; null sources are one source, last in order; rows that share doc_id and
source are one item with their joint size and take the same copies; null doc_ids of a source are one item; other columns do not
matter; an empty table gives an empty result; a total size of 0 gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged

SEPARATORS = "\t\n\x0b\x0c\r"
CHUNK = 64
#: A document is large if it has more than this part of its source's words.
LARGE = 1 / 64
#: A table of one row for each source is broadcast up to this many sources.
BROADCAST_SOURCES = 200_000


def count_words(text: Column) -> Column:
    """Number of runs of other characters than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(F.translate(text, SEPARATORS, " " * 5), " "), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, sid, source_size, target`` from rows with ``source`` and ``size``; one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    sid = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    order = everything.orderBy(F.col("limit") / F.col("weight"), "sid")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    table = by.withColumn("sid", sid).withColumn("weight", weight).withColumn("limit", limit)
    table = table.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    table = table.withColumns({"spent": F.coalesce(F.sum("limit").over(upto), F.lit(0.0)), "heavy": F.sum("weight").over(after)})
    table = table.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("heavy"))
    full = F.col("limit") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~full, F.struct(F.col("limit") / F.col("weight"), F.col("sid"), F.col("level")))).over(everything).getField("level")
    return table.select("source", "sid", "source_size", F.when(full, F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def _fold() -> Column:
    """One pass over ``items``: pairs the residual with each next item; gives the residual and the decided items."""
    draw = lambda a, b: F.pmod(F.xxhash64(a["id"], b["id"], F.col("sid"), F.lit("pair")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    item = lambda x, p: F.struct(x["id"].alias("id"), x["size"].alias("size"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["rest"]
        ratio = x["size"] / a["size"]
        up, down = F.least(1 - a["p"], x["p"] * ratio), F.least(a["p"], (1 - x["p"]) * ratio)  # mass in fractions of a
        rise = F.when(up + down > 0, draw(a, x) * (up + down) < down).otherwise(F.lit(True))
        a_first = F.when(rise, 1 - a["p"] <= x["p"] * ratio).otherwise(a["p"] <= (1 - x["p"]) * ratio)
        left = F.when(rise & a_first, x["p"] - (1 - a["p"]) / ratio).when(rise, a["p"] + x["p"] * ratio).when(a_first, x["p"] + a["p"] / ratio).otherwise(a["p"] - (1 - x["p"]) * ratio)
        left = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))
        extra = F.when(rise == a_first, 1).otherwise(0)
        rest = F.when(a_first, item(x, left)).otherwise(item(a, left))
        done = F.struct(F.when(a_first, a["id"]).otherwise(x["id"]).alias("id"), extra.alias("extra"))
        return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(done)).alias("done"))

    first = F.element_at("items", 1)
    start = F.struct(item(first, first["p"]).alias("rest"), F.expr("cast(array() as array<struct<id: bigint, extra: int>>)").alias("done"))
    return F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step)


def _with_source(items: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """``items`` and the row of their source in ``table`` (``n`` rows, one for each sid)."""
    return items.join(F.broadcast(table) if n <= BROADCAST_SOURCES else table, "sid")


def _drawn(last: DataFrame, room: DataFrame | None) -> DataFrame:
    """``sid, id, extra`` of the last item of each source, drawn; but if only one outcome fits into ``room`` (``sid, up, down``), that one."""
    draw = F.pmod(F.xxhash64("id", "sid", F.lit("last")), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("p")
    if room is not None:
        last = last.join(room, "sid", "left")
        lacks = F.greatest(F.lit(0.0), F.col("p") * F.col("size") - F.coalesce("up", F.lit(0.0)))  # if it is not taken
        tops = F.greatest(F.lit(0.0), (1 - F.col("p")) * F.col("size") - F.coalesce("down", F.lit(0.0)))  # if it is
        draw = F.when(lacks > tops, True).when(tops > lacks, False).otherwise(draw)
    return last.select("sid", "id", F.when(draw, 1).otherwise(0).alias("extra"))


def rounded(items: DataFrame, counts: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """``sid, id, extra`` (0 or 1) for items ``sid, id, size, p`` with 0 < p < 1 and size > 0; ``counts``: items n of each sid, one row for each source.

    ``room``: words that can still be added and taken away elsewhere in each source after the last item is drawn.
    """
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    largest, sources = counts.agg(F.max("n"), F.count("*")).first()
    now = _with_source(items, counts, sources).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), chunks)).drop("n")
    largest = largest or 0
    chunks_left, out = -(-largest // CHUNK), None
    while True:
        grouped = now.groupBy("sid", "chunk").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), F.xxhash64("id").alias("h"), "id", "size", "p"))).alias("items"))
        done = staged(grouped.select("sid", "chunk", _fold().alias("f")), "pivots")
        decided = done.select("sid", F.explode("f.done").alias("d")).select("sid", "d.id", "d.extra")
        out = decided if out is None else out.unionByName(decided)
        now = done.select("sid", F.floor(F.col("chunk") / F.lit(CHUNK)).alias("chunk"), "f.rest.*")
        if chunks_left <= 1:
            break
        chunks_left = -(-chunks_left // CHUNK)
    return out.unionByName(_drawn(now, room))


def _rounded_large_first(items: DataFrame) -> DataFrame:
    """:func:`rounded`, with the fractions of documents of at most ``most`` words moved by what the larger ones took too much."""
    count = lambda rows: rows.groupBy("sid").agg(F.count("*").alias("n"))
    large, small = items.where("size > most").drop("most"), items.where("size <= most").drop("most")
    sums = staged(small.groupBy("sid").agg(F.sum("size").alias("mass"), F.sum(F.col("size") * F.col("p")).alias("down")), "mass")
    first = staged(rounded(large, count(large), sums.select("sid", (F.col("mass") - F.col("down")).alias("up"), "down")), "large")
    same = (F.col("sid") == F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
    over = large.join(first.select(F.col("sid").alias("s"), F.col("id").alias("i"), "extra"), same).groupBy("sid").agg(F.sum(F.col("size") * (F.col("extra") - F.col("p"))).alias("over"))
    mass = staged(sums.drop("down").join(over, "sid", "left"), "moved")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.coalesce("over", F.lit(0.0)) / F.col("mass")))
    moved = staged(_with_source(small, mass, mass.count()).select("sid", "id", "size", p.alias("p")).where("p > 1e-9"), "small")
    return first.unionByName(rounded(moved, count(moved)))


def copies_of(slim: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for rows ``doc_id, source, size``. Read several times: stage it."""
    targets = staged(source_targets(slim, weights, share, most), "targets")
    rows = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"whole": F.floor(rate + 1e-12).cast("int"), "p": rate - F.floor(rate + 1e-12)})
    items = rows.groupBy("sid", F.col("doc_id").alias("id")).agg(F.sum("size").cast("double").alias("size"), F.first("p").alias("p"), (F.first("source_size") * LARGE).alias("most"))
    items = staged(items.where("size > 0 and p > 1e-9"), "items")
    extra = _rounded_large_first(items)
    joined = rows.join(extra.select(F.col("sid").alias("s"), "id", "extra"), (F.col("sid") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def mix_table(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, and its ``copies``."""
    slim = staged(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    out = copies_of(slim, list(weights), share, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    slim = staged(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")
    taken = copies_of(slim, list(weights), share, most).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("copies").alias("__copies")).distinct()
    same = docs["doc_id"].eqNullSafe(taken["__id"]) & docs["source"].eqNullSafe(taken["__source"])
    return docs.join(taken, same).withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[f"`{c}`"] for c in docs.columns])
