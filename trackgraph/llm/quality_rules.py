"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Every rule compares an integer statistic with ``cutoff * n_words / 100``. The good documents of a labelled holdout are dealt to two
halves by the checksum of their id. In each stratum (language) the first half proposes levels: for each of the ``BUDGETS``, every
rule takes its strictest cutoff that rejects at most that share of the half. Levels grow stricter. The second half tests them in
that fixed order, each by the exact binomial bound on the false rejections of all rules together: a level is certified if
P(Binomial(n, risk) <= rejected) <= delta / strata, and testing stops at the first that is not. Testing in a fixed order needs no
correction for the number of levels, and the rules of a level are tested as one; Bonferroni corrects for the strata. The last
certified level is used; a stratum without one (fewer than about 90 good documents in its half cannot have one at risk 0.05) rejects
nothing. So with probability 1 - delta no stratum loses more than the share ``risk`` of its good documents to the rules.

Words are runs of other characters than space and 0x09-0x0D. Defined cases: a null text has no words and fails the base rule;
null languages form a stratum; labels without a matching document, and documents without a label, do not matter for thresholds;
a doc_id labelled more than once is good if all its labels are; null doc_ids match no label; repeated rows are judged alike; an
empty table gives an empty result, and without labels no threshold is certified; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged

SEPARATORS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rule: (statistic, reject above, cutoffs in hundredths per word from strict to lax)
RULES: dict[str, tuple[str, bool, list[int]]] = {
    "symbols": ("n_symbols", True, [5, 10, 20, 40, 80, 160]),
    "dup_lines": ("n_dup_lines", True, [1, 2, 4, 8, 16]),
    "repeats": ("n_repeat_words", True, [10, 20, 30, 40]),
    "long_words": ("word_chars", True, [700, 800, 900, 1000, 1200, 1600]),
    "short_words": ("word_chars", False, [350, 300, 250, 200]),
}
#: Shares of good documents that a single rule of a level may reject in the proposing half.
BUDGETS = [0.0, 0.0025, 0.005, 0.01, 0.015, 0.02, 0.03]
#: Strata that may be broadcast with their cutoffs.
BROADCAST_STRATA = 100_000


def _repeat_words(n: Column, words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = lambda s, i: F.get(s, i).getField("h")
        again = lambda s: F.filter(s, lambda x, i: (x["h"] == at(s, i - 1)) | (x["h"] == at(s, i + 1)))
        hit = F.element_at(F.transform(F.array(pairs), again), 1)
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    of = F.transform(F.array(window), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 3, F.lit(0)).otherwise(F.element_at(of, 1)).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of whole texts, after the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, SEPARATORS, " " * 5)
    rows = docs.select(*keep, text.alias("__t"), F.array_remove(F.split(blank, " "), "").alias("__w"))
    solid = F.translate(F.col("__t"), SEPARATORS + " ", "")
    lines = F.filter(F.split("__t", "\n"), lambda x: F.translate(x, SEPARATORS + " ", "") != "")
    rows = rows.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(solid).cast("long"),
        "n_symbols": (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"),
    })
    rows = rows.withColumn("n_repeat_words", _repeat_words(F.size("__w"), F.col("__w"))).drop("__t", "__w")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rejects(statistic: str, above: bool, cutoff) -> Column:
    left, right = 100 * F.col(statistic), cutoff * F.col("n_words")
    return left > right if above else left < right


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by 10; to about 1e-13 for x >= 1."""
    y = x + 10.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    shift = sum((F.log(x + float(j)) for j in range(1, 10)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n * p. Terms farther than 60 + 12 standard deviations below k are under double precision."""
    k, n = k.cast("double"), n.cast("double")
    span = F.least(k, 60 + F.ceil(12 * F.sqrt(n * p))).cast("int")
    term = lambda i: F.exp(_log_gamma(n + 1) - _log_gamma(i + 1) - _log_gamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return F.aggregate(F.sequence(F.lit(0), span), F.lit(0.0), lambda a, j: a + term(k - j.cast("double")))


def proposing(doc_id: str = "doc_id") -> Column:
    """Whether a labelled document proposes levels (else it tests them)."""
    return F.md5(F.col(doc_id).cast("string").cast("binary")) < "8"


def levels(held: DataFrame) -> DataFrame:
    """``stratum, level`` (from 0) and the cutoff ``cut_<rule>`` of each rule (null: none) as proposed by the rows of ``held``."""
    tests = [(rule, stat, above, rank, c) for rule, (stat, above, cuts) in RULES.items() for rank, c in enumerate(cuts)]
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(rejects(stat, above, c).cast("long")).alias(f"{rule}_{rank}") for rule, stat, above, rank, c in tests])

    def strictest(rule: str, budget: float) -> Column:
        return F.coalesce(*[F.when(F.col(f"{rule}_{rank}") <= F.lit(budget) * F.col("n"), F.lit(c)) for rank, c in enumerate(RULES[rule][2])])

    own = [F.struct(F.lit(k).alias("level"), *[strictest(rule, b).alias(f"cut_{rule}") for rule in RULES]) for k, b in enumerate(BUDGETS)]
    return counted.select("stratum", F.explode(F.array(*own)).alias("l")).select("stratum", "l.*")


def rejected() -> Column:
    """Whether any rule with a cutoff rejects a row with the statistics and the columns ``cut_<rule>``."""
    bad = F.lit(False)
    for rule, (stat, above, _) in RULES.items():
        bad = bad | F.coalesce(rejects(stat, above, F.col(f"cut_{rule}")), F.lit(False))
    return bad


def _small(strata: DataFrame) -> DataFrame:
    return F.broadcast(strata) if strata.count() <= BROADCAST_STRATA else strata


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum, level`` and the cutoffs of its last certified level. ``stats`` has doc_id, stratum and the statistics."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = staged(stats.where("not base_failed").join(good, "doc_id", "left_semi").withColumn("proposing", proposing()), "held")
    proposed = staged(levels(held.where("proposing")), "levels")
    tested = held.where("not proposing").join(_small(proposed), "stratum").groupBy("stratum", "level").agg(F.count("*").alias("n"), F.sum(rejected().cast("long")).alias("rejected"))
    strata = proposed.agg(F.countDistinct("stratum").alias("strata"))
    p = F.when(F.col("rejected") <= F.col("n") * risk, binomial_cdf(F.col("rejected"), F.col("n"), risk)).otherwise(F.lit(1.0))
    sure = tested.crossJoin(F.broadcast(strata)).withColumn("sure", p <= F.lit(delta) / F.col("strata"))  # one row on the right side
    so_far = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    last = sure.withColumn("all", F.min("sure").over(so_far)).where("all").groupBy("stratum").agg(F.max("level").alias("level"))
    return proposed.join(last, ["stratum", "level"])


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed, stratum, kept`` of every row."""
    stats = docs.select("doc_id", "text", F.coalesce(F.col("lang"), F.lit("(none)")).alias("stratum"))
    stats = staged(statistics(stats, "doc_id", "stratum"), "statistics")
    cuts = staged(thresholds(stats, labels, risk, delta), "cutoffs")
    out = stats.join(_small(cuts), "stratum", "left")
    return out.select(*stats.columns, (~F.col("base_failed") & ~rejected()).alias("kept"))
