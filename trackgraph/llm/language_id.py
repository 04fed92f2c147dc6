"""Language identification by word-first backoff.

Words are runs of letters in lower case. A known word adds its log frequency in each language; an unseen word falls back to its
longest character n-grams (with word boundaries) of which any is known, then to shorter ones, and adds the mean of their log
frequencies. The language with the largest sum wins; the score is its share after a softmax of the sums.

The model is fitted on a hash sample of the labelled rows, of about ``sample_rows`` rows and ``sample_bytes`` bytes of text at most,
and keeps every word of the sample and every n-gram of these words. So its size is bounded by the sample's (words and n-grams have
entries only for languages they were seen in) and it can be broadcast. Counting runs on Spark; the driver holds the counts as Arrow
and NumPy arrays only, and each Python worker makes the lookup by text from them.

Defined cases: a text that is null or has no letters gives ``und`` with score 0, as does a model without labelled rows; rows with
a null lang or text are not learned from; a tie goes to the language whose code sorts first; a null doc_id is scored like any
other; repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackgraph.functions.storage import staged

#: Runs of letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 4
UNKNOWN = "und"


@dataclass
class Logs:
    """Log frequencies of units by language: those of an unseen unit, and what each unit adds to them where it was seen."""

    names: pa.Array
    unseen: np.ndarray
    first: np.ndarray
    language: np.ndarray
    added: np.ndarray

    @cached_property
    def index(self) -> dict[str, int]:
        """Places of the units by their text. Made where it is used; a broadcast model goes without it."""
        return {x: i for i, x in enumerate(self.names.to_pylist())}

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "index"}

    def total(self, units: list[int], times: list[int]) -> np.ndarray:
        """Sum of the units' log frequencies, each as often as ``times`` says, by language."""
        at, times = np.array(units), np.array(times, float)
        n = self.first[at + 1] - self.first[at]
        pick = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
        return times.sum() * self.unseen + np.bincount(self.language[pick], self.added[pick] * np.repeat(times, n), len(self.unseen))


@dataclass
class WordModel:
    """Languages in order of their codes, log frequencies of words, and of n-grams by length from 1 on."""

    languages: list[str]
    words: Logs
    grams: list[Logs]


def grams_of(word: str, n: int) -> list[str]:
    framed = f"<{word}>"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _logs(counts: pa.Table, languages: list[str]) -> Logs:
    """``counts`` has one row of lang, unit and n for each unit of each language."""
    counts = counts.sort_by([("unit", "ascending"), ("lang", "ascending")]).combine_chunks()
    language = pc.index_in(counts["lang"], pa.array(languages, counts["lang"].type)).to_numpy()
    unit, n = counts["unit"], counts["n"].to_numpy().astype(float)
    new = np.ones(len(unit) + 1, bool)
    if len(unit):
        new[1:-1] = pc.not_equal(unit[1:], unit[:-1]).to_numpy()
    names = unit.filter(pa.array(new[:-1])).combine_chunks()
    unseen = np.log(0.5) - np.log(np.bincount(language, n, len(languages)) + 0.5 * max(len(names), 1))
    return Logs(names, unseen, np.flatnonzero(new), language, np.log(n + 0.5) - np.log(0.5))


def fit(labelled: DataFrame, sample_rows: int = 20_000, sample_bytes: int = 32 << 20) -> WordModel:
    """``labelled`` has text and lang. Counts the words and n-grams of a bounded sample by language on Spark and gathers the counts."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(1.0, sample_rows / max(size.rows, 1), sample_bytes / max(size.bytes or 0, 1))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(share * 1_000_003))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if flat:
                lang, unit, n = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(unit), pa.array(n, pa.int64())], ["lang", "unit", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(word, k):
                        found[lang, k, g] += n
            if found:
                lang, k, unit = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(k, pa.int32()), pa.array(unit), pa.array(list(found.values()), pa.int64())], ["lang", "k", "unit", "n"])

    words = staged(rows.mapInArrow(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(spell, "lang string, k int, unit string, n long").groupBy("lang", "k", "unit").agg(F.sum("n").alias("n")).toArrow()
    words = words.toArrow()
    languages = sorted(pc.unique(words["lang"]).to_pylist())
    by_length = [grams.filter(pc.equal(grams["k"], k)) for k in range(1, LONGEST_GRAM + 1)]
    return WordModel(languages, _logs(words, languages), [_logs(x, languages) for x in by_length])


class Scorer:
    """Scores texts with a model; remembers what unseen words added, up to a bound."""

    def __init__(self, model: WordModel, remember: int = 200_000):
        self.model, self.remember, self.memory = model, remember, {}

    def backoff(self, word: str) -> np.ndarray | None:
        if word in self.memory:
            return self.memory[word]
        m, found = self.model, None
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            known = m.grams[n - 1].index
            at = [i for g in grams_of(word, n) if (i := known.get(g)) is not None]
            if at:
                found = m.grams[n - 1].total(at, [1] * len(at)) / len(at)
                break
        if len(self.memory) >= self.remember:
            self.memory.clear()
        self.memory[word] = found
        return found

    def score(self, text: str | None) -> tuple[str, float]:
        m = self.model
        counts = Counter(LETTERS.findall(text.lower())) if text else None
        if not counts or not m.languages:
            return UNKNOWN, 0.0
        known = m.words.index
        at = [(i, n) for w, n in counts.items() if (i := known.get(w)) is not None]
        total = np.zeros(len(m.languages))
        if at:
            total += m.words.total(*zip(*at))
        if len(at) < len(counts):
            for w, n in counts.items():
                if w not in known and (x := self.backoff(w)) is not None:
                    total += n * x
        best = int(np.argmax(total))
        share = np.exp(total - total[best])
        return m.languages[best], float(1 / share.sum())


def identify(docs: DataFrame, model: WordModel, *keep: str | Column) -> DataFrame:
    """``lang_pred, score`` of every row's whole text, after the columns ``keep`` (a struct column may hold names of any kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("__text"))
    names = source.columns[:-1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(len(names))]
            lang, score = [x for x, _ in found], [y for _, y in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return source.mapInArrow(predict, T.StructType(source.schema.fields[:-1]).add("lang_pred", T.StringType()).add("score", T.DoubleType()))
