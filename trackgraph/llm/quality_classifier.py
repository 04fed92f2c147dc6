"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees hashed words and word endings of the whole text; the metadata view sees source, language, recorded length and
layout (lines, line lengths), never the words. Both are logistic regressions, fitted on a bounded sample of labelled documents. In
each round both views score all unlabelled documents on Spark, and the ones a view is most confident about, in the proportion of the
labels, are given with its labels to the other view's training set. Each view is calibrated on a held-out fold of the labelled
sample; a logistic combination of the calibrated views, fitted on another fold, scores all documents.

The labelled sample (``labelled_rows``), the documents exchanged in a round and the feature counts are bounded parameters; only hashed
features of these documents reach the driver. Samples and folds are chosen by hashes and put in order of them, so the model does not
depend on partitions or the order of tasks.

Defined cases: a null text has no words (its text view is the bias alone); null source, lang and n_chars are values of their own;
labels without document, with a null value or of a repeated doc_id with differing values are not learned from; with labels of one
kind only, or none, every score is the share of good labels (1 without labels); ties, repeated rows and null doc_ids are scored like
any other row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgraph.functions.storage import staged
from trackgraph.llm.textblocks import blocks, mix, words

TEXT_BITS, META_BITS = 15, 10
#: Parts of the labelled sample; one calibrates the views, one fits their combination, the others are learned from.
FOLDS = 6
#: The combination starts from the mean of both views (slopes and intercept) and moves from it as the labels tell.
MEAN = (0.5, 0.5, 0.0)
_INPUT = ["text", "source", "lang", "n_chars"]


@dataclass
class Sparse:
    """Rows of hashed features: ``at`` holds the first entry of each row."""

    at: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """One sum for each row, the same whatever rows stand beside it."""
        out, some = np.zeros(len(self.at) - 1), np.flatnonzero(np.diff(self.at))
        if len(some):
            out[some] = np.add.reduceat(weights[self.feature] * self.value, self.at[some])
        return out

    def rows(self, pick: np.ndarray) -> Sparse:
        size = np.diff(self.at)[pick]
        at = np.r_[0, np.cumsum(size)]
        entry = np.arange(at[-1]) - np.repeat(at[:-1] - self.at[pick], size)
        return Sparse(at, self.feature[entry], self.value[entry])


def _counted(row: np.ndarray, feature: np.ndarray, rows: int, bits: int) -> Sparse:
    key, count = np.unique(row.astype(np.int64) << bits | feature.astype(np.int64), return_counts=True)
    row, value = key >> bits, np.log1p(count)
    at = np.searchsorted(row, np.arange(rows + 1))
    norm = np.sqrt(np.bincount(row, value * value, minlength=rows))
    return Sparse(at, (key & ((1 << bits) - 1)).astype(np.int32), (value / norm[row]).astype(np.float32) if len(row) else value.astype(np.float32))


def text_features(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Hashed words, and hashed last three bytes of words."""
    w = words(data, offsets, lower=True)
    if not len(w.hash):
        return _counted(np.zeros(0, np.int64), np.zeros(0, np.int64), len(offsets) - 1, TEXT_BITS)
    tail = sum(np.where(w.end - k > w.start, data[np.maximum(w.end - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k) for k in (1, 2, 3))
    shift = np.uint64(64 - TEXT_BITS)
    return _counted(np.r_[w.row, w.row], np.r_[mix(w.hash) >> shift, mix(tail) >> shift], len(offsets) - 1, TEXT_BITS)


def _named(values: list, tag: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import zlib

    known: dict = {}
    code = [known.setdefault(v, zlib.crc32(f"{tag}:{v!r}".encode())) for v in values]
    return row, np.array(code, np.uint64)


def meta_features(source: list, lang: list, n_chars: list, data: np.ndarray, offsets: np.ndarray) -> Sparse:
    rows = len(offsets) - 1
    row = np.arange(rows)
    size = np.diff(offsets)
    lines = np.add.reduceat(np.r_[data == 10, [False]], np.minimum(offsets[:-1], len(data))) if rows else np.zeros(0)
    lines = np.where(size > 0, lines, 0) + 1
    bucket = lambda x: np.floor(2 * np.log2(np.maximum(x, 0) + 1)).astype(int).tolist()
    length = [None if c is None else int(2 * np.log2(max(c, 0) + 1)) for c in n_chars]
    parts = [_named(v, k, row) for k, v in enumerate([source, lang, length, bucket(lines), bucket(size / lines)])]
    hashed = mix(np.concatenate([c for _, c in parts])) >> np.uint64(64 - META_BITS)
    return _counted(np.concatenate([r for r, _ in parts]), hashed, rows, META_BITS)


def _views(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, Sparse, Sparse]]:
    """Both views of the rows of a batch, a block at a time; column ``first`` and the next hold text, source, lang, n_chars."""
    source, lang, n_chars = (batch.column(first + k).to_pylist() for k in (1, 2, 3))
    for at, data, offsets in blocks(batch.column(first)):
        end = at + len(offsets) - 1
        yield at, text_features(data, offsets), meta_features(source[at:end], lang[at:end], n_chars[at:end], data, offsets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: Sparse, y: np.ndarray, size: int, steps: int = 60, ridge: float = 1e-4, rate: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias; full gradients with a step for each feature (Adagrad)."""
    w, square = np.zeros(size + 1), np.full(size + 1, 1e-8)
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes count alike
    row = np.repeat(np.arange(len(y)), np.diff(x.at))
    for _ in range(steps):
        error = (_sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        g = np.r_[np.bincount(x.feature, error[row] * x.value, minlength=size), error.sum()]
        g[:-1] += ridge * w[:-1] * 1e-2
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def _platt(margins: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = (), ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Slopes and, last, the intercept of a logistic fit by Newton steps, with targets short of 0 and 1 and a ridge around ``prior``."""
    up, down = y.sum(), (1 - y).sum()
    y = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.c_[margins, np.ones(len(y))]
    middle = np.array(prior) if prior else np.zeros(x.shape[1])
    w = middle.copy()
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * (w - middle))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray
    constant: float | None = None

    def scores(self, text: Sparse, meta: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = len(text.at) - 1
        if self.constant is not None:
            return (np.full(rows, self.constant),) * 3
        a = np.c_[text.dot(self.text[:-1]) + self.text[-1], np.ones(rows)] @ self.text_scale
        b = np.c_[meta.dot(self.meta[:-1]) + self.meta[-1], np.ones(rows)] @ self.meta_scale
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.c_[a, b, np.ones(rows)] @ self.both)


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def _gathered(rows: DataFrame) -> tuple[Sparse, Sparse, np.ndarray, np.ndarray]:
    """Views, ``y`` and ``key`` of a bounded sample (``key, y`` and the input columns) on the driver, in order of the key."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text, meta in _views(batch, 2):
                n = len(text.at) - 1
                part = lambda s, r: (s.feature[s.at[r] : s.at[r + 1]].tobytes(), s.value[s.at[r] : s.at[r + 1]].tobytes())
                cells = [(*part(text, r), *part(meta, r)) for r in range(n)]
                own = [batch.column(c).slice(at, n) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array([c[k] for c in cells], pa.binary()) for k in range(4)]], ["key", "y", "tf", "tv", "mf", "mv"])

    got = rows.mapInArrow(make, "key long, y int, tf binary, tv binary, mf binary, mv binary").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("key", "y", "tf")])

    def sparse(f: str, v: str) -> Sparse:
        cells = got[f].to_pylist()
        at = np.r_[0, np.cumsum([len(c) // 4 for c in cells])].astype(np.int64)
        return Sparse(at, np.frombuffer(b"".join(cells), np.int32), np.frombuffer(b"".join(got[v].to_pylist()), np.float32))

    return sparse("tf", "tv"), sparse("mf", "mv"), got["y"].to_numpy(), got["key"].to_numpy()


def _columns() -> list[Column]:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def _confident(unlabelled: DataFrame, view: str, most: int, up: bool, beyond: float) -> list[int]:
    """Keys of the ``most`` documents with the largest (or least) calibrated score of a view, of those beyond a score."""
    order = [F.desc(view) if up else F.asc(view), F.asc("key")]
    sure = F.col(view) > beyond if up else F.col(view) < beyond
    return [r[0] for r in unlabelled.where(sure).orderBy(*order).limit(most).select("key").collect()]


def _joined(a: Sparse, b: Sparse) -> Sparse:
    return Sparse(np.r_[a.at, b.at[1:] + a.at[-1]], np.r_[a.feature, b.feature], np.r_[a.value, b.value])


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = 6_000, rounds: int = 3, exchanged: int = 400) -> Model:
    good = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    good = staged(good, "labels")
    share = min(1.0, labelled_rows / max(good.count(), 1))
    picked = good.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    few = F.broadcast(picked)  # about labelled_rows
    text, meta, y, key = _gathered(docs.join(few, "doc_id").select(_key(), F.col("y").cast("int"), *_columns()))
    share = float(y.mean()) if len(y) else 1.0
    fold = mix(key.view(np.uint64)) % np.uint64(FOLDS)  # 0: calibrates, 1: combines, others: learn
    learn, test, last = np.flatnonzero(fold > 1), np.flatnonzero(fold == 0), np.flatnonzero(fold == 1)
    if any((y[part] == c).sum() < least for part, least in ((learn, 2), (test, 1), (last, 1)) for c in (0, 1)):
        none = np.zeros(0)
        return Model(none, none, none, none, none, constant=share)
    train = {"text": (text.rows(learn), y[learn].astype(float)), "meta": (meta.rows(learn), y[learn].astype(float))}
    views = {"text": (text, 1 << TEXT_BITS), "meta": (meta, 1 << META_BITS)}
    given: dict[str, set[int]] = {v: set() for v in views}  # documents that a view was given already
    scale, weights = {}, {}
    for k in range(rounds + 1):
        for v, (x, size) in views.items():
            weights[v] = logistic(*train[v], size)
            scale[v] = _platt(x.rows(test).dot(weights[v][:-1]) + weights[v][-1], y[test])
        if k == rounds:
            break
        model = Model(weights["text"], weights["meta"], scale["text"], scale["meta"], np.ones(3))
        # labelled documents go after scoring, so that ids and scores are shuffled and not texts
        now = staged(_scores(docs, model, _key(), F.col("doc_id")).join(good, "doc_id", "left_anti").select("key", "p_text", "p_meta"), "views")
        told: dict[str, dict[int, int]] = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            # documents that the other view has got already may stand before new ones: 2 * exchanged for each round at most
            free = lambda keys, most: list(dict.fromkeys(i for i in keys if i not in given[other]))[:most]
            room, ups, downs = len(given[other]), round(exchanged * share), round(exchanged * (1 - share))
            told[other] = {i: 1 for i in free(_confident(now, f"p_{v}", room + 2 * ups, True, 0.95), ups)}
            told[other] |= {i: 0 for i in free(_confident(now, f"p_{v}", room + 2 * downs, False, 0.05), downs)}
            given[other] |= told[other].keys()
        wanted = sorted(set().union(*told.values()))
        if not wanted:
            continue
        few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "key long"))  # exchanged x 2 at most
        found = docs.select(_key(), F.lit(0).alias("y"), *_columns()).join(few, "key", "left_semi")
        new_text, new_meta, _, keys = _gathered(found)
        for v, x in (("text", new_text), ("meta", new_meta)):
            _, once = np.unique(keys, return_index=True)
            rows = np.array([i for i in once if int(keys[i]) in told[v]], np.int64)
            train[v] = (_joined(train[v][0], x.rows(rows)), np.r_[train[v][1], [float(told[v][int(keys[i])]) for i in rows]])
    a = np.c_[text.rows(last).dot(weights["text"][:-1]) + weights["text"][-1], np.ones(len(last))] @ scale["text"]
    b = np.c_[meta.rows(last).dot(weights["meta"][:-1]) + weights["meta"][-1], np.ones(len(last))] @ scale["meta"]
    return Model(weights["text"], weights["meta"], scale["text"], scale["meta"], _platt(np.c_[a, b], y[last], MEAN, 3.0))


def _scores(docs: DataFrame, model: Model, *own: Column) -> DataFrame:
    """``p_text, p_meta, score`` of every row, after the columns ``own``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source, first = docs.select(*own, *_columns()), len(own)
    head = source.schema.fields[:first]
    names = [*[f.name for f in head], "p_text", "p_meta", "score"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, text, meta in _views(batch, first):
                a, b, both = m.scores(text, meta)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, len(a)) for c in range(first)], pa.array(a), pa.array(b), pa.array(both)], names)

    return source.mapInArrow(make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + ", p_text double, p_meta double, score double")


def scored(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, p_text, p_meta, score, kept`` of every row; kept: a score of ``least`` or more."""
    return _scores(docs, model, F.col("doc_id").cast("long").alias("doc_id")).withColumn("kept", F.col("score") >= least)
