r"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted for whole texts, a megabyte at a time, without a loop
over words.  The trees are fitted on the driver from a bounded sample of
labelled rows (``Settings.sample``), then flattened into three arrays; scoring
walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free
from .textops import NOT_SPACE, text_chunks, windows, words_of


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows that are fitted, those of the smallest hashed doc_id."""

    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0


def _bytes(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


_CLASSES = [
    _bytes(lambda b: 97 <= b <= 122),
    _bytes(lambda b: 65 <= b <= 90),
    _bytes(lambda b: 48 <= b <= 57),
    _bytes(lambda b: b in b".,;:!?"),
    _bytes(lambda b: b in b"'\"()-"),
    _bytes(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,;:!?'\"()-"),
    _bytes(lambda b: b >= 128),
    _bytes(lambda b: b in b" \t\r\x0b\x0c"),
    _bytes(lambda b: b == 10),
]
_SYMBOL, _LETTER = _CLASSES[5], _CLASSES[0] | _CLASSES[1] | _CLASSES[6]
FEATURES = len(_CLASSES) + 15


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the commonest one's count, of each document."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    run = np.diff(np.r_[head, len(key)])
    own = (key[head] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, own, run)
    return np.bincount(own, minlength=n).astype(np.float64), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of consecutive texts."""
    n = len(off) - 1
    w = words_of(data, off, NOT_SPACE)
    h, lens = w.hashes(), (w.end - w.start).astype(np.float64)
    size, words = np.diff(off).astype(np.float64), np.diff(w.first).astype(np.float64)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    cols = [np.log1p(size), np.log1p(words)]
    cols += [_per_doc(c[data], off) * per_byte for c in _CLASSES]
    total = np.r_[0, np.cumsum(lens)]
    mean = (total[w.first[1:]] - total[w.first[:-1]]) * per_word
    square = np.r_[0, np.cumsum(lens**2)]
    cols += [mean, np.sqrt(np.maximum(0, (square[w.first[1:]] - square[w.first[:-1]]) * per_word - mean**2))]
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, lens)
    cols.append(np.log1p(longest))
    first, last = data[w.start], data[np.maximum(w.end - 1, 0)]
    symbols, letters = np.r_[0, np.cumsum(_SYMBOL[data])], np.r_[0, np.cumsum(_LETTER[data])]
    cols += [
        _per_doc(_CLASSES[1][first], w.first) * per_word,
        _per_doc((last == 46) | (last == 33) | (last == 63), w.first) * per_word,
        _per_doc(symbols[w.end] > symbols[w.start], w.first) * per_word,
        _per_doc(letters[w.end] == letters[w.start], w.first) * per_word,
        _per_doc(lens == 1, w.first) * per_word,
        _per_doc(lens <= 3, w.first) * per_word,
    ]
    kinds, most = _distinct(h, w.doc, n)
    cols += [kinds * per_word, most * per_word]
    for k in (2, 5):
        start, g = windows(h, w.doc, k)
        kinds, _ = _distinct(g, w.doc[start], n)
        cols.append(kinds / np.maximum(words - k + 1, 1))
    return np.column_stack(cols)


@dataclass
class Trees:
    """Complete trees: node i's children are 2i + 1 and 2i + 2; a leaf's value is at its place in the last level."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, a, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > a[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Trees:
    """Logistic loss, second-order splits on binned features.  Without rows of both labels the score is constant."""
    inner = 2**s.depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    feature, above, leaf = (np.zeros((s.trees, k), t) for k, t in ((inner, np.int32), (inner, np.float64), (inner + 1, np.float64)))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], above[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    flat = code + np.arange(x.shape[1]) * s.bins
    z = np.full(len(y), base)
    rows = np.arange(len(y))
    for t in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        g, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(s.depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (x.shape[1] * s.bins) + flat).ravel()
            shape = (width, x.shape[1], s.bins)
            many = width * x.shape[1] * s.bins
            hist_g = np.bincount(at, np.repeat(g, x.shape[1]), many).reshape(shape).cumsum(2)
            hist_h = np.bincount(at, np.repeat(hess, x.shape[1]), many).reshape(shape).cumsum(2)
            all_g, all_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
            gain = hist_g**2 / (hist_h + s.ridge) + (all_g - hist_g) ** 2 / (all_h - hist_h + s.ridge)
            gain[(hist_h < 1e-3) | (all_h - hist_h < 1e-3)] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // s.bins, best % s.bins
            for i in range(width):
                feature[t, first + i] = f[i]
                above[t, first + i] = edges[f[i]][b[i]] if b[i] < len(edges[f[i]]) else np.inf
            mine = node - first
            node = 2 * node + 1 + (x[rows, f[mine]] > above[t, first + mine])
        mine = node - inner
        leaf[t] = -s.rate * np.bincount(mine, g, inner + 1) / (np.bincount(mine, hess, inner + 1) + s.ridge)
        z += leaf[t][mine]
    return Trees(feature, above, leaf, base)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in text_chunks(batch.column("text")):
            x = statistics(data, off)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label")[lo:hi], flat], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fits the labelled rows for which ``learn`` (of ``doc_id``) holds, up to ``settings.sample``.

    Rows without a label or an id are not learned from; of rows that repeat a
    doc_id the smallest text is, so the sample is bounded whatever repeats.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id")  # at most settings.sample ids
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    got = rows.mapInArrow(_measure, "label int, x array<double>").toPandas()
    if got.empty:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), settings)
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # the order of arrival must not show in sums
    return fit(x[order], y[order], settings)


def _scores(trees: Trees, score: str):
    """Rows whose last column is the text that is scored; the score takes its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [trees.score(statistics(data, off)) for _, _, data, off in text_chunks(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], score])

    return run


def score_documents(docs: DataFrame, trees: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and a score of 0 to 1 (higher: label 1 likelier).

    A null text scores as an empty one.  Rows keep nulls, repetitions and extra
    columns; one called like ``score`` is replaced.  An empty table stays
    empty.  Only the text is looked at.
    """
    own, = free(docs.columns, "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn(own, F.col(text).cast("string")).mapInArrow(_scores(trees, own), f"{schema}, `{own}` double")
    return out if own == score else out.withColumn(score, F.col(own)).drop(own)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2.  A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
