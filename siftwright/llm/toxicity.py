r"""Toxicity: class-conditional Kneser-Ney models over words.

A toxic and an ordinary bigram model are counted from labelled texts, as many
rows of one as of the other.  Every level counts contexts, not occurrences
(what thousands of copies repeat counts once), discounts what it counts and
gives the rest to the level below; the lowest are the continuation counts of
the whole corpus, which both classes share.  The discount is not one constant:
a class keeps only what its count has beyond a margin over what the shared
counts explain and beyond their noise.  Common words and the mix of languages
then cost both classes the same, a rare expression gets its probability from
all documents, and what marks a class stands out.  A text's score is a logistic
of the difference of its two log-likelihoods per word.

The class models are fitted on a bounded sample of labelled rows (``Settings``),
so the tables that tasks look words up in are bounded and are broadcast.  The
shared counts cover every word of every document: a word's distinct
predecessors are sketched in bitmaps of 64 bits that merge by ``bit_or``, so
that what a task sends is one row a distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free, stored
from .textops import ALNUM, mix, text_chunks, words_of

#: the context of a text's first word
START = np.uint64(0x5BF03635D1E5A4C7)
LEVELS, RATIO = 9, 2  # bitmaps of a sketch; each sees 2**-RATIO of what the one before sees
FULL = 58  # bits set from which on the next bitmap tells more
FIXED = float(1 << 24)  # sums in fixed point do not depend on their order
CHUNK_WORDS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``bytes`` of text bound the fitted sample of each class; rows come in the order of their hashed doc_id, and texts of over a sixteenth of the bytes are left out.

    Every ``held``-th row of the sample is kept from the counts and fits the
    logistic.  ``margin`` (for pairs of words ``pair_margin``) and ``noise``
    make the discount of a count that shared counts lead one to expect at e:
    margin * e + noise * sqrt(e + 1).
    """

    rows: int = 6_000
    bytes: int = 12_000_000
    held: int = 5
    margin: float = 2.5
    pair_margin: float = 1.5
    noise: float = 3.0
    ridge: float = 1e-6


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word of consecutive texts; START before a text's first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = START
    return before


def paired(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One name for a word and the one before it."""
    return mix(v * np.uint64(0x9FB21C651E98DF25) + w)


def _hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the words before them, and the texts' first words."""
    words = words_of(data, off, ALNUM, lower=True)
    h = words.hashes()
    return h, contexts(h, words.first), words.first


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, u, v, w) of labelled texts: a word and the two before it."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for lo, hi, data, off in text_chunks(batch.column("text")):
            w, v, first = _hashes(data, off)
            u = contexts(v, first)
            of = np.repeat(labels[lo:hi], np.diff(first))
            for label in (0, 1):
                mine = of == label
                if mine.any():
                    kinds = np.unique(np.rec.fromarrays([u[mine], v[mine], w[mine]], names="u,v,w"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), label, np.int32)), *[_long(kinds[c]) for c in "uvw"]], ["label", "u", "v", "w"])


def _sketches(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and, for each, its bitmaps of the words before it."""
    order = np.argsort(w, kind="stable")
    w, h = w[order], mix(v[order] ^ np.uint64(0xA0761D6478BD642F))
    heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    maps = np.zeros((len(heads), LEVELS), np.uint64)
    for i in range(LEVELS):
        bit = np.uint64(1) << (mix(h + np.uint64(i)) & np.uint64(63))
        seen = (h >> np.uint64(8)) & np.uint64((1 << RATIO * i) - 1) == 0
        maps[:, i] = np.bitwise_or.reduceat(np.where(seen, bit, np.uint64(0)), heads)
    return w[heads], maps


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> Iterator[pa.RecordBatch]:
        if held:
            w, maps = _sketches(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            yield pa.RecordBatch.from_arrays([_long(w), *[_long(maps[:, i]) for i in range(LEVELS)]], ["w", *[f"m{i}" for i in range(LEVELS)]])

    for batch in batches:
        for _, _, data, off in text_chunks(batch.column("text")):
            w, v, _ = _hashes(data, off)
            if len(w):
                held.append((v, w))
            if sum(len(x) for x, _ in held) > CHUNK_WORDS:
                yield from told()
    yield from told()


def _estimate() -> Column:
    """Distinct values that a row's bitmaps tell: linear counting in the first that is not full."""
    out = None
    for i in reversed(range(LEVELS)):
        n = F.bit_count(f"m{i}")
        linear = F.log(F.lit(64.0) / F.greatest(F.lit(64) - n, F.lit(0.5))) * float(64 << RATIO * i)
        out = linear if out is None else F.when(n <= FULL, linear).otherwise(out)
    return out


def continuations(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored (w, n): each word's hash and its number of distinct predecessors in all documents, within about an eighth."""
    rows = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(_sketch, "w long, " + ", ".join(f"m{i} long" for i in range(LEVELS)))
    merged = rows.groupBy("w").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(LEVELS)])
    return stored(merged.select("w", _estimate().alias("n")), "continuations")


def sample(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Stored (label, text, held) of the labelled rows that are fitted, within ``settings``, as many of either class; of rows that repeat a doc_id the smallest text."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("label") == k).orderBy(*order).limit(settings.rows) for k in (0, 1)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= settings.bytes // 16)
    rows = rows.join(F.broadcast(some[0].union(some[1])), "doc_id")  # at most settings.rows ids of either class
    rows = stored(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    sizes = rows.select("doc_id", "label", F.octet_length("text").alias("size")).toArrow().to_pandas()  # as many rows
    sizes["at"] = [int(x) for x in mix(sizes["doc_id"].to_numpy(np.int64).view(np.uint64))]
    sizes = sizes.sort_values(["label", "at"])
    sizes = sizes[sizes.groupby("label").cumcount() < sizes["label"].value_counts().reindex([0, 1], fill_value=0).min()]
    sizes["held"] = sizes.groupby("label").cumcount() % settings.held == 0
    within = sizes[sizes.groupby("label")["size"].cumsum() <= settings.bytes]
    if within.empty:
        return rows.select("label", "text", F.lit(False).alias("held")).limit(0)
    chosen = docs.sparkSession.createDataFrame(within[["doc_id", "label", "held"]], "doc_id long, label int, held boolean")
    return stored(rows.join(F.broadcast(chosen), ["doc_id", "label"]).select("label", "text", "held"), "sample")


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _counts(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.float64)


def _looked(keys: np.ndarray, values: np.ndarray, at: np.ndarray, none: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(at), none)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[i] == at, values[i], none)


@dataclass
class Counts:
    """Hashes of words (or of contexts and words) and their counts in the ordinary and the toxic class."""

    names: tuple[np.ndarray, ...]
    of: tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """log P(toxic) - log P(ordinary) of a word after another: the word's share, the context's, and what a pair adds that either class keeps; then the logistic.

    Words, contexts and pairs that tell nothing more than an unknown one are left out.
    """

    words: np.ndarray
    word_ratio: np.ndarray
    unknown: float
    contexts: np.ndarray
    context_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    slope: float = 0.0
    level: float = 0.0

    @staticmethod
    def of(words: Counts, total: tuple[float, float], shared: np.ndarray, pairs: Counts, sizes: tuple[np.ndarray, np.ndarray], s: Settings = Settings()) -> Model:
        """``words``: continuation counts of words (sorted), of which all words of a class have ``total``; ``shared``: their probabilities in the corpus.

        ``pairs``: counts of pairs whose words are among them; ``sizes``: the
        counts of all pairs of their contexts.  Words and pairs that no class
        counts more than ``s.noise`` times would keep nothing and may be absent.
        """
        v, w = pairs.names
        before, at_v = np.unique(v, return_inverse=True)
        at_w = np.searchsorted(words.names[0], w)
        pooled = (pairs.of[0] + pairs.of[1]) / np.maximum(1, sizes[0] + sizes[1])
        kept = lambda n, e, margin: np.maximum(0, n - margin * e - s.noise * np.sqrt(e + 1))
        rests, word_logs, left_logs, pair_logs = [], [], [], []
        for k in (0, 1):
            own = kept(words.of[k], total[k] * shared, s.margin)
            rest = 1 - own.sum() / total[k]
            word = rest * shared + own / total[k]
            more = kept(pairs.of[k], sizes[k] * np.maximum(pooled, word[at_w]), s.pair_margin) / np.maximum(sizes[k], 1)
            left = 1 - np.bincount(at_v, more, len(before))
            for logs, p in ((rests, rest), (word_logs, word), (left_logs, left), (pair_logs, more + left[at_v] * word[at_w])):
                logs.append(np.log(p))
        fixed = lambda logs: np.round((logs[1] - logs[0]) * FIXED) / FIXED
        unknown, word, context = float(fixed(rests)), fixed(word_logs), fixed(left_logs)
        pair = fixed(pair_logs) - word[at_w] - context[at_v]
        names = paired(v, w)
        order = np.argsort(names)
        names, pair = names[order], pair[order]
        tell = np.abs(pair) > 2 / FIXED  # more than rounding
        told = word != unknown
        return Model(words.names[0][told], word[told], unknown, before[context != 0], context[context != 0], names[tell], pair[tell])

    def per_word(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Each text's mean ratio; 0 without words."""
        w, v, first = _hashes(data, off)
        each = _looked(self.words, self.word_ratio, w, self.unknown) + _looked(self.contexts, self.context_ratio, v) + _looked(self.pairs, self.pair_ratio, paired(v, w))
        total = np.r_[0, np.cumsum(np.round(each * FIXED).astype(np.int64))]
        return (total[first[1:]] - total[first[:-1]]) / FIXED / np.maximum(1, np.diff(first))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.level, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, float]:
    """Slope and level by Newton's steps, each shortened until it gains; class 0 weighs a little more, so texts that tell nothing fall to it."""
    weight = np.where(y == 1, 0.45 / max(1, (y == 1).sum()), 0.55 / max(1, (y == 0).sum()))
    scale, mean = max(float(x.std()), 1e-9), float(x.mean())
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    loss = lambda b: float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b)) + ridge * b @ b / 2)
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (p - y)) + ridge * b)
        while loss(b - step) > loss(b) and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * mean / scale)


def _ratios(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.value.per_word(data, off) for _, _, data, off in text_chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.concatenate(x) if x else np.zeros(0))], ["label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Both class models and the logistic.

    Labels are those of rows for which ``learn`` (of ``doc_id``) holds; rows
    without a label, id or text teach nothing.  Without rows of both classes
    every text scores the smoothed share of label 1.
    """
    spark = docs.sparkSession
    fitted = sample(docs, labels, learn, settings, doc_id, text, label)
    kinds = fitted.where("not held").mapInArrow(_count, "label int, u long, v long, w long").distinct()
    counts = stored(kinds.groupBy("v", "w").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)]), "pairs")
    total = counts.agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in (0, 1)]).first()
    if not total.n0 or not total.n1:
        y = fitted.agg(F.sum("label").alias("ones"), F.count("*").alias("n")).first()
        share = ((y.ones or 0) + 0.5) / (y.n + 1)
        empty, none = np.zeros(0, np.uint64), np.zeros(0)
        return Model(empty, none, 0.0, empty, none, empty, none, 0.0, float(np.log(share / (1 - share))))
    # only what a class counts often enough to keep any of it reaches the driver, with the sums that it is held against
    often = F.greatest("n0", "n1") > settings.noise
    sizes = counts.groupBy("v").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    pairs = counts.where(often).join(sizes, "v").toArrow()
    words = counts.groupBy("w").agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"n{k}") for k in (0, 1)])
    met = counts.where(often).select("w").distinct().withColumn("met", F.lit(True))
    words = stored(words.join(met, "w", "left").where(often | F.col("met")).select("w", "n0", "n1"), "words")
    all_words = continuations(docs, text)
    every = float(all_words.agg(F.sum(F.round("n", 3).cast("decimal(38,3)"))).first()[0] or 1)
    words = words.join(all_words, "w", "left").select("w", "n0", "n1", F.greatest(F.coalesce("n", F.lit(1.0)), F.lit(1.0)).alias("n")).toArrow()
    words = words.take(pc.sort_indices(pa.array(_unsigned(words, "w"))))
    named = Counts((_unsigned(words, "w"),), (_counts(words, "n0"), _counts(words, "n1")))
    two = Counts((_unsigned(pairs, "v"), _unsigned(pairs, "w")), (_counts(pairs, "n0"), _counts(pairs, "n1")))
    model = Model.of(named, (total.n0, total.n1), _counts(words, "n") / every, two, (_counts(pairs, "s0"), _counts(pairs, "s1")), settings)
    held = fitted.where("held").mapInArrow(_ratios(spark.sparkContext.broadcast(model)), "label int, x double").toArrow().sort_by([("label", "ascending"), ("x", "ascending")])
    model.slope, model.level = logistic(_counts(held, "x"), _counts(held, "label"), settings.ridge)
    return model


def _scores(model: Broadcast, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.value
            x = [m.score(m.per_word(data, off)) for _, _, data, off in text_chunks(batch.columns[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(x) if x else np.zeros(0))], [*batch.schema.names[:-1], score])

    return run


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and a score of 0 to 1 (higher: toxic likelier).

    Only the text is looked at, whole: null, empty and wordless texts have a
    ratio of 0, one of any length is handled at once with no more memory than a
    few times its words.  Rows keep nulls, repetitions and extra columns; one
    called like ``score`` is replaced.  An empty table stays empty.
    """
    own, = free(docs.columns, "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(own, F.col(text).cast("string")).mapInArrow(_scores(shared, own), f"{schema}, `{own}` double")
    return out if own == score else out.withColumn(score, F.col(own)).drop(own)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0.  A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
