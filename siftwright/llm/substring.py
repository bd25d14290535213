r"""Repeated word spans by a de Bruijn graph partitioned by minimizers.

Edges are windows of k words (64-bit hashes) between nodes of k - 1 words; a
window lies with its minimizer, the smallest hashed 8-gram inside it, so equal
windows share one and successive windows mostly do.

1. Minimizers are counted.  A window whose minimizer occurs once cannot repeat;
   a bitmap of fixed size holds the repeated ones and spares the others the
   second reading (a full bitmap only lets more through).
2. Remaining edges are dealt by minimizer, those of a very common minimizer by
   their own hash.  Sorted by edge, document and place, the first occurrence of
   each edge comes first; every other one points to it.
3. A node does not branch on a repeated path where the edges around it follow
   each other both at their occurrence and at the first ones.  Runs of such
   edges in one partition make a piece.  Pieces that meet in a node that does
   not branch are found by a join of their ends with their beginnings, and all
   that hang together become one path.
4. A path names two places of equal length.  Both are read again, and the words
   there are compared by another hash; only paths that hold are kept.
5. A join by document brings paths and texts together.  Texts without any path
   (told by a bitmap of fixed size) are not shuffled.

Windows that repeat inside one chunk of documents are settled there, so a
group of copies reaches the shuffle once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, tested
from .storage import drop, stored
from .textops import NOT_SPACE, mix, range_hashes, text_chunks, windows, words_of

SEED_WORDS = 8
FILTER_BITS = 1 << 26
#: a minimizer in over this part of all (chunk, minimizer) rows is dealt by edge; there are at most as many
HOT_PART = 1 / 20_000
LAST = 2**63 - 1
SPANS = "did long, th int, start int, length int, src_did long, src_th int, src_start int"


def _minimizers(data, off, k: int):
    """Words, then for each window: start, edge hash, place of its minimizer and the minimizer."""
    w = words_of(data, off, NOT_SPACE)
    h = w.hashes()
    start, edge = windows(h, w.doc, k)
    seed_at, seeds = windows(h, w.doc, min(SEED_WORDS, k), base=0xD1342543DE82EF95)
    dense = np.full(len(h), np.uint64(2**64 - 1))
    dense[seed_at] = seeds
    best, at = dense[start], start.copy()
    for j in range(1, k - min(SEED_WORDS, k) + 1):
        other = dense[start + j]
        less = other < best
        best = np.where(less, other, best)
        at[less] = start[less] + j
    return w, start, edge, at, best


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column("text")):
                _, _, _, at, best = _minimizers(data, off, k)
                head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                seed, n = np.unique(best[head], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["seed", "n"])

    return run


def _text_marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("did").to_numpy(), batch.column("th").to_numpy()


def _runs(did, th, pos, src, src_th, src_pos) -> list[pa.Array]:
    """Occurrences that follow each other, as do their sources, become one piece of a path."""
    order = np.lexsort((src_pos - pos, src_th, src, pos, th, did))
    did, th, pos, src, src_th, src_pos = (x[order] for x in (did, th, pos, src, src_th, src_pos))
    if len(pos):
        new = np.r_[True, (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_th[1:] != src_th[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)]
        head = np.flatnonzero(new)
    else:
        head = np.zeros(0, np.int64)
    n = np.diff(np.r_[head, len(pos)])
    return [pa.array(did[head]), pa.array(th[head]), pa.array(pos[head].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(src[head]), pa.array(src_th[head]), pa.array(src_pos[head].astype(np.int32))]


def _edges(k: int, bits: np.ndarray, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_did, all_th = _text_marks(batch)
            for lo, hi, data, off in text_chunks(batch.column("text")):
                w, start, edge, _, best = _minimizers(data, off, k)
                slot = (best & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
                keep = ((bits[slot >> 3] >> (slot & 7)) & 1).astype(bool)
                start, edge, best = start[keep], edge[keep], best[keep]
                doc = w.doc[start]
                did, th, pos = all_did[lo:hi][doc], all_th[lo:hi][doc], start - w.first[doc]
                order = np.lexsort((pos, did, edge))
                edge, best, did, th, pos = (x[order] for x in (edge, best, did, th, pos))
                head = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]]) if len(edge) else np.zeros(0, np.int64)
                first = np.repeat(head, np.diff(np.r_[head, len(edge)]))
                later = (did > did[first]) | (pos > pos[first])
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, best), len(hot) - 1)
                    best = np.where(hot[i] == best, edge, best)
                own = np.flatnonzero(~later)
                own = own[np.lexsort((pos[own], did[own]))]  # as in the texts: it packs better
                none = lambda n, t: pa.nulls(n, t)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best[own].view(np.int64)), pa.array(edge[own].view(np.int64)), pa.array(did[own]), pa.array(th[own]), pa.array(pos[own].astype(np.int32)), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32())],
                    ["part", "edge", "did", "th", "start", "length", "src_did", "src_th", "src_start"],
                )
                at = np.flatnonzero(later)
                spans = _runs(did[at], th[at], pos[at], did[first[at]], th[first[at]], pos[first[at]])
                m = len(spans[0])
                spread = mix(np.arange(m, dtype=np.uint64) + np.uint64(len(data))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), none(m, pa.int64()), *spans], ["part", "edge", "did", "th", "start", "length", "src_did", "src_th", "src_start"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by edge, document and place: pieces of paths of the occurrences after an edge's first."""
    names = ["did", "th", "start", "length", "src_did", "src_th", "src_start"]
    last = None  # (part, edge, did, start, text) of the current edge's first occurrence
    for batch in batches:
        settled = batch.filter(batch.column("length").is_valid())
        if len(settled):
            yield settled.select(names)
        batch = batch.filter(batch.column("length").is_null())
        if not len(batch):
            continue
        part, edge, did, th, pos = (batch.column(c).to_numpy() for c in ("part", "edge", "did", "th", "start"))
        pos = pos.astype(np.int64)
        head = np.flatnonzero(np.r_[last is None or (part[0], edge[0]) != last[:2], (part[1:] != part[:-1]) | (edge[1:] != edge[:-1])])
        lead = int(head[0]) if len(head) else len(edge)
        first = np.r_[np.zeros(lead, np.int64), np.repeat(head, np.diff(np.r_[head, len(edge)]))]
        src, src_pos, src_th = did[first], pos[first], th[first]
        if lead:
            src[:lead], src_pos[:lead], src_th[:lead] = last[2], last[3], last[4]
        later = (did != src) | (pos > src_pos)
        if len(head):
            k = head[-1]
            last = (part[k], edge[k], did[k], pos[k], th[k])
        yield pa.RecordBatch.from_arrays(_runs(did[later], th[later], pos[later], src[later], src_th[later], src_pos[later]), names)


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("did"), F.hash(F.coalesce(t, F.lit(""))).alias("th"), t.alias("text"))


def _compacted(pieces: DataFrame) -> DataFrame:
    """Pieces that meet in a node that does not branch, joined into paths.

    A piece goes on another where that one ends, in its document and in its
    source.  Paths are numbered inside a document, which bounds their number.
    Rows that repeat one document give the same pieces; one of each counts.
    """
    keys = ["did", "th", "start", "src_did", "src_th", "src_start"]
    ends = pieces.select("did", "th", (F.col("start") + F.col("length")).alias("start"), "src_did", "src_th", (F.col("src_start") + F.col("length")).alias("src_start")).distinct()
    joined = pieces.join(ends.withColumn("goes_on", F.lit(True)), keys, "left")
    joined = joined.groupBy(*keys, "length").agg(F.max("goes_on").alias("goes_on"))  # dealt by the keys already
    place = Window.partitionBy("did", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    path = joined.withColumn("path", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(place))
    first = F.min(F.struct("start", "src_did", "src_th", "src_start")).alias("f")
    out = path.groupBy("did", "th", "path").agg(first, F.sum("length").cast("int").alias("length"))
    return out.select("did", "th", "f.start", "length", "f.src_did", "f.src_th", "f.src_start")


PLACE = "start int, n int, src_did long, src_th int, src_start int"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places that are asked for, each with the hash of its words."""
    for batch in batches:
        places = batch.column("places")
        for lo, hi, data, off in text_chunks(batch.column("text")):
            w = words_of(data, off, NOT_SPACE)
            own = places[lo:hi]
            doc = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
            fields = dict(zip((f.name for f in own.type.value_type), own.flatten().flatten(), strict=True))
            n = fields["n"].to_numpy().astype(np.int64)
            first = w.first[doc] + fields["start"].to_numpy()
            whole = first + n <= w.first[doc + 1]  # another text under one hash may be shorter
            h = np.zeros(len(n), np.uint64)
            h[whole] = range_hashes(w, first[whole], n[whole])
            rows = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([batch.column("did").take(rows), batch.column("th").take(rows), *fields.values(), pa.array(h.view(np.int64))], ["did", "th", *fields, "h"])


def _holding(paths: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Paths whose words are the same at their source."""
    n = (F.col("length") + (k - 1)).alias("n")
    targets = paths.select("did", "th", F.struct("start", n, "src_did", "src_th", "src_start").alias("p"))
    # copies ask for the same places of their source: each is read once
    sources = paths.select(F.col("src_did").alias("did"), F.col("src_th").alias("th"), F.col("src_start").alias("start"), n).distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("src_did", "long"), ("src_th", "int"), ("src_start", "int"))]
    by_doc = targets.union(sources.select("did", "th", F.struct("start", "n", *none))).groupBy("did", "th").agg(F.collect_list("p").alias("places"))
    by_doc = stored(by_doc, "places")
    bits = bitmap(by_doc.select("did", "th"), "did", "th")
    texts = tested(rows.select("did", "th", "text"), bits, "asked", "did", "th").where("asked").select("did", "th", "text")
    read = stored(texts.join(by_doc, ["did", "th"]).mapInArrow(_read_back, f"did long, th int, {PLACE}, h long"), "read")
    source = read.where("src_did is null").select(F.col("did").alias("src_did"), F.col("th").alias("src_th"), F.col("start").alias("src_start"), "n", F.col("h").alias("src_h"))
    both = read.where("src_did is not null").join(source, ["src_did", "src_th", "src_start", "n"]).where("h = src_h")
    out = stored(both.select("did", "th", "start", (F.col("n") - (k - 1)).alias("length"), "src_did", "src_th", "src_start").distinct(), "spans")
    drop(by_doc, read)
    return out


def repeated_spans(docs: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compacted paths of repeated edges: did, th (a hash of the text), start, length (in windows), src_did, src_th, src_start.

    Each says that ``length`` successive windows of k words from ``start`` also
    occur, earlier in (doc_id, place), from ``src_start`` in ``src_did``.  The
    words of both places have been read again and found equal.
    """
    rows = _marked(docs, doc_id, text)
    seeds = rows.select("text").mapInArrow(_seeds(k), "seed long, n int")
    counted = stored(seeds.groupBy("seed").agg(F.count("*").alias("chunks"), F.sum("n").alias("n")).where("n > 1"), "seeds")
    total = counted.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
    hot = counted.where(F.col("chunks") > max(64, total * HOT_PART)).select("seed").collect()
    hot = np.sort(np.array([r.seed for r in hot], np.int64).view(np.uint64))
    slot = F.expr(f"(seed & {FILTER_BITS - 1}L) + 1")
    parts = counted.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    edges = rows.select("did", "th", "text").mapInArrow(_edges(k, bits, hot), "part long, edge long, " + SPANS)
    dealt = edges.repartition("part").sortWithinPartitions("part", "edge", "did", "start")
    pieces = stored(dealt.mapInArrow(_later, SPANS), "pieces")
    paths = stored(_compacted(pieces), "paths")
    out = _holding(paths, rows, k)
    drop(pieces, paths)
    return out


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, lengths = batch.column("starts"), batch.column("lengths")
            for lo, hi, data, off in text_chunks(batch.column("text")):
                w = words_of(data, off, NOT_SPACE)
                own, n = starts[lo:hi], lengths[lo:hi]
                doc = np.repeat(np.arange(hi - lo), own.value_lengths().fill_null(0).to_numpy())
                first = w.first[doc] + own.flatten().to_numpy()
                gone = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(gone, first, 1)
                np.add.at(gone, np.minimum(first + n.flatten().to_numpy() + (k - 1), w.first[doc + 1]), -1)
                stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                # kept words with single spaces between them are copied at once
                joined = np.zeros(max(len(stay), 1), bool)
                if len(stay):
                    a, b = stay[:-1], stay[1:]
                    joined[1:] = (b == a + 1) & (w.doc[a] == w.doc[b]) & (w.start[b] == w.end[a] + 1) & (data[np.minimum(w.end[a], len(data) - 1)] == 32)
                head = np.flatnonzero(~joined[: len(stay)])
                tail = np.r_[head[1:], len(stay)][: len(head)] - 1  # none where a chunk keeps no word
                begin, end = w.start[stay[head]].tolist(), w.end[stay[tail]].tolist()
                cut = np.searchsorted(w.doc[stay[head]], np.arange(hi - lo + 1)).tolist()
                raw = data.tobytes()
                texts = [b" ".join([raw[x:y] for x, y in zip(begin[i:j], end[i:j], strict=True)]) for i, j in zip(cut, cut[1:], strict=False)]
                removed = np.diff(w.first) - np.bincount(w.doc[stay], minlength=hi - lo)
                digest = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.diff(w.first)), pa.array(removed), pa.array(digest), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    r"""One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space).

    Words are ``[^\x20\x09-\x0D]+``.  A word goes if a window of k words over
    it also starts earlier: in a smaller doc_id, or earlier in the same one.
    Windows are judged on the texts as given.  A null text has no words.  A
    null doc_id comes after all others.  Repeated rows (one doc_id) do not
    remove each other's words, as none starts earlier.  An empty table gives an
    empty result; other columns are ignored.
    """
    spans = repeated_spans(docs, k, doc_id, text)
    bits = bitmap(spans.select("did", "th").distinct(), "did", "th")
    rows = tested(_marked(docs, doc_id, text), bits, "held", "did", "th")
    by_doc = spans.groupBy("did", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    met = rows.where("held").join(by_doc, ["did", "th"], "left").select("doc_id", "text", "starts", "lengths")
    none = F.lit(None).cast("array<int>")
    free = rows.where("not held").select("doc_id", "text", none.alias("starts"), none.alias("lengths"))
    return free.unionByName(met).mapInArrow(_keep(k), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
