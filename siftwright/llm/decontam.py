r"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by document into segments of about a megabyte of text, as
search engines do: a segment holds, for each of its terms, the sorted list of
the term's word positions.  It is stored as a table and knows of no test item,
so any number of searches share it.  A search reads one segment a row: all
windows whose terms the segment has are looked up together, each beginning with
the positions of its rarest term, moved by the term's offset, which are then
intersected with the lists of the other terms from the rarest to the commonest.
No list of one term is ever gathered across segments, however common it is.
Words are compared as 64-bit hashes, all of a window's words each.

Test items travel to the executors in blocks of about ``BLOCK_WORDS`` words;
the blocks of a larger benchmark search the same index in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored
from .textops import ALNUM, text_chunks, words_of

#: words of test items sent to executors at once
BLOCK_WORDS = 1_000_000
#: positions of rarest terms that are looked at together
AT_ONCE = 1 << 21
INDEX = "seg long, doc_id array<{}>, first array<int>, term array<long>, cut array<int>, at array<int>"
MATCHES = "seg long, ord int, doc_id {}, n_words int, matches array<struct<item_id:long,start:int,length:int>>"


def _ints(values, kind=np.int32) -> pa.Array:
    return pa.array([np.asarray(values).astype(kind)])


def term_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out = []
    for _, _, data, off in text_chunks(pa.array(texts, pa.string())):
        w = words_of(data, off, ALNUM, lower=True)
        out += np.split(w.hashes(), w.first[1:-1])
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seg = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, data, off in text_chunks(batch.column("text")):
            w = words_of(data, off, ALNUM, lower=True)
            h = w.hashes()
            at = np.argsort(h, kind="stable")
            term = h[at]
            head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seg]), pa.array([ids[lo:hi].to_pylist()], pa.list_(ids.type)), _ints(w.first), pa.array([term[head].view(np.int64)]), _ints(np.r_[head, len(at)]), _ints(at)],
                ["seg", "doc_id", "first", "term", "cut", "at"],
            )
            seg += 1


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", id_type: str = "long") -> DataFrame:
    """Stored postings of every word, one segment a row."""
    rows = docs.select(F.col(doc_id).cast(id_type).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(_segments, INDEX.format(id_type)), "index")


class _Segment:
    def __init__(self, row: dict) -> None:
        self.first, self.cut, self.at = row["first"], row["cut"].astype(np.int64), row["at"].astype(np.int64)
        self.term = row["term"].view(np.uint64)
        self.size = np.diff(self.cut)
        # sorted, as terms are and positions are within each: a place in one list is found by one search
        self.key = np.repeat(np.arange(len(self.term)) * max(len(self.at), 1), self.size) + self.at

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Places of terms in this segment, -1 for absent ones."""
        if not len(self.term):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        return np.where(self.term[at] == h, at, -1)

    def positions(self, slot: int) -> np.ndarray:
        return self.at[self.cut[slot] : self.cut[slot + 1]]

    def has(self, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        want = slot * len(self.at) + at
        i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (self.key[i] == want) & (at >= 0) & (at < len(self.at))

    def phrases(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of each row of terms that follow each other inside one document."""
        width = slots.shape[1]
        order = np.argsort(self.size[slots], axis=1, kind="stable")
        slots = np.take_along_axis(slots, order, 1)
        n = self.size[slots[:, 0]]
        rows, found = [], []
        upto = np.cumsum(n)
        for lo, hi in _cuts(upto):
            many = n[lo:hi]
            row = np.repeat(np.arange(lo, hi), many)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = self.at[self.cut[slots[row, 0]] + inside] - order[row, 0]
            keep = at >= 0
            row, at = row[keep], at[keep]
            for k in range(1, width):
                keep = self.has(slots[row, k], at + order[row, k])
                row, at = row[keep], at[keep]
                if not len(row):
                    break
            keep = self.doc(at) == self.doc(at + width - 1)
            rows.append(row[keep])
            found.append(at[keep])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *found])

    def near(self, slots: np.ndarray, span: int) -> list[tuple[int, int]]:
        """(first position, length) of the shortest stretches, at most ``span`` words, that hold all the terms in any order."""
        slots = np.unique(slots)
        rarest = slots[np.argmin(self.cut[slots + 1] - self.cut[slots])]
        around = self.positions(rarest)
        at, kind = [], []
        for s in slots:
            own = self.positions(s)
            i = np.searchsorted(around, own)
            gap = np.minimum(np.abs(own - around[np.minimum(i, len(around) - 1)]), np.abs(own - around[np.maximum(i - 1, 0)]))
            at.append(own[gap < span])
            kind.append(np.full(len(at[-1]), s))
        at, kind = np.concatenate(at), np.concatenate(kind)
        order = np.argsort(at, kind="stable")
        last: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        for p, s in zip(at[order].tolist(), kind[order].tolist()):
            last[s] = p
            if len(last) == len(slots):
                lo = min(last.values())
                if p - lo < span and self.doc(lo) == self.doc(p) and (not out or out[-1][0] != lo):
                    out.append((lo, p - lo + 1))
        return out

    def doc(self, at):
        return np.searchsorted(self.first, at, "right") - 1


def _cuts(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most about ``AT_ONCE`` positions each, given the positions' running total."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def _search(item_ids: list[int], items: list[np.ndarray], width: int, span: int | None):
    every = np.concatenate(items) if items else np.zeros(0, np.uint64)
    vocabulary, term = np.unique(every, return_inverse=True)
    lengths = np.array([len(x) for x in items], np.int64)
    begin = np.cumsum(lengths) - lengths
    ids = np.array(item_ids, np.int64)
    # windows by their length: first word's place and item
    by_width = []
    for k in np.unique(np.minimum(lengths, width)):
        own = np.flatnonzero(np.minimum(lengths, width) == k)
        n = lengths[own] - k + 1
        item = np.repeat(own, n)
        by_width.append((int(k), np.repeat(begin[own], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n), item))

    def exact(seg: _Segment, slots: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, start, length) of runs of words that windows of one item cover."""
        gap = np.r_[0, np.cumsum(slots < 0)]
        out = []
        for k, start, item in by_width:
            whole = gap[start + k] == gap[start]
            first, own = start[whole], item[whole]
            for lo in range(0, len(first), 1 << 16):
                row, at = seg.phrases(slots[first[lo : lo + (1 << 16), None] + np.arange(k)])
                out.append((own[lo + row], at, np.full(len(at), k)))
        item, at, k = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), (), ())))
        order = np.lexsort((at, item))
        item, at, k = item[order], at[order], k[order]
        if not len(at):
            return item, at, k
        doc = seg.doc(at)
        head = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + k[:-1])])
        last = np.r_[head[1:], len(at)] - 1
        return item[head], at[head], at[last] + k[last] - at[head]

    def near(seg: _Segment, slots: np.ndarray) -> tuple[np.ndarray, ...]:
        absent = np.r_[0, np.cumsum(slots < 0)]
        out = [(i, p, n) for i in np.flatnonzero(absent[begin + lengths] == absent[begin]) for p, n in seg.near(slots[begin[i] : begin[i] + lengths[i]], span)]
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                seg = _Segment({c: batch.column(c)[r].values.to_numpy() for c in ("first", "term", "cut", "at")})
                docs = batch.column("doc_id")[r].values
                n = len(docs)
                slots = seg.slots(vocabulary)[term]
                item, at, length = (exact if span is None else near)(seg, slots)
                doc = seg.doc(at)
                order = np.lexsort((at, item, doc))
                item, at, length, doc = item[order], at[order], length[order], doc[order]
                match = pa.StructArray.from_arrays([pa.array(ids[item]), pa.array((at - seg.first[doc]).astype(np.int32)), pa.array(length.astype(np.int32))], ["item_id", "start", "length"])
                cut = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("seg")[r].as_py())), pa.array(np.arange(n, dtype=np.int32)), docs, pa.array(np.diff(seg.first).astype(np.int32)), pa.ListArray.from_arrays(cut, match)],
                    ["seg", "ord", "doc_id", "n_words", "matches"],
                )

    return run


def find_items(docs: DataFrame, items: DataFrame, width: int = 13, span: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, id_type: str = "long") -> DataFrame:
    r"""One row per document: seg, ord (its place in the index), doc_id, n_words, matches (item_id, start, length).

    Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased.  With
    ``span`` None, a match is a run of words covered by windows of ``width``
    consecutive item words (an item of fewer words is one window); overlapping
    windows of one item are merged.  With ``span``, a match is a shortest
    stretch of at most ``span`` words that holds all of the item's words, in
    any order.

    A null text has no words; documents without words come out without
    matches, repeated rows as often as they came in.  Items with a null id or
    without words match nothing; an item id given twice stands for both texts.
    Empty tables give no matches; other columns are ignored.  doc_id is taken
    as ``id_type`` (long or string).
    """
    index = build_index(docs, doc_id, text, id_type)
    out = search_index(index, items, width, span, item_id, item_text, block_words)
    drop(index)
    return out


def search_index(index: DataFrame, items: DataFrame, width: int = 13, span: int | None = None, item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """find_items' rows, stored, of the documents of an index that is at hand."""
    picked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    size = picked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 4
    blocks = max(1, -int(-size // block_words))
    schema = MATCHES.format(index.schema["doc_id"].dataType.elementType.simpleString())
    out = None
    for b in range(blocks):
        part = picked if blocks == 1 else picked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = part.orderBy("item_id", "text").collect()  # about block_words words
        hashed = [(r.item_id, h) for r, h in zip(got, term_hashes([r.text for r in got]), strict=True) if len(h)]
        # stored, as segments are large and the batches of a table that is written are small
        found = stored(index.mapInArrow(_search([i for i, _ in hashed], [h for _, h in hashed], width, span), schema), "found")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:  # one index: (seg, ord) names a document in every block
        out = out.groupBy("seg", "ord", "doc_id", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"))
    return out


def covered(matches: str = "matches") -> Column:
    """Number of words that the matches cover, each counted once."""
    runs = f"array_sort(transform({matches}, m -> struct(m.start as a, m.start + m.length as b)))"
    return F.expr(f"aggregate({runs}, struct(0 as n, 0 as upto), (s, m) -> struct(s.n + greatest(0, m.b - greatest(m.a, s.upto)) as n, greatest(s.upto, m.b) as upto), s -> s.n)").cast("long")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """find_items' rows with n_hit, item_ids (distinct, sorted as strings) and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    out = found.withColumn("n_hit", covered())
    ids = F.expr("array_sort(array_distinct(transform(matches, m -> cast(m.item_id as string))))")
    return out.withColumn("item_ids", ids).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, **columns) -> DataFrame:
    """judged() of find_items()."""
    return judged(find_items(docs, items, width, **columns), share)


def contaminated_ids(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text", id_type: str = "long") -> DataFrame:
    """Stored doc_ids of contaminated documents; the index is gone when this returns."""
    index = build_index(docs, doc_id, text, id_type)
    out = stored(judged(search_index(index, items, width), share).where("contaminated").select("doc_id"), "contaminated")
    drop(index)
    return out
