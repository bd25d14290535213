r"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie over bytes with failure links: where a node has no
child for the next byte, the pieces that greedy matching would emit are popped
and matching goes on at the failure node, so no byte is read twice.  Only the
number of popped pieces is kept for each node; no piece is ever built.

A word is matched with one marker byte before it (a space), as vocabularies
hold it.  Words of a chunk are counted once each, all of them one byte at a
time; words over ``LONG`` bytes go through the same automaton one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NOT_SPACE, Words, text_chunks, words_of

LONG = 64


@dataclass
class Automaton:
    key: np.ndarray  # sorted node * 256 + byte
    child: np.ndarray
    fail: np.ndarray  # -1: no way on
    pops: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        k = node * 256 + byte
        i = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[i] == k, self.child[i], -1)

    def count(self, columns: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """Pieces of n words, given for each byte place (words that reach it, their bytes); an unmatched word is one piece."""
        node, out, dead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for who, byte in columns:
            live = ~dead[who]
            who, byte = who[live], byte[live]
            while len(who):
                to = self.step(node[who], byte)
                on = to >= 0
                node[who[on]] = to[on]
                who, byte = who[~on], byte[~on]
                out[who] += self.pops[node[who]]
                node[who] = self.fail[node[who]]
                lost = node[who] < 0
                dead[who[lost]] = True
                who, byte = who[~lost], byte[~lost]
        who = np.flatnonzero(~dead & (node != 0))
        while len(who):
            out[who] += self.pops[node[who]]
            node[who] = self.fail[node[who]]
            dead[who[node[who] < 0]] = True
            who = who[node[who] > 0]
        return np.where(dead, 1, out)


def build(vocabulary: list[bytes]) -> Automaton:
    """The automaton of distinct nonempty pieces."""
    children: list[dict[int, int]] = [{}]
    final, parent, label = [False], [0], [0]
    for piece in vocabulary:
        v = 0
        for b in piece:
            if b not in children[v]:
                children[v][b] = len(children)
                children.append({})
                final.append(False)
                parent.append(v)
                label.append(b)
            v = children[v][b]
        final[v] = final[v] or v > 0
    fail, pops = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        level = [v for u in level for v in children[u].values()]
        for v in level:
            if final[v]:
                fail[v], pops[v] = 0, 1
                continue
            z, n = fail[parent[v]], pops[parent[v]]
            while z >= 0 and label[v] not in children[z]:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = children[z][label[v]], n
    pairs = sorted((u * 256 + b, v) for u, own in enumerate(children) for b, v in own.items()) or [(-1, 0)]
    key, child = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return Automaton(key, child, np.array(fail, np.int64), np.array(pops, np.int64))


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces of a ranks file (base64 piece and rank on each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def _word_counts(w: Words, h: np.ndarray, automaton: Automaton, mark: bytes) -> np.ndarray:
    lens = w.end - w.start
    _, rep, back = np.unique(h, return_index=True, return_inverse=True)
    out = np.zeros(len(rep), np.int64)
    short = np.flatnonzero(lens[rep] <= LONG)
    start, n = w.start[rep[short]], lens[rep[short]]

    def columns(start, n):
        for b in mark:
            yield np.arange(len(start)), np.full(len(start), b, np.int64)
        for j in range(int(n.max(initial=0))):
            who = np.flatnonzero(n > j)
            yield who, w.data[start[who] + j].astype(np.int64)

    out[short] = automaton.count(columns(start, n), len(short))
    far = np.flatnonzero(lens[rep] > LONG)
    if len(far):
        jump = dict(zip(automaton.key.tolist(), automaton.child.tolist(), strict=True))
        fail, pops = automaton.fail.tolist(), automaton.pops.tolist()
        for i in far.tolist():
            node, total = 0, 0
            for b in mark + w.data[w.start[rep[i]] : w.end[rep[i]]].tobytes():
                while node >= 0 and (to := jump.get(node * 256 + b)) is None:
                    total += pops[node]
                    node = fail[node]
                if node < 0:
                    break
                node = to
            while node > 0:
                total += pops[node]
                node = fail[node]
            out[i] = total if node == 0 else 1
    return out[back]


def _counts(automaton: Automaton, mark: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column("text")):
                w = words_of(data, off, NOT_SPACE)
                total = np.r_[0, np.cumsum(_word_counts(w, w.hashes(), automaton, mark))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]])], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: list[bytes], mark: bytes = b" ", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    r"""One row per document: doc_id, n_words (``[^\x20\x09-\x0D]+``), n_tokens.

    A word that the vocabulary cannot spell is one token.  A null or empty text
    has none.  Nulls in doc_id, repeated rows and an empty table pass through;
    other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_counts(build(vocabulary), mark), "doc_id long, n_words long, n_tokens long")
