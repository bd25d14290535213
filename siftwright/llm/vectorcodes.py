r"""Vector code compression: integer codebooks per part of a vector, nearest entries by annular norm pruning.

A vector is scaled to whole numbers and cut into equal parts; each part is
replaced by the index of its nearest codebook entry.  An entry at distance d
from x has a norm within d of x's norm.  So entries are sorted by norm, the one
nearest in norm gives a first distance, a binary search finds the annulus of
norms that this distance allows, and only entries inside it (ends included) are
evaluated, exactly, in whole numbers; the annulus narrows with every better
distance.  Codebooks are refined in rounds: each is a pass over the table whose
tasks send one partial sum per entry and component, so what is shuffled and
what reaches the driver has the size of the codebooks, whatever the table's.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: components that one slice of a batch holds at most (or one vector)
SLICE = 1 << 20
LONG = (1 << 63) - 1
_LIMB = 32


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def kept_vectors(rows: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows (vec_id, ``carry``, x) whose vector takes part, and its length.

    Null vectors and those with a null, NaN or infinite component are dropped.
    The length is that of the vector of the smallest vec_id (nulls last, ties
    by the vector); codes need one length, so others do not take part.  It
    must be a multiple of ``settings.parts``.
    """
    x = F.col("x")
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), *[F.col(c) for c in carry], F.col(vector).cast("array<double>").alias("x"))
    out = out.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    first = out.orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x").alias("n")).first()
    if first is None:
        return out, 0
    if first.n % settings.parts:
        raise ValueError(f"vectors of {first.n} components have no {settings.parts} equal parts")
    return out.where(F.size(x) == first.n), first.n


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where that holds the distances too, else as Python's numbers."""
    if not x.size or np.abs(x).max() * scale < 1 << 24:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _small(a: np.ndarray, width: int) -> bool:
    return a.dtype != object and (not a.size or 4 * width * int(np.abs(a).max()) ** 2 < 1 << 62)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: the lower index), and how many distances were evaluated."""
    if not (_small(x, x.shape[1]) and _small(entries, x.shape[1])):
        return _nearest_wide(x, entries)
    square = (entries * entries).sum(1)
    order = np.argsort(square, kind="stable")
    e, norm = entries[order], np.sqrt(square[order])
    k, own = len(e), np.sqrt((x * x).sum(1))
    at = np.searchsorted(norm, own)
    left, right = np.maximum(at - 1, 0), np.minimum(at, k - 1)
    mid = np.where(own - norm[left] <= norm[right] - own, left, right)
    best = ((x - e[mid]) ** 2).sum(1)
    code, seen = order[mid], len(x)

    def annulus(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.sqrt(best[rows])
        far += 1e-6 + 1e-9 * (far + own[rows])  # rounding of norms never shuts an entry out
        return np.searchsorted(norm, own[rows] - far, "left"), np.searchsorted(norm, own[rows] + far, "right")

    lo, hi = annulus(np.arange(len(x)))
    for step in range(1, k):
        still = False
        for j in (mid - step, mid + step):
            rows = np.flatnonzero((j >= lo) & (j < hi))
            if not len(rows):
                continue
            still, seen = True, seen + len(rows)
            d, c = ((x[rows] - e[j[rows]]) ** 2).sum(1), order[j[rows]]
            better = (d < best[rows]) | ((d == best[rows]) & (c < code[rows]))
            rows = rows[better]
            best[rows], code[rows] = d[better], c[better]
            lo[rows], hi[rows] = annulus(rows)
        if not still:
            break
    return code, best, seen


def _nearest_wide(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same in numbers of any size, a row at a time; norms are rounded down, so the annulus is one wider at either end."""
    named = sorted((math.isqrt(sum(int(v) ** 2 for v in row)), i) for i, row in enumerate(entries.tolist()))
    norm, wide = [n for n, _ in named], [[int(v) for v in row] for row in entries.tolist()]
    codes, far, seen = [], [], 0
    for row in x.tolist():
        own = math.isqrt(sum(int(v) ** 2 for v in row))
        at = min(bisect_left(norm, own), len(norm) - 1)
        distance = lambda i, row=row: sum((int(a) - b) ** 2 for a, b in zip(row, wide[i], strict=True))
        best = (distance(named[at][1]), named[at][1])
        r = math.isqrt(best[0]) + 2
        for _, i in named[bisect_left(norm, own - r) : bisect_right(norm, own + r)]:
            best, seen = min(best, (distance(i), i)), seen + 1
        codes.append(best[1])
        far.append(best[0])
    return np.array(codes, np.int64), np.array(far, object), seen


def _vectors(batch: pa.RecordBatch, length: int, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, whole numbers) of a batch's vectors, some rows at a time."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    rows = max(1, SLICE // length)
    for lo in range(0, len(flat), rows):
        part = flat[lo : lo + rows]
        yield lo, lo + len(part), whole_numbers(part, scale)


def _limbs(total: int) -> list[int]:
    """Digits of a whole number to the base 2**32, lowest first; the highest bears the sign."""
    out = []
    while not -(1 << _LIMB) <= total < 1 << _LIMB:
        out.append(total & ((1 << _LIMB) - 1))
        total >>= _LIMB
    return [*out, total]


def _sums(codebooks: list[np.ndarray], length: int, scale: int) -> Callable:
    """One task's sums as rows (slot, limb, total); slots count components of all entries, then the entries' parts."""
    width, k = length // len(codebooks), len(codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(codebooks), k, width), object)
        count = np.zeros((len(codebooks), k), np.int64)
        for batch in batches:
            for _, _, x in _vectors(batch, length, scale):
                for p, book in enumerate(codebooks):
                    mine = x[:, p * width : (p + 1) * width]
                    code, _, _ = nearest(mine, book)
                    count[p] += np.bincount(code, minlength=k)
                    for e in np.unique(code):
                        total[p, e] += mine[code == e].sum(0)
        rows = [(slot, i, v) for slot, t in enumerate(total.ravel().tolist()) if t for i, v in enumerate(_limbs(int(t)))]
        rows += [(total.size + slot, 0, int(n)) for slot, n in enumerate(count.ravel()) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["slot", "limb", "total"])

    return run


def _books(flat: np.ndarray) -> np.ndarray:
    """As int64 where the numbers fit."""
    return flat.astype(np.int64) if all(abs(v) < 1 << 62 for v in flat.ravel().tolist()) else flat


def fit_codebooks(kept: DataFrame, length: int, settings: Settings = Settings()) -> list[np.ndarray]:
    """One array (entries, components) of whole numbers per part.

    They start as the parts of the first ``settings.entries`` rows by vec_id
    (nulls last, ties by the vector; fewer rows, fewer entries).  Each round
    assigns every part to its nearest entry and moves an entry to the
    componentwise floor of its parts' mean; an entry without parts stays.
    """
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(settings.entries).select("x").collect()
    width = length // settings.parts
    flat = whole_numbers(np.array([r.x for r in start]), settings.scale)
    books = [flat[:, p * width : (p + 1) * width] for p in range(settings.parts)]
    k = len(start)
    for _ in range(settings.rounds):
        parts = kept.select("x").mapInArrow(_sums(books, length, settings.scale), "slot long, limb long, total long")
        got = parts.groupBy("slot", "limb").agg(F.sum("total").alias("total")).collect()  # of the codebooks' size
        total = np.zeros(settings.parts * k * width + settings.parts * k, object)
        for r in got:
            total[r.slot] += r.total << (_LIMB * r.limb)
        sums, count = total[: settings.parts * k * width].reshape(settings.parts, k, width), total[settings.parts * k * width :].reshape(settings.parts, k)
        books = [_books(np.array([sums[p, e] // count[p, e] if count[p, e] else books[p][e].astype(object) for e in range(k)], object)) for p in range(settings.parts)]
    return books


def encode(kept: DataFrame, length: int, codebooks: list[np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """All columns of ``kept`` but x, codes (one byte per part) and error (squared distances summed over the parts; one that a long cannot hold is the largest long)."""
    width = length // settings.parts
    names = [f.name for f in kept.schema.fields if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _vectors(batch, length, settings.scale):
                codes, far = np.zeros((hi - lo, settings.parts), np.uint8), np.zeros(hi - lo, object)
                for p, book in enumerate(codebooks):
                    code, d, _ = nearest(x[:, p * width : (p + 1) * width], book)
                    codes[:, p] = code
                    far = far + d
                got = [batch.column(n)[lo:hi] for n in names] + [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(int(v), LONG) for v in far], pa.int64())]
                yield pa.RecordBatch.from_arrays(got, [*names, "codes", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "x")
    return kept.mapInArrow(run, f"{schema}, codes binary, error long")


def listed(codebooks: list[np.ndarray]) -> str:
    """All entries' components in decimal by part, entry and place, joined by commas."""
    return ",".join(str(int(v)) for book in codebooks for v in book.ravel().tolist())


def compress(rows: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of every vector that takes part (kept_vectors), and the codebooks they refer to.

    Rows are read once a round and twice more, so ``rows`` should be a stored
    table.  Repeated rows are rows of their own and a null vec_id is kept;
    further columns are ignored but those of ``carry``, which are called
    neither vec_id, x, codes nor error.  Without a row that takes part the
    result is empty and there are no codebooks.  A vector of any length is
    handled ``SLICE`` components at a time; components of any size are exact.
    """
    kept, length = kept_vectors(rows, settings, vec_id, vector, carry)
    if not length:
        return kept.drop("x").withColumn("codes", F.lit(b"")).withColumn("error", F.lit(0).cast("long")), []
    books = fit_codebooks(kept, length, settings)
    return encode(kept, length, books, settings), books
