r"""Approximate nearest neighbours by cosine, with score-aware anisotropic quantisation.

Vectors are scaled to length 1, so the largest inner product is the largest
cosine.  Each is put into the cell of its nearest centroid and, where a table
has more cells than centroids, of the inner centroid nearest to what is left
(every pair of the two is a cell), and what is left then is coded in 4-bit codes, one for each few dimensions.  Codes and codebooks
minimise a loss that weighs the error along the vector (which moves its score)
``eta`` + 1 times as much as the error across it.  A query looks into the cells
that score best (as many as the sample shows to be needed), adds up table
entries for all codes there (two codes are packed in a byte, and their tables
paired, so one look-up serves both), and ranks again, on the original vectors in double precision, all rows whose sum may still reach
the k-th best: a sum is off by at most the length of what the row's code
misses, which is stored with the code.

Centroids and codebooks are fitted on a bounded sample (``Settings.sample``);
all rows are indexed.  A cell of many rows is split into parts, and its queries
into blocks; each part meets each block apart, so a vector that holds a third
of the table fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # most rows that centroids and codebooks are fitted on
    cells: int = 1_024  # most centroids; there are about as many cells as the root of the rows
    inner: int = 256  # most inner centroids, by which a centroid's rows are parted where the root of the rows is larger
    found: float = 0.99  # part of true neighbours that lie in the cells looked into, measured on the sample
    width: int = 4  # dimensions in a code
    threshold: float = 0.2  # score, as a part of the length, above which errors along the vector count
    shortlist: int = 64  # rows of a cell that are ranked exactly first; their k-th best score tells which others may beat it
    rows: int = 20_000  # most rows of a cell searched in one task
    queries: int = 20_000  # most queries that a part meets in one task
    rounds: int = 8


@dataclass
class Codec:
    centroids: np.ndarray
    inner: np.ndarray  # a single zero where centroids alone make the cells
    books: np.ndarray  # (codes, 16, width)
    eta: float
    dims: int

    @property
    def n_cells(self) -> int:
        return len(self.centroids) * len(self.inner)

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            first = (part @ self.centroids.T).argmax(1)
            out[i : i + 4096] = first * len(self.inner) + _nearest(part - self.centroids[first], self.inner)
        return out

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.centroids[cell // len(self.inner)] + self.inner[cell % len(self.inner)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Inner products with the centres of all cells."""
        return ((x @ self.centroids.T)[:, :, None] + (x @ self.inner.T)[:, None, :]).reshape(len(x), -1)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Coordinate descent on |e|^2 + eta (e.x)^2, e what the codes miss of the residual."""
        r, xs = self.blocks(x - self.centre(cell)), self.blocks(x)
        plain = ((r[:, :, None, :] - self.books[None]) ** 2).sum(3)
        along = np.einsum("nmw,mkw->nmk", xs, self.books)
        code = plain.argmin(2)
        aim = np.einsum("nmw,nmw->n", xs, r)
        rows = np.arange(len(x))
        for _ in range(2):
            total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
            for s in range(code.shape[1]):
                rest = aim - (total - along[rows, s, code[:, s]])
                new = (plain[:, s] + self.eta * (rest[:, None] - along[:, s]) ** 2).argmin(1)
                total += along[rows, s, new] - along[rows, s, code[:, s]]
                code[:, s] = new
        return code.astype(np.uint8)


def _centroids(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total**2).sum(1))
        empty = size < 1e-9
        total[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        size[empty] = 1
        c = total / size[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * (x @ c.T) - (c**2).sum(1)).argmax(1)


def _inner(rest: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means of what the centroids leave."""
    if n <= 1:
        return np.zeros((1, rest.shape[1]))
    c = rest[rng.choice(len(rest), n, replace=False)]
    for _ in range(rounds):
        own = _nearest(rest, c)
        total = np.zeros_like(c)
        np.add.at(total, own, rest)
        size = np.bincount(own, minlength=n)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def fit(x: np.ndarray, n_rows: int, s: Settings = Settings()) -> Codec:
    """x: a sample of vectors of length 1, of a table of n_rows."""
    rng = np.random.default_rng(7)
    dims = x.shape[1]
    wanted = n_rows**0.5 if n_rows > 1000 else 1
    n = int(max(1, min(s.cells, len(x) // 8, round(wanted))))
    c = _centroids(x, n, s.rounds, rng)
    inner = _inner(x - c[(x @ c.T).argmax(1)], int(min(s.inner, len(x) // 8, round(wanted / n))), s.rounds, rng)
    m = -(-dims // s.width)
    eta = (dims - 1) * s.threshold**2 / (1 - s.threshold**2)
    out = Codec(c, inner, np.zeros((m, 16, s.width)), eta, dims)
    x = x[rng.permutation(len(x))[:8192]]
    cell = out.cells(x)
    r, xs = out.blocks(x - out.centre(cell)), out.blocks(x)
    out.books = np.stack([r[rng.choice(len(r), 16, replace=len(r) < 16), i] for i in range(m)])
    code = ((r[:, :, None, :] - out.books[None]) ** 2).sum(3).argmin(2)
    for turn in range(s.rounds):
        if turn < s.rounds - 2:  # plain k-means in each block first
            for i in range(m):
                n_of = np.bincount(code[:, i], minlength=16)
                total = np.stack([np.bincount(code[:, i], r[:, i, k], 16) for k in range(s.width)], 1)
                out.books[i] = np.where(n_of[:, None] > 0, total / np.maximum(n_of, 1)[:, None], out.books[i])
            code = ((r[:, :, None, :] - out.books[None]) ** 2).sum(3).argmin(2)
            continue
        # all codewords at once: (diag(counts) + eta Z'Z) books = A'r + eta Z'(x.r), Z the vectors spread over their codes
        z = np.zeros((len(x), m, 16, s.width))
        z[np.arange(len(x))[:, None], np.arange(m)[None, :], code] = xs
        z = z.reshape(len(x), -1)
        a = np.zeros((m, 16, s.width))
        count = np.zeros((m, 16))
        for i in range(m):
            np.add.at(a[i], code[:, i], r[:, i])
            count[i] = np.bincount(code[:, i], minlength=16)
        left = eta * (z.T @ z) + np.diag(np.repeat(count.ravel(), s.width) + 1e-6)
        right = a.ravel() + eta * (z.T @ np.einsum("nmw,nmw->n", xs, r))
        out.books = np.linalg.solve(left, right).reshape(m, 16, s.width)
        code = out.encode(x, cell).astype(np.int64)
    return out


def probes(codec: Codec, x: np.ndarray, k: int, found: float) -> int:
    """Cells to look into so that part ``found`` of the sample's true neighbours is met.

    A sample is sparser than its table, so its neighbours lie farther off: the
    figure errs to the safe side.
    """
    some = x[:: max(1, len(x) // 256)]
    near = np.argsort(-(some @ x.T), axis=1)[:, 1 : k + 1]
    own = codec.cells(x)
    at = np.zeros(near.shape, np.int64)
    for i, u in enumerate(some):
        place = np.empty(codec.n_cells, np.int64)
        place[np.argsort(-codec.scores(u[None])[0])] = np.arange(codec.n_cells)
        at[i] = place[own[near[i]]]
    return int(np.quantile(at, found, method="higher")) + 1 if at.size else codec.n_cells


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def packed(code: np.ndarray) -> np.ndarray:
    """Two codes a byte, an odd one alone."""
    out = code[:, ::2] << 4
    out[:, : code.shape[1] // 2] |= code[:, 1::2]
    return out


def paired(tables: np.ndarray) -> np.ndarray:
    """Tables of 256 entries for packed codes, of tables of 16 entries for each code."""
    m = len(tables)
    if m % 2:
        tables = np.concatenate([tables, np.zeros((1, 16))])
    return (tables[::2, :, None] + tables[1::2, None, :]).reshape(-1, 256)


def _missed(codec: Codec, x: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Length of what the codes miss of each row: for a query of length 1 no score is farther off."""
    told = codec.books[np.arange(code.shape[1])[None, :], code]
    return np.sqrt(((codec.blocks(x - codec.centre(cell)) - told) ** 2).sum((1, 2)))


def _index(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                x = _unit(_matrix(part.column("v"), codec.dims))
                cell = codec.cells(x)
                code = codec.encode(x, cell)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in packed(code)], pa.binary()), pa.array(_missed(codec, x, cell, code))], ["vec_id", "v", "cell", "code", "missed"])

    return run


def _probe(codec: Codec, probes: int):
    step = max(1, min(2048, (1 << 22) // codec.n_cells))  # about 32 MB of scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                score = codec.scores(_unit(_matrix(part.column("v"), codec.dims)))
                n = min(probes, score.shape[1])
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                rows = pa.array(np.repeat(np.arange(len(part)), n))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(rows), part.column("v").take(rows), pa.array(best.ravel().astype(np.int32))], ["query_id", "v", "cell"])

    return run


def _scan(codec: Codec, k: int, shortlist: int):
    """One part of a cell against the queries that look into it."""
    names = ["query_id", "vec_id", "score"]
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return empty
        rows = rows.sort_by("vec_id")
        ids = rows.column("vec_id").to_numpy()
        v = _matrix(rows.column("v"), codec.dims)
        norm = np.sqrt((v * v).sum(1))
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        q_ids, q_all = queries.column("query_id").to_numpy(), _matrix(queries.column("v"), codec.dims)
        missed = rows.column("missed").to_numpy() + 1e-9  # and what rounding adds
        base = codec.centre(np.array([rows.column("cell")[0].as_py()]))[0]
        out = []
        for q_id, q in zip(q_ids, q_all, strict=True):
            u = q / np.sqrt((q * q).sum())
            tables = paired(np.einsum("mw,mkw->mk", codec.blocks(u[None])[0], codec.books))
            near = np.full(len(ids), u @ base)
            for s in range(code.shape[1]):
                near += tables[s][code[:, s]]
            near[ids == q_id] = -np.inf
            exactly = lambda at, q=q: (v[at] * q).sum(1) / (norm[at] * np.sqrt((q * q).sum()))
            n = min(max(shortlist, k), len(ids))
            first = np.argpartition(near, len(ids) - n)[len(ids) - n :]
            first = first[ids[first] != q_id]
            # whatever may reach the k-th best of these, ties included
            least = np.partition(exactly(first), len(first) - k)[len(first) - k] if len(first) > k else -np.inf
            at = np.flatnonzero(near + missed >= least)
            at = at[ids[at] != q_id]
            exact = exactly(at)
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best), q_id), ids[at][best], exact[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each query its k nearest other rows found: query_id, rank (from 1), vec_id, score (cosine, on original vectors).

    Nearest first, ties to the smaller vec_id.  A row whose vector or id is
    null, or whose vector is zero, holds null or non-finite components, or has
    another length than most (the longer of two as common), takes no part.  A
    query's own id is not among its candidates.  A query that finds fewer than
    k in its cells looks into 32 times as many, in the end into all.  Repeated rows count apart.  Empty
    tables give an empty result; other columns are ignored.
    """
    good = f"{vec_id} is not null and {embedding} is not null and forall({embedding}, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists({embedding}, c -> c <> 0)"
    pick = lambda d: d.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    rows = pick(vectors)
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n_rows = lengths[0]
    rows, asked = rows.where(F.size("v") == dims), pick(queries).where(F.size("v") == dims)
    share = min(1.0, 1.2 * settings.sample / n_rows)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toPandas()
    x = _unit(np.stack(drawn["v"].to_numpy())) if len(drawn) else np.eye(1, dims)
    codec = fit(x, n_rows, settings)
    few = probes(codec, x, k, settings.found)
    float_v = F.col("v").cast("array<double>").alias("v")
    index = stored(rows.select("vec_id", float_v).mapInArrow(_index(codec), "vec_id long, v array<double>, cell int, code binary, missed double"), "ann")
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / settings.rows).cast("int").alias("parts"))
    sizes = F.broadcast(stored(sizes, "cells"))  # a row a cell: at most settings.cells * settings.inner
    dealt = index.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).select("cell", "part", "vec_id", "v", "code", "missed")

    def search(some: DataFrame, probes: int) -> DataFrame:
        looked = some.mapInArrow(_probe(codec, probes), "query_id long, v array<double>, cell int")
        looked = stored(looked, "looked")
        blocks = stored(looked.groupBy("cell").agg(F.ceil(F.count("*") / settings.queries).cast("int").alias("blocks")), "blocks")
        blocks = F.broadcast(blocks)  # a row a cell: at most settings.cells * settings.inner
        asking = looked.join(sizes, "cell").join(blocks, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select("cell", "part", "block", "query_id", "v")
        rows = dealt.join(blocks, "cell").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        found = rows.groupBy("cell", "part", "block").cogroup(asking.groupBy("cell", "part", "block")).applyInArrow(_scan(codec, k, settings.shortlist), "query_id long, vec_id long, score double")
        best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
        return best

    some = asked.dropDuplicates(["vec_id"])
    best = stored(search(some, few), "found")
    while n_rows > 1 and few < codec.n_cells:
        short = some.join(best.where(F.size("best") >= min(k, n_rows - 1)).withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
        if short.isEmpty():
            break
        few = min(32 * few, codec.n_cells)
        again = stored(search(short, few), "found")
        best = best.join(again, "query_id", "left_anti").unionByName(again)
    out = best.select("query_id", F.posexplode("best").alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
