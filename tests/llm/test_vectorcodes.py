"""Vector codes against brute force: all distances, Python's numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from siftwright.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<double>, label int, codes string"


def brute(rows, parts, entries, rounds, scale=4096):
    """Codes and errors of rows (vec_id, vector), and the codebooks, with every distance computed."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return [], []
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == n]
    w = n // parts
    whole = [[math.floor(Fraction(x) * scale) for x in v] for _, v in ok]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(ok)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, book: min((far(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for c in cut:
                mine[pick(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)]
    out = []
    for (i, _), c in zip(ok, cut, strict=True):
        got = [pick(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(g[1] for g in got).hex(), min(sum(g[0] for g in got), V.LONG)))
    return out, books


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 12).tolist()) for i in range(60)]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (7, rows[9][1])]  # copies, repeated ids, no id
    rows += [(200, None), (201, []), (202, [0.0] * 12), (203, [float("nan")] + [0.1] * 11), (204, [float("inf")] + [0.1] * 11), (205, [None] + [0.1] * 11), (206, [0.1] * 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def same(spark, rows, **kw):
    s = V.Settings(**kw)
    out, books = V.compress(frame(spark, rows), s)
    want, want_books = brute(rows, s.parts, s.entries, s.rounds)
    assert sorted(((r.vec_id, bytes(r.codes).hex(), r.error) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert V.listed(books) == ",".join(str(x) for b in want_books for e in b for x in e)


def test_codes_of_odd_vectors(spark):
    same(spark, odd_vectors(), parts=4, entries=5, rounds=3)


@pytest.mark.parametrize("size", [1e4, 1e9, 1e25, 1e300])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 1, 4) * (size if i % 3 else 1)).tolist()) for i in range(20)]
    same(spark, rows, parts=2, entries=4, rounds=2)


def test_few_rows_and_none(spark):
    same(spark, odd_vectors()[:2], parts=3, entries=16, rounds=2)
    out, books = V.compress(frame(spark, [(1, None)]))
    assert out.collect() == [] and books == []
    with pytest.raises(ValueError):
        V.compress(frame(spark, [(1, [0.5] * 12)]), V.Settings(parts=8))


def test_ties_go_to_the_lower_index():
    x = np.array([[0, 0], [2, 0]], np.int64)
    e = np.array([[1, 0], [-1, 0], [0, 1], [1, 0]], np.int64)
    for kind in (np.int64, object):
        code, far, _ = V.nearest(x, e.astype(kind))
        assert code.tolist() == [0, 0] and far.tolist() == [1, 1]


def test_annulus_spares_distances_and_loses_none():
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 1, (3000, 8)) * rng.uniform(1, 900, (3000, 1))).astype(np.int64)
    e = (rng.normal(0, 1, (64, 8)) * rng.uniform(1, 900, (64, 1))).astype(np.int64)
    code, far, seen = V.nearest(x, e)
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (d.argmin(1) == code).all() and (d.min(1) == far).all()
    assert seen < 0.65 * d.size


def test_limbs():
    for v in (0, 1, -1, 1 << 31, -(1 << 40), (1 << 90) + 5, -(1 << 90) - 7):
        assert sum(x << (32 * i) for i, x in enumerate(V._limbs(v))) == v
