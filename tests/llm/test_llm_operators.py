"""Corpus operators against brute force on small tables with every odd case, and on the smallest driver tables."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwright.llm import ann, decontam, linededup, mixing, ngram_join, quality, sharding, storage, substring, warc, wordpiece
from siftwright.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, h string, sid long, n int, shard int, score string"
EXTRA = (1, "x", 2, 3, 4, "y")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "δέλτα", "x" * 90, "e", "zeta,", "eta."]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n)) for n in (60, 80, 200, 45)]
    near = [" ".join(w if rng.random() > 0.02 else "zz" for w in base[0].split()) for _ in range(12)]
    long = " ".join(str(rng.randrange(500)) for _ in range(9000))
    texts = [*base, *near, base[1], base[1], base[2] + "\n" + base[0], None, "", " \t\n", "one two", "One two", "a", long, long + " tail", base[0] + "\x1c" + base[0], "Ab\x0bcd ef\x85gh"]
    rows = [(i, t, f"s{i % 4}" if i % 5 else None, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base[3], "s1", *EXTRA), (None, None, None, *EXTRA), (7, base[2], "s2", *EXTRA)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(rows, n, percent):
    """Component's smallest id for each row, by all pairs of sets."""
    sets = [shingles(r[1], n) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    return [(r[0], len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, none, n, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_sets(docs, n, percent).collect())
    assert got == Counter(linked(rows, n, percent))
    assert ngram_join.link_sets(none).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())
    assert got == Counter(linked(rows, 4, 85))


@pytest.mark.parametrize("percent", [80, 85])
def test_survivor_filter_loses_no_link(percent):
    rng = np.random.default_rng(percent)
    sets, pairs = [], 20_000
    for _ in range(pairs):
        n = int(rng.integers(2, 41))
        own = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        most = n * 100 // percent  # the largest set that n may link to
        m = int(rng.integers(n, most + 1))
        common = int(rng.integers(-(-percent * (n + m) // (100 + percent)), n + 1))
        sets += [np.sort(own[:n]), np.sort(np.r_[own[:common], own[n : n + m - common]])]
    doc, name = ngram_join.segment_names(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])], percent)
    names = [set() for _ in sets]
    for d, x in zip(doc.tolist(), name.tolist(), strict=True):
        names[d].add(x)
    assert all(names[i] & names[i + 1] for i in range(0, 2 * pairs, 2))


@pytest.mark.parametrize("percent", [80, 85])
def test_names_of_larger_sets_lose_no_link(percent):
    rng = np.random.default_rng(percent + 1)
    sets, pairs = [], 3_000
    for _ in range(pairs):
        n = int(rng.integers(40, 500))
        own = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        m = int(rng.integers(n, n * 100 // percent + 1))
        common = -(-percent * (n + m) // (100 + percent))  # as few as still link
        sets += [np.sort(own[:n]), np.sort(np.r_[own[:common], own[n : n + m - common]])]
    doc, name = ngram_join.segment_names(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])], percent)
    names = [set() for _ in sets]
    for d, x in zip(doc.tolist(), name.tolist(), strict=True):
        names[d].add(x)
    assert all(names[i] & names[i + 1] for i in range(0, 2 * pairs, 2))
    # and sets that have nothing in common share none
    assert not any(names[i] & names[i + 2] for i in range(0, 2 * pairs - 2, 2))


def test_ngram_join_of_short_texts(spark):
    percent, rng = 80, random.Random(80)
    rows = []
    for i in range(0, 6000, 2):
        w = [f"{i}w{k}" for k in range(rng.randrange(5, 20))]
        cut = rng.randrange(2)
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[cut:] + [f"{i}x"] * rng.randrange(2)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()}
    for i in range(0, len(rows), 2):
        assert [(i, *got[i]), (i + 1, *got[i + 1])] == linked(rows[i : i + 2], 4, percent)


def test_ngram_join_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)  # several blocks
    monkeypatch.setattr(ngram_join, "SEGMENT", 16)  # many fragments
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 7)  # lists cut too
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    texts = ["lone text of its own", "one two three four five six", "one two three four five six"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        texts.append(" ".join(w))
    pair = [str(i) for i in range(60)]
    texts += [" ".join(pair), " ".join(pair[1:])]
    sets = [shingles(x, 4) for x in texts]
    want = {i: len({b for b in sets if b != a and 100 * len(a & b) >= 85 * len(a | b)}) for i, a in enumerate(sets)}
    out = ngram_join.link_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85)
    assert {r.doc_id: r.links for r in out.collect()} == want


def test_one_of_each_keeps_rows_without_words(docs, rows):
    kept = ngram_join.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    empty = Counter((r[0], r[1]) for r in rows if not WORD.findall(r[1] or ""))
    want = {c for _, k, c in linked(rows, 5, 80) if k}
    assert got - empty and all(got[k] == n for k, n in empty.items())
    assert sorted(d for d, t in got if WORD.findall(t or "")) == sorted(want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 5), (7, 8), (8, 7), (None, 1)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 7: 7, 8: 7} | {i: 20 for i in range(20, 61)}


def test_warc_round_trip_with_magic_inside(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    htmls = [None, "", "plain", inner, inner * 3 + "tail", "x WARC/1.1\r\n y", "WARC/1.1\r\n", "é\r\n\r\nü" * 50, "plain", None, "z" * 300_000, "WARC/1.1\r\nContent-Length: 999999999\r\n\r\n"]
    pages = [(i, f"http://h/{i}\r\n", h, "c") for i, h in enumerate(htmls)] + [(2, None, "plain", "c"), (None, "u", "plain", "c"), (None, "v", "only", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").coalesce(2)
    top = {}
    for p, _, h, _ in pages:
        top[h or ""] = max([x for x in (top.get(h or ""), p) if x is not None], default=None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for payload in (False, True):
            out = warc.round_trip(df, payload=payload).collect()
            assert len(out) == len(pages)
            digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
            assert Counter((r.page_id, r.payload_bytes, r.digest) for r in out) == Counter((p, len((h or "").encode()), digest(h)) for p, _, h, _ in pages)
            for h, p in top.items():
                own = [r for r in out if r.digest == digest(h)]
                assert [(r.page_id, r.refers_to) for r in own if r.record_type == "response"] == [(p, None)]
                assert all(r.refers_to == p for r in own if r.record_type == "revisit")
            if payload:
                assert {bytes(r.payload).decode() for r in out if r.record_type == "response"} == set(top)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_mixing(docs, rows, none):
    out = mixing.mix_sources(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[2], size(r[1])) for r in rows)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        by[r.source][2] += r.taken
        by[r.source][3] = max(by[r.source][3], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6 and all(v[1] <= 2 * v[0] for v in by.values())
    assert sum(v[2] for v in by.values()) <= 1.5 * total
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in out) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix_sources(none).count() == 0


def test_mixing_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 500), (None, 300)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    w = dict(zip(["a", "b", "c", "d", None], (5, 2, 1, 5, 2), strict=True))
    left, want, budget = dict(sizes), {}, 1.5 * sum(s for _, s in sizes)
    while True:  # shares by weight, stopped at twice the size, the excess shared anew
        level = (budget - sum(want.values())) / sum(w[s] for s in left)
        full = [s for s in left if level * w[s] > 2 * left[s]]
        if not full:
            break
        want |= {s: 2.0 * left.pop(s) for s in full}
    want |= {s: level * w[s] for s in left}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("share", (1.5, 0.3, 1.99, 2.0, 2.5))
def test_mixing_targets_of_many_sources(spark, monkeypatch, share):
    rng = random.Random(5)
    sizes = [(f"s{i}" if i else None, rng.choice((0, 3, 10, rng.randrange(1, 5000)))) for i in range(700)]
    names = sorted((s for s, _ in sizes if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget = share * sum(n for _, n in sizes)
    lo, hi = 0.0, 1e5
    for _ in range(200):  # the level by halving
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2.0 * n, mid * w[s]) for s, n in sizes) < budget else (lo, mid)
    want = {s: min(2.0 * n, hi * w[s]) for s, n in sizes}
    df = spark.createDataFrame(sizes, "source string, source_size long").repartition(3)
    for last in (20_000, 5, 1):
        monkeypatch.setattr(mixing, "LAST", last)
        monkeypatch.setattr(mixing, "PARTS", 2048 if last > 5 else 4)
        got = mixing.targets(df, (5, 2, 1), share, 2.0).collect()
        assert [r.source for r in sorted(got, key=lambda r: r.nth)] == names and sorted(r.nth for r in got) == list(range(700))
        assert {r.source: r.target for r in got} == pytest.approx(want)


def test_quality(spark, docs, rows, none):
    sf = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.train(*sf, learn=~quality.held_out())
    scored = quality.score_documents(docs, trees)
    assert Counter((r.doc_id, r.text) for r in scored.collect()) == Counter((r[0], r[1]) for r in rows)
    assert scored.columns == docs.columns and scored.where("score not between 0 and 1 or score is null").count() == 0
    assert quality.score_documents(none, trees).count() == 0
    a, b = (quality.score_documents(sf[0].repartition(n), trees, score="q").select("doc_id", "q") for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert quality.train(none, sf[1], learn=F.lit(True)).score(np.zeros((2, quality.FEATURES))).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality.FEATURES))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    p = quality.fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v[100:400] = v[7]  # a vector of a fifth of all rows
    rows = [(i, [float(c) for c in x], 0) for i, x in enumerate(v)]
    bad = [(2000, None, 0), (2050, [0.0] * 24, 0), (2100, [float("nan")] * 24, 0), (2150, [None] + [1.0] * 23, 0), (None, rows[0][1], 0), (2200, [1.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cell int").repartition(3)
    out = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 1500, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        s = u @ u[q]
        s[q] = -9
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - c) < 1e-9 for _, i, c in own) and [c for *_, c in own] == sorted((c for *_, c in own), reverse=True)
        s = s.round(12)
        hit += len({i for _, i, _ in own} & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
    assert hit / 150 >= 0.9 and len(out) == 150
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5).collect()
    assert [r.rank for r in few] == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_in_a_large_group_of_near_equal_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24))
    v[1000:] = v[7] + rng.normal(size=(2000, 24)) * 1e-3
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = []
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hit.append(len(found[q] & set(np.argsort(-s)[:5].tolist())) / 5)
    print("recall", np.mean(hit), "in the group", np.mean(hit[20:]))
    assert np.mean(hit[20:]) >= 0.99 and np.mean(hit) >= 0.9


def test_decontamination(spark, docs, rows, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [(1, " ".join(words(rows[2][1])[20:60])), (2, "One, two"), (3, None), (4, "..."), (None, "a"), (5, "e"), (10, rows[0][1]), (1, "tail")]
    window = {}
    for i, t in items:
        w = words(t)
        for s in range(len(w) - min(13, len(w)) + 1 if w and i is not None else 0):
            window.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = Counter()
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for k in {len(x) for x in window}:
            for s in range(len(w) - k + 1):
                if ids := window.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    found |= ids
        want[(r[0], len(w), len(hit), tuple(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 30):
        out = decontam.contamination(docs, frame, block_words=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in out) == want
    assert decontam.contamination(none, frame).count() == 0
    assert decontam.contamination(docs, frame.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a . . . . b1 b2 b3 b4 b5 b c"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: [(m.start, m.length) for m in r.matches] for r in decontam.find_items(docs, items, span=5).collect()}
    assert got == {1: [(0, 5)], 2: [(0, 3)], 3: [], 4: []}


def test_line_dedup(spark, none):
    rows = [(i, f"own {i}\nshared\nfour" if i % 5 < 4 else "shared\n\nshared", f"s{i % 5}", "k") for i in range(20)] + [(50, None, "s1", "k"), (None, "shared", None, "k"), (51, "", "s2", "k"), (3, "shared", "s9", "k")]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, line string"), sites=5).collect()
    keep = lambda t: None if t is None else "\n".join(x for x in t.split("\n") if x != "shared")
    n = lambda t: 0 if t is None else t.count("\n") + 1
    gone = lambda t: 0 if t is None else t.split("\n").count("shared")
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in out) == Counter((r[0], n(r[1]), gone(r[1]), keep(r[1])) for r in rows)
    assert linededup.drop_boilerplate(none).count() == 0


def test_line_counts_are_exact_near_the_threshold(spark):
    rows = [(i, f"line {k}", f"s{i}") for k in range(30, 60) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert linededup.boilerplate(df, sites=45).count() == 15


def greedy(vocabulary, text, mark=b" "):
    total = 0
    for w in WORD.findall(text or ""):
        b, p, n = mark + w.encode(), 0, 0
        while p < len(b):
            q = len(b)
            while q > p and b[p:q] not in vocabulary:
                q -= 1
            if q == p:
                n = 1
                break
            n, p = n + 1, q
        total += n
    return total


def test_token_counts(docs, rows, none):
    rng = random.Random(2)
    small = {bytes(rng.choice(b" abde0123lphagmtz") for _ in range(rng.randrange(1, 6))) for _ in range(900)} | {b" ", b"x", b"xx", b"xxxxx"}
    for vocabulary in (sorted(small), wordpiece.load_vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken")):
        out = wordpiece.count_tokens(docs, vocabulary).collect()
        known = set(vocabulary)
        assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in out) == Counter((r[0], len(WORD.findall(r[1] or "")), greedy(known, r[1])) for r in rows)
    assert wordpiece.count_tokens(none, [b"a"]).count() == 0


def test_sharding(spark, docs, rows, none):
    out = sharding.assign_shards(docs, shards=4).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len(raw(r[1])) + 8, zlib.crc32(raw(r[1]))) for r in rows)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.assign_shards(none).count() == 0
    many = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot " * 30)).otherwise(F.concat(F.lit("t"), F.repeat(F.col("id").cast("string"), 20))).alias("text"))
    got = sharding.assign_shards(many, shards=24, doc_id="id").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r.b for r in got) / 24
    assert len(got) == 24 and all(abs(r.b / mean - 1) < 0.05 for r in got)


@pytest.mark.parametrize("k", [5, 20])
def test_substring(docs, rows, none, k):
    key = lambda r: 2**63 if r[0] is None else r[0]
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (2**64, 0)), (key(r), s))
    want = Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = {s + j for s in range(len(w) - k + 1) if first[tuple(w[s : s + k])] < (key(r), s) for j in range(k)}
        want[(r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, k).collect())
    assert got == want
    assert substring.remove_repeats(none, k).count() == 0


def test_substring_of_chunks_that_keep_no_word(spark):
    """A chunk of texts without words, and one whose every word goes."""
    kept = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = lambda rows: sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 20).collect())
    assert got([(1, None), (2, ""), (3, " \n")]) == [(i, 0, 0, kept(""), "") for i in (1, 2, 3)]
    long = " ".join(f"w{i}" for i in range(150_000))  # more bytes than a chunk takes: each copy is one
    assert len(long) > 1 << 20
    assert got([(1, long), (2, long)]) == [(1, 150_000, 0, kept(long), long), (2, 150_000, 150_000, kept(""), "")]


def naive_statistics(t):
    b = t.encode()
    w = [x.encode() for x in WORD.findall(t)]
    size, n = len(b), len(w)
    kinds = [range(97, 123), range(65, 91), range(48, 58), b".,;:!?", b"'\"()-", [c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:!?'\"()-"], range(128, 256), b" \t\r\x0b\x0c", b"\n"]
    symbol, letter = set(kinds[5]), {*kinds[0], *kinds[1], *kinds[6]}
    out = [np.log1p(size), np.log1p(n)] + [sum(c in set(k) for c in b) / max(size, 1) for k in kinds]
    lens = [len(x) for x in w]
    mean = sum(lens) / max(n, 1)
    out += [mean, max(0.0, sum(x * x for x in lens) / max(n, 1) - mean**2) ** 0.5, np.log1p(max(lens, default=0))]
    share = lambda f: sum(map(f, w)) / max(n, 1)
    out += [share(lambda x: x[0] in kinds[1]), share(lambda x: x[-1] in b".!?"), share(lambda x: bool(symbol & set(x))), share(lambda x: not letter & set(x)), share(lambda x: len(x) == 1), share(lambda x: len(x) <= 3)]
    out += [len(set(w)) / max(n, 1), max(Counter(w).values(), default=0) / max(n, 1)]
    return out + [len({tuple(w[i : i + k]) for i in range(n - k + 1)}) / max(n - k + 1, 1) for k in (2, 5)]


def test_quality_statistics_and_trees_by_hand(rows):
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 5000]
    x = np.concatenate([quality.statistics(data, off) for _, _, data, off in quality.text_chunks(pa.array(texts))])
    assert x.shape == (len(texts), quality.FEATURES) and np.allclose(x, [naive_statistics(t) for t in texts], atol=1e-6)
    rng = np.random.default_rng(3)
    y = (rng.random(len(x)) < 0.5).astype(float)
    trees = quality.fit(x, y, quality.Settings(trees=7))

    def walk(row):
        z = trees.base
        for f, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > above[node] else 1)
            z += leaf[node - len(f)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_quality_query(spark):
    out = {r.doc_id: r for r in entry.queries()["op4_quality"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(out) == set(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for d, r in out.items())
    labels = [(r.quality, out[r.doc_id].score) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r.doc_id].held_out]
    good, bad = ([s for q, s in labels if q == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.95 * len(good) * len(bad) > 0


def test_quality_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, "x", "z")], "doc_id long, text string, score string, _score string")
    trees = quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0))
    out = quality.score_documents(docs, trees, score="q")
    assert sorted(map(tuple, out.collect())) == [(1, "a b", "x", "y", 0.5), (2, None, "x", "z", 0.5)]
    assert sorted(r.score for r in quality.score_documents(docs, trees).collect()) == [0.5, 0.5]


def test_nearest_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    found = {}
    for r in entry.queries()["op5_nearest_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == sorted(int(i) for i in ids if i % 50 == 0)
    hit = 0
    for q, own in found.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        assert [k for k, _, _ in sorted(own)] == [1, 2, 3, 4, 5] and all(abs(s[ids == i][0] - c) < 1e-12 for _, i, c in own)
        hit += len({i for _, i, _ in own} & set(best.tolist()))
    assert hit >= 0.9 * 5 * len(found)


def test_nearest_in_blocks_of_queries(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(1200, 7)))], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0")
    want = Counter(map(tuple, ann.nearest(df, asked).collect()))
    assert Counter(map(tuple, ann.nearest(df, asked, settings=ann.Settings(rows=20, queries=3)).collect())) == want


def test_nearest_in_pairs_of_centroids(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(300, 12))
    v = middle[rng.integers(0, 300, 4000)] + 0.3 * rng.normal(size=(4000, 12))
    v[50:60] = v[50]
    few = ann.Settings(cells=8)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    codec = ann.fit(u, len(u), few)
    assert codec.n_cells == 64 and len(set(codec.cells(u).tolist())) > 40
    cell = codec.cells(u)
    assert np.allclose(codec.scores(u[:9])[np.arange(9), cell[:9]], (u[:9] * codec.centre(cell[:9])).sum(1))
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), settings=few).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -9
        own = sorted(found[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[i] - c) < 1e-9 for _, i, c in own)
        hit += len({i for _, i, _ in own} & set(np.lexsort((np.arange(4000), -s.round(12)))[:5].tolist()))
    assert hit >= 0.9 * 400


def test_nearest_looks_farther_until_it_finds_enough(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(rng.normal(size=(2500, 5)))], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 250 = 0")
    got = ann.nearest(df, asked, k=200, settings=ann.Settings(found=0.0)).collect()
    assert Counter(r.query_id for r in got) == {i: 200 for i in range(0, 2500, 250)}


def test_token_counts_query(spark):
    known = set(wordpiece.load_vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in entry.queries()["op8_token_counts"](spark, SF).collect())
    assert got == Counter((r.doc_id, len(WORD.findall(r.text or "")), greedy(known, r.text)) for r in docs)


def well_sharded(docs, out, shards):
    """docs: (doc_id, text); out: rows of the query."""
    raw = {}
    for d, t in docs:
        b = (t or "").encode()
        raw.setdefault(d, []).append((len(b) + 8, zlib.crc32(b)))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, *x) for d, xs in raw.items() for x in xs)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(r.size for r in out)
    groups, held = {}, Counter()
    for r in out:
        groups.setdefault((r.text_crc32, r.size), []).append(r)
        held[r.shard] += r.size
    largest = max(r.size for r in out)
    for g in groups.values():
        own = sum(r.size for r in g)
        if own <= sharding.SPLIT_ABOVE * total / shards:
            assert len({r.shard for r in g}) == 1  # equal texts lie together
            largest = max(largest, own)
    assert all(abs(held[s] - total / shards) <= 2 * largest for s in range(shards))


def test_sharding_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = entry.queries()["op9_sharding"](spark, SF).collect()
    well_sharded(docs, out, 24)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    assert sorted(map(tuple, out)) == sorted(map(tuple, entry.queries()["op9_sharding"](spark, SF).collect()))


def test_sharding_of_hot_and_small_groups(spark):
    texts = ["hot " * 30] * 900 + ["warm"] * 90 + [f"pair {i // 2} " * 5 for i in range(800)] + [None, "", None]
    docs = list(enumerate(texts))
    out = sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shards=10).collect()
    well_sharded(docs, out, 10)
    assert len({r.shard for r in out if r.size == 128}) > 1


@pytest.mark.parametrize("ids", ([None], [7], [None, 7]))
def test_sharding_of_a_hot_text_whose_ids_repeat(spark, ids):
    docs = [(ids[i % len(ids)], "hot " * 30) for i in range(900)] + [(1000 + i, f"own {i} " * 5) for i in range(800)]
    out = sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shards=10).collect()
    well_sharded(docs, out, 10)
    assert len({r.shard for r in out if r.size == 128}) > 1


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(x for i in range(3000) for x in (f"own {i}", "shared"))
    rows = [(i, f"own {i}\nshared", f"s{i}") for i in range(6)] + [(9, long, "s9")]
    out = {r.doc_id: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=5).collect()}
    assert (out[9].n_lines, out[9].n_removed) == (6000, 3000) and out[9].kept == "\n".join(f"own {i}" for i in range(3000))


def test_shared_folder_is_the_sessions(spark):
    root = storage.shared_root(spark)
    assert spark.conf.get("spark.checkpoint.dir", root) == root and storage.shared_root(spark) == root


def test_operators_run_where_no_setting_names_a_shared_folder(tmp_path):
    """In a process of its own, as Spark's defaults of this machine name one."""
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
for name in ("op2_warc", "op7_line_dedup", "op12_conversation_repair"):
    print("ROWS", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    root = os.path.dirname(entry.__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert [x.split()[1:] for x in done.stdout.splitlines() if x.startswith("ROWS")] == [["op2_warc", "50"], ["op7_line_dedup", "200"], ["op12_conversation_repair", "20"]], done.stderr[-2000:]


def test_no_record_depends_on_how_files_are_cut(spark, monkeypatch):
    """The setting for splits changes before every table that is stored, and so between all reads of the archives."""
    inner = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, "u", f"{i} " + inner * (i % 4) + "x" * (i % 700)) for i in range(300)]
    sizes, keep = iter([1000, 7000, 2500, 90_000, 600, 11_000, 1 << 20, 3000] * 20), warc.stored

    def moved(df, name):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return keep(df, name)

    monkeypatch.setattr(warc, "stored", moved)
    try:
        for payload in (False, True):
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
            out = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(3), payload=payload)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
            got = Counter((r.page_id, r.payload_bytes) for r in out.collect())
            assert got == Counter((i, len(h)) for i, _, h in pages)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(cur.fetchall())
