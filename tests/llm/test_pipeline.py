"""The pipeline's stages against brute force on the smallest tables."""

import re
from collections import Counter

import pytest
from test_llm_operators import SF, WORD, linked, lower, odd_rows

import corpus_pipeline as P
from siftwright.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(r[0], r[1], "en", r[2], None) for r in odd_rows() if len(r[1] or "") < 5000]
    own = spark.read.parquet(f"{SF}/documents.parquet")
    first = [tuple(r) for r in own.orderBy("doc_id").limit(60).collect()]
    rows = first + [(r[0] if r[0] is None else r[0] + 1000, *r[1:]) for r in odd]
    # rows that differ in lang only
    return spark.createDataFrame(rows + [(*rows[0][:2], "xx", *rows[0][3:]), (*rows[0][:2], "yy", *rows[0][3:])], COLUMNS).repartition(3)


def whole(df, columns=None):
    return Counter(tuple(r) for r in (df if columns is None else df.select(*columns)).collect())


def words(t):
    return ALNUM.findall(lower(t or ""))


def benchmark_windows(spark):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w}
    return windows


def contaminated(t, windows, sizes):
    w, hit = words(t), set()
    for k in sizes:
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(w)


def near_copies_out(rows):
    """Rows that the near-duplicate stage keeps, by (doc_id, text)."""
    empty = Counter((r[0], r[1]) for r in rows if not WORD.findall(r[1] or ""))
    return {c for _, k, c in linked(rows, 5, 80) if k}, empty


def mixed_well(rows, out):
    before, after = Counter(r[:5] for r in rows), Counter(r[:5] for r in out)
    size = lambda r: len(WORD.findall(r[1] or ""))
    assert set(after) <= set(before) and all(after[k] <= 2 * before[k] for k in after)
    total = sum(size(r) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r[3], [0, 0, 0])
        by[r[3]][0] += size(r)
        by[r[3]][2] = max(by[r[3]][2], size(r))
    for r in out:
        by[r[3]][1] += size(r)
    # targets by weight, none above twice its source, the excess shared anew
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), (5, 2, 1) * len(by), strict=False))
    left, want, budget = {s: v[0] for s, v in by.items()}, {}, 1.5 * total
    while left:
        level = (budget - sum(want.values())) / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > 2 * left[s]]
        if not full:
            want |= {s: level * weights[s] for s in left}
            break
        want |= {s: 2.0 * left.pop(s) for s in full}
    longest = max(v[2] for v in by.values())
    assert all(abs(by[s][1] - want[s]) <= 2 * longest + 1 for s in by)
    assert sum(size(r) for r in out) <= 1.5 * total


def sharded_well(rows, out):
    assert Counter(r[:5] for r in out) == Counter(rows)
    slots = Counter((r.shard, r.slot) for r in out)
    assert set(slots.values()) <= {1} and all((s, i) in slots for s, n in Counter(s for s, _ in slots).items() for i in range(n))
    assert all(r.size == len((r.text or "").encode()) + 8 for r in out)


def test_stage_names_and_columns(spark, docs):
    assert len(P.STAGES) == 5
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and out.columns[:5] == docs.columns


def test_names_that_clash(spark):
    names = ["row", "tie", "times_", "copy", "score", "did", "text_hash", "kept", "nth", "size", "shard", "slot", "SCORE_"]
    text = " ".join(f"The quick brown fox number {i} jumps over a lazy dog near the river." for i in range(30))
    rows = [(i, f"{text} {i}" if i % 2 else f"Another tale {i}: " + text[::-1], "en", "s", 3, *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, COLUMNS + ", " + ", ".join(f"{n} string" for n in names))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == (docs.columns if name != "sharding" else [f"_{c}" if c in ("size", "shard", "slot") else c for c in docs.columns])
        assert set(whole(out, out.columns[: len(docs.columns)])) <= set(whole(docs)), name


def test_near_duplicates(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    ids, empty = near_copies_out(rows)
    kept = Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect())
    assert {d for d, t in kept if WORD.findall(t or "")} == ids and all(n == 1 for (d, t), n in kept.items() if WORD.findall(t or ""))
    assert all(kept[k] == n for k, n in empty.items())


def test_decontaminate_takes_only_contaminated(spark, docs):
    windows = benchmark_windows(spark)
    sizes = {len(x) for x in windows}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = docs.union(spark.createDataFrame([(9001, f"x {item} y", "en", "s", 1), (9001, "clean", "en", "s", 1), (9002, None, "en", "s", 1)], COLUMNS))
    assert whole(P.decontaminate(spark, more, SF)) == Counter({k: n for k, n in whole(more).items() if not contaminated(k[1], windows, sizes)})


def test_mix_and_shard(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    mixed = P.mix(spark, docs, SF)
    out = [tuple(r) for r in mixed.collect()]
    mixed_well(rows, out)
    assert whole(P.mix(spark, docs.repartition(5), SF)) == Counter(out)
    sharded_well(out, P.shard(spark, mixed, SF).collect())


def test_mix_keeps_rows_that_differ_in_lang_only_apart(spark):
    rows = [(1, "a b c", "en", "s", 1), (1, "a b c", "de", "s", 2), (2, "d e", "en", "t", 1), (None, "f g h", "en", None, 1), (None, "f g h", "fr", None, 1)]
    out = whole(P.mix(spark, spark.createDataFrame(rows, COLUMNS), SF))
    assert set(out) <= set(rows) and max(out.values()) <= 2 and len(out) >= 4


def test_quality_keeps_good_documents_it_never_saw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in P.quality_filter(spark, docs, SF).select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("unseen", quality.held_out()).collect()
    for unseen in (False, True):
        good, bad = ([r.doc_id for r in labels if r.quality == q and r.unseen == unseen] for q in (1, 0))
        assert sum(d in kept for d in good) >= 0.9 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_run_applies_each_stage_to_what_its_predecessor_kept(spark, monkeypatch):
    given = []
    stages = [(name, lambda s, d, sf, f=f: given.append([tuple(r) for r in d.collect()]) or f(s, d, sf)) for name, f in P.STAGES]
    monkeypatch.setattr(P, "STAGES", stages)
    result = P.run(spark, SF).collect()
    first = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(given[0]) == Counter(first)
    assert set(given[1]) < set(first)
    ids, empty = near_copies_out(given[1])
    kept = Counter(given[2])
    assert {r[0] for r in kept if WORD.findall(r[1] or "")} == ids and sum(kept.values()) == len(ids) + sum(empty.values())
    windows = benchmark_windows(spark)
    sizes = {len(x) for x in windows}
    assert Counter(given[3]) == Counter(r for r in given[2] if not contaminated(r[1], windows, sizes))
    mixed_well(given[3], given[4])
    sharded_well(given[4], result)
