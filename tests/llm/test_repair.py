"""Conversation repair against a search over all sequences of edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from siftwright.llm import queries as Q
from siftwright.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at int"
PATTERN = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """(role, text, fault) of one conversation's rows in order."""
    one = lambda v: " " if v is None else v
    rows = sorted(((t, one(r), one(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(lines):
    """(cost, audit, repaired lines): the least of all sequences of edits that cost no more than the best so far."""
    best = [3 * len(lines) + 1, "", []]

    def go(i, cost, audit, made):
        if cost > best[0]:
            return
        signs = "".join(r[0] if r else "?" for r, _ in made)
        if not re.match(r"s?(ua)*u?\Z", signs):
            return
        if i == len(lines) and PATTERN.fullmatch(signs) and [cost, audit] < best[:2]:
            best[:] = [cost, audit, [f"{r}:{t}" for r, t in made]]
        if i < len(lines):
            role, text, fault = lines[i]
            go(i + 1, cost + 3, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                go(i + 1, cost + late, audit + "K", [*made, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + late, audit + "R", [*made, (r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*made, (r, "")])

    go(0, 0, "", [])
    return best


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r[1:4])
    out = {}
    for conv, mine in groups.items():
        lines = faulty(mine)
        known = [t for t, _, _ in mine if t is not None]
        signs = [r[:1] for r, _, _ in lines]
        cost, audit, made = cheapest(lines)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *[sum(f == k for _, _, f in lines) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(signs)), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    done = R.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3))
    sha = {r.conv: r.sha for r in R.digests(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {None if r.conv == " " else int(r.conv): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv, empty)) for r in done.summary.collect()}
    audits = defaultdict(str)
    for r in sorted(done.turns.collect(), key=lambda r: (r.at, r.step)):
        audits[r.conv] += r.edit * r.times
    assert {c: audits[c] for c in audits} == {" " if c is None else str(c): v[6] for c, v in got.items()}
    return got


def random_rows(n, most, seed):
    rng = random.Random(seed)
    for conv in range(n):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            yield conv, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["a.", "b!", "c", " \t", "", "d? ", "e\x1c", None, "a."])


@pytest.mark.parametrize("bits", [10, 1])
def test_repair_of_random_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "BLOCK_BITS", bits)
    rows = list(random_rows(50, 6, 4))
    rows += [(1000, 0, "user", "same.")] * 4 + [(None, 1, "user", "hi."), (None, 2, "assistant", "yo.")]
    assert found(spark, rows) == expected(rows)


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """Blocks of 8 rows against the same rows in one block; a text of 2 MB stands among them."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}!", f"c{t}"])) for t in range(600)] + [(1, 700, "user", "long " * 400_000 + ".")]
    whole = found(spark, rows)
    monkeypatch.setattr(R, "BLOCK_BITS", 3)
    assert found(spark, rows) == whole


def test_a_row_that_fills_the_table(spark):
    rows = [(1, 0, "user", "hi.")] * 300 + [(1, 1, "assistant", "yo.")]
    got = found(spark, rows)[1]
    assert got[2] == 299 and got[5] == 3 * 299 and got[6] == "K" + "D" * 299 + "K"


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = R.repair(none)
    assert done.summary.collect() == [] and done.turns.collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "x. y!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        h = zlib.crc32(name.encode()) % 20
        role, text = role or " ", text or " "
        new = (c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        want += [new] * (0 if h == 0 else 2 if h == 3 else 1)
    got = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_on_an_empty_table_and_on_dropped_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "hi.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "a/conversations.parquet"))
    row = Q.op12_conversation_repair(spark, str(tmp_path / "a")).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert Q.op12_conversation_repair(spark, str(tmp_path / "b")).collect() == []
