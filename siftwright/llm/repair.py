r"""Conversation structure repair: cheapest edits on a bidirectional tight-arc DAG.

A node is a place between two rows of a conversation and a state of the pattern
``(s?(ua)+)?`` of role initials; an arc keeps, re-roles or deletes the next row
or inserts an empty one.  Forward costs from the start and backward costs to
the end tell which arcs lie on a cheapest path (forward + arc + backward =
optimum).  A traversal then keeps the set of states that the edits so far may
have led to and takes the least letter of any optimal arc out of them.

A conversation of any length is cut into blocks of ``BLOCK`` rows: a block is
measured once as a 4 x 4 matrix of costs between its ends.  Costs at block ends
come from passes over these matrices, a few numbers a block, sorted by
conversation and streamed, so no group is held in memory.  Then every block is
traversed on its own, from each state in which a cheapest path may enter it,
and a last pass links the traversals.  Texts are never sent to Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: rows of one conversation in a block, at most: a power of two
BLOCK_BITS = 10
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
#: faults of a row, and initials; a row's code is initial + 4 * fault
SOUND, CUT, BLANK, AGAIN = range(4)
INITIALS = "sua"
OTHER = 3
FAR = 1 << 60
#: states: nothing yet, after s, after u, after a; a path may end in the first and the last
STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
FILL = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = (0, 3)
FOLLOWS = {(0, 1), (1, 2), (2, 1)}


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, by letter."""
    sign, fault = code & 3, code >> 2
    out = [("D", DELETE, state)]
    if fault < BLANK:
        late = TRUNCATED * (fault == CUT)
        if (state, sign) in STEP:
            out.append(("K", KEEP + late, STEP[state, sign]))
        out.append(("R", REROLE + late, FILL[state]))
    return out


def _inserted_after(f: tuple) -> tuple:
    """Forward costs at a place, rows inserted there included."""
    u = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    return (f[0], f[1], u, min(f[3], u + INSERT))


def _inserted_before(b: tuple) -> tuple:
    """Backward costs at a place, rows inserted there included."""
    u, a = min(b[2], b[3] + INSERT), min(b[3], b[2] + INSERT)
    return (min(b[0], u + INSERT), min(b[1], u + INSERT), u, a)


END = _inserted_before(tuple(0 if q in ENDS else FAR for q in range(4)))
_FORTH: dict[tuple, tuple] = {}
_BACK: dict[tuple, tuple] = {}


def _relative(known: dict, of: Callable, code: int, costs: tuple) -> tuple:
    """``of(code, costs)``; costs less their least take few values, which are looked up."""
    least = min(costs)
    key = (code, *(min(c - least, FAR) for c in costs))
    if key not in known:
        known[key] = of(code, key[1:])
    return tuple(min(c + least, FAR) for c in known[key])


def _over(code: int, f: tuple) -> tuple:
    out, f = [FAR] * 4, _inserted_after(f)
    for q in range(4):
        for _, cost, to in arcs(code, q):
            out[to] = min(out[to], f[q] + cost)
    return tuple(out)


def _under(code: int, b: tuple) -> tuple:
    return _inserted_before(tuple(min(cost + b[to] for _, cost, to in arcs(code, q)) for q in range(4)))


def forth(code: int, f: tuple) -> tuple:
    """Forward costs after a row, from those before it (without insertions at either place)."""
    return _relative(_FORTH, _over, code, f)


def back(code: int, b: tuple) -> tuple:
    """Backward costs before a row, from those after it (insertions included)."""
    return _relative(_BACK, _under, code, b)


def matrix(codes: bytes) -> list[int]:
    """Costs from each state before a block to each state after its last row."""
    out = []
    for q in range(4):
        f = tuple(0 if p == q else FAR for p in range(4))
        for code in codes:
            f = forth(code, f)
        out += f
    return out


def traverse(codes: bytes, state: int, forward: tuple, end: tuple, best: int, last: bool) -> tuple[list[str], list[str], int]:
    """Least letters of a cheapest path through a block that enters in ``state``: letters and, for each, who speaks, by row; and the state after it.

    ``forward`` and ``end`` are the costs before and after the block.  Who
    speaks: u or a for a row inserted or re-roled, k for one kept, - for one
    deleted.  In the ``last`` block, what is inserted after all rows is an
    entry of its own.
    """
    b, f = [end], [forward]
    for code in reversed(codes):
        b.append(back(code, b[-1]))
    b.reverse()
    for code in codes:
        f.append(forth(code, f[-1]))
    letters, made, front = [], [], {state}
    for i in range(len(codes) + last):
        some, who = "", ""
        cost = dict(enumerate(_inserted_after(f[i])))
        while True:
            tight: dict[str, set[int]] = {}
            for q in front:
                if i == len(codes):
                    if q in ENDS and cost[q] == best:
                        tight.setdefault("", set()).add(q)
                else:
                    for letter, c, to in arcs(codes[i], q):
                        if cost[q] + c + b[i + 1][to] == best:
                            tight.setdefault(letter, set()).add(to)
                if cost[q] + INSERT + b[i][FILL[q]] == best:
                    tight.setdefault("I", set()).add(FILL[q])
            letter = min(tight)
            front = tight[letter]
            some += letter
            who += {"D": "-", "K": "k", "": ""}.get(letter) if letter in ("D", "K", "") else INITIALS[min(front) - 1]
            if letter != "I":
                break
        letters.append(some)
        made.append(who)
    return letters, made, min(front)


def coded(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored rows (conv, turn, role, text, n, sign, fault, at): conv is the id as text, n counts rows that repeat each other, ``at`` numbers all in order.

    A null conv_id, role or text counts as one space.  Order: by conversation
    and turn (nulls first), then by role and the text's SHA-256.  Rows that
    repeat each other wholly are folded before anything is sorted, so neither a
    turn nor a text that a third of all rows share meets in one task.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(one(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"))
    folded = plain.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("known", F.col("turn").isNotNull()).withColumn("sha", F.sha2("text", 256))
    folded = stored(folded, "turns")
    said = folded.groupBy("conv", "role", "sha").agg(F.count("*").alias("times"), F.min(F.struct("known", "turn")).alias("first"))
    said = stored(said.where("times > 1").drop("times"), "said-again")
    place = F.struct("known", "turn")
    ending = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("first").isNotNull() & (F.col("first") < place), AGAIN).when(~ending.isin(".", "!", "?"), CUT).otherwise(SOUND)
    initial = F.left("role", F.lit(1))
    sign = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    order = ["conv", "known", "turn", "role", "sha"]
    marked = folded.join(said, ["conv", "role", "sha"], "left").withColumn("fault", fault).withColumn("sign", sign)
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("at", F.monotonically_increasing_id()).select("conv", "turn", "role", "text", "n", "sign", "fault", "at"), "turns-in-order")


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
        yield dict(zip(names, row, strict=True))


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


BLOCKS = "conv string, seg long, codes binary, copies array<long>, costs array<long>, illegal long, turns long, low long, high long, first int, last int"
_BLOCKS = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("codes", pa.binary()), ("copies", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), *[(c, pa.int64()) for c in ("illegal", "turns", "low", "high")], ("first", pa.int32()), ("last", pa.int32())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in _columns(batch):
            codes = bytes(x["sign"] + 4 * x["fault"] for x in r["rows"])
            copies = [x["n"] for x in r["rows"]]
            signs = [c & 3 for c in codes]
            illegal = sum(n - 1 for n in copies) + sum(pair not in FOLLOWS for pair in zip(signs, signs[1:], strict=False))
            known = [x["turn"] for x in r["rows"] if x["turn"] is not None]
            out.append({
                "conv": r["conv"], "seg": r["seg"], "codes": codes, "copies": copies, "costs": matrix(codes), "illegal": illegal, "turns": len(set(known)),
                "low": known[0] if known else None, "high": known[-1] if known else None, "first": signs[0], "last": signs[-1],
            })
        yield from _batches(out, _BLOCKS)


def _streamed(rows: DataFrame, schema: str, step: Callable, down: bool = False) -> DataFrame:
    """``step(row, memory)`` on the blocks of each conversation in order (or from its last); it returns what memory the next block gets and changes the row."""
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, memory = None, None
        for batch in batches:
            out = []
            for r in _columns(batch):
                if r["conv"] != conv:
                    conv, memory = r["conv"], None
                memory = step(r, memory)
                out.append({n: r.get(n) for n in names})
            yield from _batches(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kinds), kinds.names
    return rows.repartition("conv").sortWithinPartitions("conv", F.desc("seg") if down else "seg").mapInArrow(run, schema)


def _from_end(r: dict, after: tuple | None) -> tuple:
    """Backward costs after a block; the next (earlier) block gets those before it."""
    end = END if after is None else after
    r["end"], r["final"] = list(end), after is None
    m = r["costs"]
    return _inserted_before(tuple(min(FAR, *(m[4 * q + p] + end[p] for p in range(4))) for q in range(4)))


def _from_start(r: dict, before: tuple | None) -> tuple:
    """Forward costs before a block, the optimum, and what joins a block to the one before it."""
    f, best, last, high = before or ((0, FAR, FAR, FAR), None, None, None)
    m, end = r["costs"], r["end"]
    after = tuple(min(FAR, *(f[q] + m[4 * q + p] for q in range(4))) for p in range(4))
    best = min(c + e for c, e in zip(after, end, strict=True)) if best is None else best
    r["start"], r["best"] = list(f), best
    r["illegal"] += last is not None and (last, r["first"]) not in FOLLOWS
    r["turns"] -= high is not None and high == r["low"]
    return after, best, r["last"], high if r["high"] is None else r["high"]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's traversals, one from each state in which a cheapest path may enter it."""
    for batch in batches:
        out = []
        for r in _columns(batch):
            codes, start, end, best = r["codes"], tuple(r["start"]), tuple(r["end"]), r["best"]
            before = end
            for code in reversed(codes):
                before = back(code, before)
            ways = []
            for q in range(4):
                if start[q] + before[q] == best:
                    letters, made, leaves = traverse(codes, q, start, end, best, r["final"])
                    ways.append({"enters": q, "letters": letters, "made": made, "leaves": leaves})
            out.append({k: r[k] for k in ("conv", "seg", "copies", "illegal", "turns", "low", "high", "best")} | {"ways": ways})
        yield from _batches(out, _WAYS)


_WAY = "struct<enters:int,letters:array<string>,made:array<string>,leaves:int>"
WAYS = f"conv string, seg long, copies array<long>, illegal long, turns long, low long, high long, best long, ways array<{_WAY}>"
_WAYS = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("copies", pa.list_(pa.int64())), *[(c, pa.int64()) for c in ("illegal", "turns", "low", "high", "best")], ("ways", pa.list_(pa.struct([("enters", pa.int32()), ("letters", pa.list_(pa.string())), ("made", pa.list_(pa.string())), ("leaves", pa.int32())])))])


def _linked(r: dict, state: int | None) -> int:
    """The traversal that continues the block before, and its audit: rows that repeat one are deleted right after it."""
    way = next(w for w in r["ways"] if w["enters"] == (state or 0))
    r["letters"], r["made"] = way["letters"], way["made"]
    n = len(r["copies"])
    r["audit"] = "".join(x + "D" * (c - 1) for x, c in zip(way["letters"], r["copies"], strict=False)) + "".join(way["letters"][n:])
    return way["leaves"]


@dataclass
class Repaired:
    """``turns``: conv, at, step, edit, role, text and times, one row per edit (times counts equal deletions).

    ``summary``: conv, gaps, blank, duplicate, truncated, illegal, cost and
    audit of each conversation that has rows.
    """

    turns: DataFrame
    summary: DataFrame


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Cheapest repair of every conversation; of several that cost the same, that of the least letters.

    Keeping a row costs 0, giving it the role user or assistant 2, deleting it
    3, inserting an empty row 2, and a truncated row that stays 1 more.  Blank
    rows and those whose role and text came before must go.  A role other than
    s..., u... or a..., the empty one too, fits nowhere.  Ties and nulls: see
    coded(); rows that repeat each other come out as one deletion with a count;
    a very long text is only ever handled as one row's value.  Other columns
    are ignored and an empty table gives no conversations.
    """
    lines = coded(rows, conv_id, turn, role, text)
    seg = F.shiftright("at", BLOCK_BITS)
    fields = F.struct("at", "sign", "fault", "n", "turn")
    blocks = lines.groupBy("conv", seg.alias("seg")).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    blocks = stored(blocks.mapInArrow(_measure, BLOCKS), "blocks")
    ends = _streamed(blocks, f"{BLOCKS}, end array<long>, final boolean", _from_end, down=True)
    both = stored(_streamed(ends, f"{BLOCKS}, end array<long>, final boolean, start array<long>, best long", _from_start), "block-costs")
    ways = stored(both.mapInArrow(_paths, WAYS), "block-paths")
    chosen = stored(_streamed(ways, "conv string, seg long, illegal long, turns long, low long, high long, best long, letters array<string>, made array<string>, audit string", _linked), "repairs")

    faults = lines.groupBy("conv").agg(
        *[F.sum(F.when(F.col("fault") == k, F.when(F.lit(k == CUT), 1).otherwise(F.col("n"))).otherwise(0)).alias(c) for c, k in (("blank", BLANK), ("again", AGAIN), ("truncated", CUT))],
        F.sum(F.when(F.col("fault") < BLANK, F.col("n") - 1).otherwise(0)).alias("copies"),
        F.sum(F.col("n") - 1).alias("extra"),
    )
    total = chosen.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.max("best").alias("best"), (F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    summary = total.join(faults, "conv").select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.col("blank").cast("long").alias("blank"), (F.col("again") + F.col("copies")).cast("long").alias("duplicate"),
        F.col("truncated").cast("long").alias("truncated"), "illegal", (F.col("best") + DELETE * F.col("extra")).cast("long").alias("cost"), "audit",
    )

    # a block's rows are numbered without a break, so a row's place in it is its distance from the block's first
    first = lines.groupBy("conv", seg.alias("seg")).agg(F.min("at").alias("least"), F.count("*").alias("rows"))
    told = chosen.select("conv", "seg", "letters", "made").join(first, ["conv", "seg"])
    met = lines.withColumn("seg", seg).join(told, ["conv", "seg"])
    i = (F.col("at") - F.col("least")).cast("int")
    tail = F.when(i + 1 == F.col("rows"), F.get("letters", F.col("rows").cast("int")))
    edits = lambda c: F.split(F.get(c, i), "")
    pair = lambda a, b: F.transform(F.arrays_zip(a.alias("edit"), b.alias("who")), lambda x: F.struct(x["edit"].alias("edit"), x["who"].alias("who"), F.lit(1).cast("long").alias("times")))
    more = F.when(F.col("n") > 1, F.array(F.struct(F.lit("D").alias("edit"), F.lit("-").alias("who"), (F.col("n") - 1).alias("times")))).otherwise(F.array().cast("array<struct<edit:string,who:string,times:bigint>>"))
    late = F.when(F.coalesce(tail, F.lit("")) != "", pair(F.split(tail, ""), F.split(F.get("made", F.col("rows").cast("int")), ""))).otherwise(F.array().cast("array<struct<edit:string,who:string,times:bigint>>"))
    every = F.concat(pair(edits("letters"), edits("made")), more, late)
    out = met.select("conv", "at", "role", "text", F.posexplode(every).alias("step", "e"))
    own = F.col("e.edit").isin("K", "D")
    spoken = F.when(own, F.col("role")).when(F.col("e.who") == "u", "user").otherwise("assistant")
    turns = out.select("conv", "at", "step", F.col("e.edit").alias("edit"), spoken.alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"), F.col("e.times").alias("times"))
    return Repaired(turns, summary)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha = None, None
    for batch in batches:
        done = []
        for name, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
            if name != conv:
                if sha:
                    done.append((conv, sha.hexdigest()))
                conv, sha = name, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "sha"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])


def digests(turns: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its repaired ``role:text`` lines, streamed in order: a hash has to read a conversation from end to end, but holds none of it."""
    lines = turns.where("edit <> 'D'").select("conv", "at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "step").select("conv", "line").mapInArrow(_digests, "conv string, sha string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults made by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's.  Nulls count as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    out = rows.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("times_"))
    return out.withColumn("nth_", F.explode(F.sequence(F.lit(1), "times_"))).drop("times_", "nth_")


def key(conv_id: Column) -> Column:
    """An id as Repaired names it."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))
