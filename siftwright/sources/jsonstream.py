r"""Report files of any size, taken apart by many tasks.

A file is one JSON object, one array of members, or JSON lines.  An array may
be a single line of many gigabytes, so it is read as the rows between closing
braces, and where a row stands (inside a string or not, how deep) is found
without reading what comes before it:

1. A pass counts, by block and for both cases (the block begins inside a string
   or outside), how the nesting changes and how many commas and ends of values
   lie at each relative depth.  Quotes tell whether the case changes.
2. Running sums over a file's blocks give the case and the depth in which each
   block begins, and the number of members before it.
3. A second pass cuts every block at the commas between members.  Members inside
   a block are done; only the pieces at both ends of a block are shuffled and put
   together by their member's number.

What tasks send in the first pass is a few numbers a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .splits import rows_in_order

#: bytes handled at once, or one row
SLICE = 4 << 20
#: blocks whose states are broadcast; more are joined, and rows then sorted anew
MOST_BROADCAST = 100_000

SPACES = " \t\r\n"
_QUOTE, _ESCAPE, _COMMA = 34, 92, 44
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_MARK = (_DEPTH != 0) | (np.arange(256) == _COMMA)
_BLANK = np.isin(np.arange(256), list(SPACES.encode()))


def _bytes(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of a batch as they stand in the file, each with the brace that ended it."""
    values = batch.column("value").slice(lo, hi - lo).cast(pa.large_binary())
    _, off, data = values.buffers()
    off = np.frombuffer(off, np.int64)[values.offset : values.offset + len(values) + 1]
    out = np.full(int(off[-1] - off[0]) + len(values), ord("}"), np.uint8)
    if data is not None:
        size = np.diff(off)
        at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        out[at] = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """(file, block, ``more``) and bytes of consecutive rows, a few megabytes at a time."""
    for batch in batches:
        keys = [batch.column(c) for c in ("file", "block", *more)]
        key = lambda i, keys=keys: tuple(k[i].as_py() for k in keys)
        size = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False) + 1)
        lo, n = 0, batch.num_rows
        while lo < n:
            now, hi = key(lo), n
            if key(n - 1) != now:  # a block's rows come together: the first row of another is found by halving
                at = lo
                while hi - at > 1:
                    mid = (at + hi) // 2
                    at, hi = (mid, hi) if key(mid) == now else (at, mid)
            hi = min(hi, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right"))))
            yield now, _bytes(batch, lo, hi)
            lo = hi


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes.  A row never begins with an escaped byte: a brace needs no escape."""
    quote = data == _QUOTE
    slash = np.flatnonzero(data == _ESCAPE)
    if len(slash):
        # in a run of backslashes every second one escapes the next byte
        head = np.r_[True, np.diff(slash) > 1]
        place = np.arange(len(slash)) - np.maximum.accumulate(np.where(head, np.arange(len(slash)), 0))
        after = slash[place % 2 == 0] + 1
        quote[after[after < len(data)]] = False
    return quote


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, braces and commas, whether an odd number of quotes stands before each, and the same of all bytes."""
    at, quotes = np.flatnonzero(_MARK[data]), np.flatnonzero(_quotes(data))
    return at, np.searchsorted(quotes, at) % 2, len(quotes) % 2


SUMMARY = "file string, block long, bytes long, odd int, first int, last int, prior int, " + ", ".join(f"deeper{s} long, commas{s} map<long,long>, ends{s} map<long,long>" for s in (0, 1))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its bytes, whether its quotes are odd, the first and the last two bytes that are no white space and, for both cases, the change of depth and the commas and ends of values by depth."""
    kept: dict[tuple, dict] = {}

    def told(keys: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [kept.pop(k) for k in keys]
        if rows:
            maps = pa.map_(pa.int64(), pa.int64())
            kinds = [("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("odd", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("prior", pa.int32())]
            kinds += [x for s in (0, 1) for x in ((f"deeper{s}", pa.int64()), (f"commas{s}", maps), (f"ends{s}", maps))]
            yield pa.RecordBatch.from_pylist([{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} for r in rows], pa.schema(kinds))

    for key, data in _runs(batches):
        if key not in kept:
            yield from told(list(kept))  # a block's rows come together
            kept[key] = {"file": key[0], "block": key[1], "bytes": 0, "odd": 0, "first": None, "last": None, "prior": None} | {f"{n}{s}": 0 if n == "deeper" else {} for s in (0, 1) for n in ("deeper", "commas", "ends")}
        r = kept[key]
        r["bytes"] += len(data)
        solid = np.flatnonzero(~_BLANK[data])
        if len(solid):
            r["first"] = int(data[solid[0]]) if r["first"] is None else r["first"]
            r["prior"] = int(data[solid[-2]]) if len(solid) > 1 else r["last"]  # null: the last is the block's only one
            r["last"] = int(data[solid[-1]])
        at, odd, more = _marks(data)
        for s in (0, 1):
            mark = data[at[odd == r["odd"] ^ s]]
            step = _DEPTH[mark]
            depth = np.cumsum(step) + r[f"deeper{s}"]
            for name, which in (("commas", mark == _COMMA), ("ends", step < 0)):
                for d, n in zip(*np.unique(depth[which], return_counts=True), strict=True):
                    r[f"{name}{s}"][int(d)] = r[f"{name}{s}"].get(int(d), 0) + int(n)
            r[f"deeper{s}"] += int(step.sum())
        r["odd"] ^= more
    yield from told(list(kept))


def _states(rows: DataFrame) -> DataFrame:
    """file, block, inside, depth and members (before the block); of the file the commas between its members (total), its kind (array, object or lines), whether it is blank, and whether its last row lacks the brace it was given (extra)."""
    of = Window.partitionBy("file").orderBy("block")
    ahead, whole = of.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    out = rows.withColumn("inside", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    for name in ("deeper", "commas", "ends"):
        out = out.withColumn(name, F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    out = out.withColumn("depth", F.coalesce(F.sum("deeper").over(ahead), F.lit(0)))
    at = lambda m, d: F.coalesce(F.try_element_at(m, d - F.col("depth")), F.lit(0))
    out = out.withColumn("members", F.coalesce(F.sum(at("commas", F.lit(1))).over(ahead), F.lit(0)))
    # every row was given a closing brace; whether the file's last row has one shows in the file's size
    extra = F.sum("bytes").over(whole) - F.col("file_bytes")
    every = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = {
        "extra": extra, "opens": F.first("first", True).over(every), "closes": F.last(F.col("last"), True).over(every),
        "before": F.last(F.coalesce("prior", "ahead")).over(every), "total": F.sum(at("commas", F.lit(1))).over(whole),
        "ended": F.sum(at("ends", F.lit(0))).over(whole), "final": F.sum("deeper").over(whole), "quotes": F.sum("odd").over(whole) % 2,
    }
    out = out.withColumn("ahead", F.last("last", True).over(ahead)).withColumns(over)
    closes = F.when(F.col("extra") == 1, F.col("before")).otherwise(F.col("closes"))
    even = (F.col("final") + F.col("extra") == 0) & (F.col("quotes") == 0) & (F.col("ended") == 1)
    kind = F.when(even & (F.col("opens") == ord("[")) & (closes == ord("]")), "array").when(even & (F.col("opens") == ord("{")) & (closes == ord("}")), "object").otherwise("lines")
    blank = F.col("opens").isNull() | ((F.col("extra") == 1) & F.col("before").isNull())
    return out.select("file", "block", "inside", "depth", "members", "total", "extra", blank.alias("blank"), kind.alias("kind"))


def _cut(torn: bool):
    """Members inside a block, or the pieces at its ends (``torn``): file, ord, part, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, state = None, [], None

        def rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "ord", "part", "text"])

        def ended() -> list[tuple]:
            if key is None or not torn:
                return []
            return [(key[0], state["ord"], key[1], b"".join(pieces))]

        for now, data in _runs(batches, "inside", "depth", "members", "kind"):
            done = []
            if now != key:
                done += ended()
                key, pieces = now, []
                state = {"inside": now[2], "depth": now[3], "ord": now[4], "first": True}
            if now[5] == "object":
                pieces.append(data.tobytes())
                yield from rows(done)
                continue
            places, odd, more = _marks(data)
            places = places[odd == state["inside"]]
            step = _DEPTH[data[places]]
            depth = np.cumsum(step) + state["depth"]
            lo = 0
            for at in places[(step == 0) & (depth == 1)].tolist():
                pieces.append(data[lo:at].tobytes())
                if state["first"] == torn:  # what stands before a block's first comma may have begun in another
                    done.append((key[0], state["ord"], key[1], b"".join(pieces)))
                pieces, lo = [], at + 1
                state["ord"], state["first"] = state["ord"] + 1, False
            pieces.append(data[lo:].tobytes())
            state["inside"], state["depth"] = state["inside"] ^ more, state["depth"] + int(step.sum())
            yield from rows(done)
        yield from rows(ended())

    return run


def members(spark: SparkSession, paths: list[str] | str, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, ord, text) of every member of files that hold one array or one object, and (file, kind, blank) of all files.

    Text is raw JSON without white space around it; what is no JSON inside a
    member is for its reader to find.  A file counts as an array or object if
    its brackets and quotes are even and its first value ends only where the
    file does; any other is left to a reader of lines.  Files without a byte
    are not seen.
    """
    raw = rows_in_order(spark, paths, "}", block)
    rows = raw.select("file", "file_bytes", "block", F.col("value").cast("binary").alias("value"))
    found = rows.select("file", "block", "value").mapInArrow(_summary, SUMMARY)
    sizes = rows.groupBy("file").agg(F.max("file_bytes").alias("file_bytes"))
    states = stored(_states(found.join(sizes, "file")), "json-blocks")
    kinds = states.groupBy("file").agg(F.first("kind").alias("kind"), F.first("blank").alias("blank"))
    wanted = states.where("kind <> 'lines'").select(F.col("file").alias("file_"), F.col("block").alias("block_"), "inside", "depth", "members", "kind")
    met = (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_"))
    if states.count() <= MOST_BROADCAST:
        told = rows.join(F.broadcast(wanted), met)
    else:
        told = rows.withColumn("mid", F.monotonically_increasing_id()).join(wanted, met).repartition("file", "block").sortWithinPartitions("file", "block", "mid")
    told = told.select("file", "block", "value", "inside", "depth", "members", "kind")
    shape = "file string, ord long, part long, text binary"
    done = told.where("kind = 'array'").mapInArrow(_cut(False), shape).select("file", "ord", F.col("text").cast("string").alias("text"))
    torn = told.mapInArrow(_cut(True), shape)
    glued = torn.groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    glued = glued.select("file", "ord", F.array_join(F.transform("p", lambda x: x["text"].cast("string")), "").alias("text"))
    files = states.groupBy("file").agg(*[F.first(c).alias(c) for c in ("kind", "extra", "total")])
    # off go the array's own brackets and the brace that the file's last row does not have
    text, last = F.btrim("text", F.lit(SPACES)), F.col("ord") == F.col("total")
    text = F.when((F.col("extra") == 1) & (last | (F.col("kind") == "object")), F.rtrim(F.left(text, F.length(text) - 1), F.lit(SPACES))).otherwise(text)
    array = F.col("kind") == "array"
    text = F.when(array & (F.col("ord") == 0), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    text = F.when(array & last, F.left(text, F.length(text) - 1)).otherwise(text)
    glued = glued.join(files, "file").withColumn("text", F.btrim(text, F.lit(SPACES))).where(~(array & (F.col("total") == 0) & (F.col("text") == "")))
    return done.withColumn("text", F.btrim("text", F.lit(SPACES))).unionByName(glued.select("file", "ord", "text")), kinds
