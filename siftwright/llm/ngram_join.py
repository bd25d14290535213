r"""Set-similarity self-join on word n-grams by vertical partitioning.

A document's set is its distinct n-word shingles as 64-bit hashes.  The global
n-gram order is the order of those hashes; cutting it into ranges (fragments)
cuts every set into segments.

1. *Classes.*  Documents with equal sets share one class; copies are never paired.
2. *Names.*  Linked sets differ in at most d n-grams, so of p > d fragments at
   least p - d agree wholly.  A segment's name is a hash of its n-grams.  A set
   that has n-grams in s + d + 1 fragments shares at least s + 1 names with
   every set that it links to, so it leaves out its s names of the fewest
   n-grams: all sets judge a name alike, and the last name that two of them
   share in that order stays.  p follows from the threshold and a size class
   (powers of two; a set close below the next power also enters the next
   class).  A set with n-grams in d fragments or fewer (short ones, mostly) may
   agree in empty fragments alone; it also names the n-grams of its prefix in
   the global order, of which two linked sets share one.
3. *Candidates.*  Sets that share a name form its list.  Each member meets the
   list's hub, its smallest set: a line of the list, not a join.  Lists whose
   members are then in one component are done.  In the others the members of
   different components meet block by block, first the closest two of each two
   components, then all that are still apart.  Whoever meets compares sizes and
   parity bitmaps (bit i is the parity of the n-grams that hash to i, so two
   sets differ in at least as many n-grams as their bitmaps do in bits), and
   only pairs that may link leave the block.
4. *Overlaps.*  Each candidate's overlap is counted in every fragment apart (at
   least two a set, about ``SEGMENT`` n-grams each), and the counts are summed
   per pair; exact integer arithmetic decides.
5. *Links.*  Where their numbers are asked for, all pairs inside a component of
   three sets or more are compared, one block of its sets with another.

Only the pairs of step 4 and the blocks of step 5 ship whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, tested
from .components import components
from .storage import drop, free, stored
from .textops import NOT_SPACE, mix, text_chunks, windows, words_of

#: n-grams that a fragment of a set holds on average, at most; a set is cut into 2, 4, 8 ... ranges of the global order
SEGMENT = 64
#: members of a list in one block
LIST_BLOCK = 1024
#: n-grams and sets that a block of a component holds on average, at most, when its links are counted
BLOCK, BLOCK_SETS = 1 << 16, 512
#: 64-bit words of a set's parity bitmap
PARITY = 16
#: bits of the filters that spare names and texts that meet nothing a shuffle or second reading; a full filter only lets more through
FILTER_BITS = 1 << 25


def shingle_sets(data, off, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all texts in turn, offsets by text)."""
    w = words_of(data, off, NOT_SPACE, lower=True)
    h = w.hashes()
    start, g = windows(h, w.doc, n)
    at = np.searchsorted(w.doc[start], np.arange(len(off))) if len(start) else np.zeros(len(off), np.int64)
    parts, sizes = [], np.zeros(len(off) - 1, np.int64)
    for d in range(len(off) - 1):
        if at[d + 1] > at[d]:
            s = np.sort(g[at[d] : at[d + 1]])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif w.first[d + 1] > w.first[d]:  # fewer words than n: the whole sequence
            own = h[w.first[d] : w.first[d + 1]]
            s = windows(own, np.zeros(len(own), np.int64), len(own))[1]
        else:
            continue
        parts.append(s)
        sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(sizes)]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]
    return total[off[1:]] - total[off[:-1]]


def fingerprints(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, 0 for the empty one."""
    n = np.diff(off).astype(np.uint64)
    out = mix(_sums(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), off) + n * np.uint64(0x14057B7EF767814F))
    return np.where(n == 0, np.uint64(0), np.where(out == 0, np.uint64(1), out))


def segment_names(sets: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) for every name of which two linked sets are sure to share one."""
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), size)
    level = np.zeros(len(size), np.int64)
    level[size > 0] = np.log2(size[size > 0]).astype(np.int64)
    hashed = mix(sets)
    unsure = np.zeros(len(size), bool)
    out_doc, out = [], []
    for up in (0, 1):
        own = level + up
        in_class = (size > 0) & ((up == 0) | (100 * size >= percent * 2**own))
        keep = in_class[doc]
        if not keep.any():
            continue
        d = doc[keep]
        top = 2 ** (own + 1) - 1
        differ = (2 * top * (100 - percent)) // (100 + percent)
        parts = differ + differ // 8 + 2  # more than differ + 1: else one empty fragment makes a set unsure
        frag = ((sets[keep] >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (frag[1:] != frag[:-1])])
        of, held = d[head], np.diff(np.r_[head, len(d)])
        name = mix(np.add.reduceat(hashed[keep], head) + frag[head] * np.uint64(0x2545F4914F6CDD1D) + own[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # how many n-grams this set and one that it links to may differ in
        most = (size + np.minimum(top, 100 * size // percent)) * (100 - percent) // (100 + percent)
        unsure |= in_class & (np.bincount(of, minlength=len(size)) <= most)
        order = np.lexsort((name, (of << 20) - np.minimum(held, (1 << 20) - 1)))
        of, name = of[order], name[order]
        stays = np.arange(len(of)) - np.searchsorted(of, of) <= most[of]
        out_doc.append(of[stays])
        out.append(name[stays])
    for d in np.flatnonzero(unsure):
        own = sets[off[d] : off[d + 1]]
        prefix = own[: len(own) - -(-len(own) * percent // 100) + 1]
        out_doc.append(np.full(len(prefix), d))
        out.append(mix(prefix + np.uint64(0x9FB21C651E98DF25)))
    return (np.concatenate(out_doc), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def parity(own: np.ndarray) -> np.ndarray:
    """A set's parity bitmap, as PARITY words."""
    odd = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _describe(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column("text")):
                sets, at = shingle_sets(data, off, n)
                sid = fingerprints(sets, at)
                _, once = np.unique(sid, return_index=True)  # copies at hand name their segments once
                doc, name = segment_names(sets, at, percent)
                mine = np.zeros(hi - lo, bool)
                mine[once] = True
                name, doc = name[mine[doc]], doc[mine[doc]]
                doc_order = np.argsort(doc, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("text_hash")[lo:hi], pa.array(np.diff(at)), _signed(sid), _lists(name[doc_order].view(np.int64), np.bincount(doc, minlength=hi - lo))],
                    ["doc_id", "text_hash", "n_shingles", "sid", "names"],
                )

    return run


def _in_filter(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = (key & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[slot >> 3] >> (slot & 7)) & 1).astype(bool)


def _repeated(bits: np.ndarray):
    """(name, sid) of names that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("names")
            name = names.flatten().to_numpy()
            sid = np.repeat(batch.column("sid").to_numpy(), names.value_lengths().to_numpy())
            keep = _in_filter(bits, name.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(sid[keep])], ["name", "sid"])

    return run


def _levels(n: int, percent: int) -> list[int]:
    """Cuts (2 ** level ranges) at which a set of n is needed: its own, and that of the largest sets it may link to."""
    own = max(1, ((n - 1) // SEGMENT).bit_length())
    return [own, own + 1] if 100 * n > percent * (SEGMENT << own) else [own]


def _members(n: int, percent: int, bits: np.ndarray):
    """Sets of texts whose key (the set's name and the row's) passes the filter, one fragment a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column("text")):
                tag += 1
                sets, at = shingle_sets(data, off, n)
                sid = fingerprints(sets, at)
                keep = np.flatnonzero((sid != 0) & _in_filter(bits, sid ^ batch.column("key")[lo:hi].to_numpy().view(np.uint64)))
                for d in keep[np.unique(sid[keep], return_index=True)[1]]:
                    own = sets[at[d] : at[d + 1]]
                    for i, level in enumerate(_levels(len(own), percent)):
                        cut = np.arange(1, 1 << level, dtype=np.uint64) << np.uint64((64 - level) % 64)
                        sizes = np.diff(np.r_[0, np.searchsorted(own, cut), len(own)])
                        k = np.flatnonzero(sizes)
                        fill = lambda v, t, k=k: pa.array(np.full(len(k), v, t))
                        odd = [parity(own) if i == j == 0 else None for j in range(len(k))]
                        yield pa.RecordBatch.from_arrays(
                            [fill(tag, np.int64), fill(sid[d].view(np.int64), np.int64), fill(len(own), np.int32), fill(level, np.int32), fill(i == 0, bool), pa.array(k.astype(np.int32)), _lists(own.view(np.int64), sizes[k]), pa.array(odd, pa.list_(pa.int64()))],
                            ["tag", "sid", "n", "level", "main", "frag", "grams", "odd"],
                        )

    return run


def _ceil(over: str, under: int) -> str:
    return f"(({over}) + {under - 1}) div {under}"


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes and parity bitmaps (a and b have n and odd) leave a link possible."""
    differ = " + ".join(f"bit_count({a}.odd[{i}] ^ {b}.odd[{i}])" for i in range(PARITY))
    return f"100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n) and {a}.n + {b}.n - ({differ}) >= 2 * ({_ceil(f'({a}.n + {b}.n) * {percent}L', 100 + percent)})"


def _met(percent: int, name, lo, hi, block, sid, comp, n, odd) -> tuple[np.ndarray, ...]:
    """(row, row, bits that differ) of the pairs that may link, of different components, inside each group (name, lo, hi) of sorted rows."""
    group = np.cumsum(np.r_[False, (name[1:] != name[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    two = lo != hi
    left, right, far = [], [], []
    i = np.arange(len(name))
    for k in range(1, len(name)):
        i = i[i < len(name) - k]
        i = i[group[i] == group[i + k]]
        if not len(i):
            break
        j = i + k
        ok = (comp[i] != comp[j]) & (~two[i] | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        a, b = i[ok], j[ok]
        differ = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64)
        total = n[a] + n[b]
        ok = total - differ >= 2 * (-(-total * percent // (100 + percent)))
        left.append(a[ok])
        right.append(b[ok])
        far.append(differ[ok])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (left, right, far))


def _meet(percent: int, closest: bool):
    """Pairs (a, b) that may link of rows sorted by (name, lo, hi); with ``closest``, of each two components the closest at hand only, and the names of lists with pairs held back."""
    columns = ["name", "lo", "hi", "block", "sid", "comp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [batch.column(c).to_numpy() for c in columns] + [batch.column("odd").flatten().to_numpy().view(np.uint64).reshape(-1, PARITY)]
                rows[6] = rows[6].astype(np.int64)
                rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
                if not len(rest[0]):
                    continue
                same = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1]) & (rest[2] == rest[2][-1])
                cut = int(np.flatnonzero(same)[0])  # the last group may go on
            elif rest is None:
                return
            else:
                cut = len(rest[0])
            rows, rest = [x[:cut] for x in rest], [x[cut:] for x in rest]
            if not cut:
                continue
            i, j, far = _met(percent, *rows)
            sid, comp = rows[4], rows[5]
            swap = sid[i] > sid[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((sid[j], sid[i]))
            i, j, far = i[order], j[order], far[order]
            a, b = sid[i], sid[j]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            pair = np.cumsum(new) - 1  # one number for a pair that meets in several lists
            told = np.flatnonzero(new)
            back = np.zeros(0, np.int64)
            if closest and len(a):
                u, v = np.minimum(comp[i], comp[j])[told], np.maximum(comp[i], comp[j])[told]
                order = np.lexsort((far[told], v, u))
                first = np.r_[True, (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])]
                told = told[order[first]]
                kept = np.zeros(pair[-1] + 1, bool)
                kept[pair[told]] = True
                back = np.unique(rows[0][i[~kept[pair]]])
            none = pa.nulls(len(back), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a[told]), pa.array(b[told]), pa.nulls(len(told), pa.int64())], ["a", "b", "name"])
            yield pa.RecordBatch.from_arrays([none, none, pa.array(back, pa.int64())], ["a", "b", "name"])

    return run


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the keys' low bits, put together by aggregation."""
    slot = F.expr(f"(key & {FILTER_BITS - 1}L) + 1")  # from 1: bucket b then holds slots from (b - 1) * 32768
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in stored(rows, "bits").collect():  # at most FILTER_BITS in all; stored, so that the shuffle behind it is let go
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def link_sets(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", count: bool = True) -> DataFrame:
    r"""One row per document: doc_id, text_hash, n_shingles, sid (the set's name), comp (the component's), component_id and, with ``count``, links (to other sets).

    Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased.  Two
    documents link when ``100 * |intersection| >= percent * |union|``.
    ``component_id`` is the smallest doc_id reachable by links, the document's
    own included; ``links`` counts the distinct other sets that its set links to.

    A null or empty text, or one of spaces only, has an empty set and links
    with nothing.  A null doc_id takes part and is never a component's name
    unless all its members are null.  Repeated rows come out as often as they
    came in.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    seen = stored(rows.mapInArrow(_describe(n, percent), "doc_id long, text_hash long, n_shingles long, sid long, names array<long>"), "sets")
    named = seen.select(F.explode("names").alias("name"), "sid")
    # summed map-side: a name of a third of all sets reaches the shuffle once a task
    again = stored(named.groupBy("name").agg(F.min("sid").alias("hub"), F.max("sid").alias("last")).where("hub < last").select("name", "hub"), "names")
    bits = _filter_bits(again.select(F.col("name").alias("key")))
    held = seen.select("sid", "names").mapInArrow(_repeated(bits), "name long, sid long")
    lists = stored(held.join(again, "name").select("name", "sid", "hub").distinct(), "lists")
    # of the rows of one set, one is read again
    key = F.xxhash64("doc_id", "text_hash").alias("key")
    first = seen.where("n_shingles > 0").groupBy("sid").agg(F.min(key).alias("first")).join(lists.select("sid").distinct(), "sid")
    bits = _filter_bits(first.select(F.col("sid").bitwiseXOR(F.col("first")).alias("key")))
    named, seen = seen, stored(seen.select("doc_id", "text_hash", "n_shingles", "sid"), "classes")
    drop(named, again)
    sets = stored(rows.select("text", key).mapInArrow(_members(n, percent, bits), "tag long, sid long, n int, level int, main boolean, frag int, grams array<long>, odd array<long>"), "grams")
    # a filter may let two rows of one set through: the tag tells which one counts
    heads = stored(sets.where("odd is not null").groupBy("sid").agg(F.min_by(F.struct("tag", "n", "odd"), "tag").alias("h")).select("sid", "h.*"), "heads")

    tried = _told(lists.where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct(), heads, percent)
    found = _verified(tried, sets, percent)
    comp = heads.select("sid").join(components(found).withColumnRenamed("node", "sid"), "sid", "left")
    comp = stored(comp.select("sid", F.coalesce("comp", "sid").alias("comp")), "comp")
    lists = _torn(lists, comp)
    for closest in (True, False):
        met = stored(_across(lists, heads, percent, closest), "met")
        pairs = _told(met.where("a is not null").select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), heads, percent)
        found = _verified(pairs, sets, percent, few=True)
        tried = tried.unionByName(pairs)
        comp = _merged(comp, found)
        held_back = met.where("name is not null").select("name").distinct()
        if held_back.isEmpty():
            break
        lists = _torn(lists.join(held_back, "name", "left_semi"), comp)

    comp = comp.join(heads.select("sid", "tag", "n"), "sid")
    if count:
        comp = comp.join(_counted(comp, sets, percent), "sid", "left")
        comp = comp.withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    else:
        comp = comp.withColumn("links", F.lit(None).cast("long"))
    nodes = stored(comp.select("sid", "comp", "links"), "nodes")
    drop(sets, heads)
    classes = seen.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least_id")).join(nodes, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    named_comp = classes.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    classes = stored(classes.join(named_comp, "comp").select("sid", "comp", "component_id", "links"), "classes")
    out = seen.join(classes, "sid", "left")
    out = out.select("doc_id", "text_hash", "n_shingles", "sid", "comp", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out if count else out.drop("links")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of link_sets: of the smallest doc_id (null is largest), then text hash.

    Rows without words are linked with nothing and all stay.  Of rows that
    repeat the doc_id and text that stays, one does, whatever else they hold.
    Other columns are kept, whatever their names; an empty table stays empty.
    """
    did, hashed, stays, nth = free(docs.columns, "did", "text_hash", "kept", "nth")
    linked = link_sets(docs, n, percent, doc_id, text, count=False)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("did"), "text_hash")
    keep = linked.where("n_shingles > 0").groupBy("comp").agg(F.min(place).alias("k")).select("k.*", F.lit(True).alias("kept")).distinct()
    empty = linked.where("n_shingles = 0").select(place.alias("k")).select("k.*", F.lit(False).alias("kept")).distinct()
    names = {"did": did, "text_hash": hashed, "kept": stays}
    keyed = docs.withColumn(did, F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))).withColumn(hashed, F.xxhash64(F.col(text).cast("string")))
    out = keyed.join(keep.unionByName(empty).withColumnsRenamed(names), [did, hashed])
    # of rows that repeat one document, one
    out = out.withColumn(nth, F.row_number().over(Window.partitionBy(did, hashed).orderBy(stays)))
    return out.where(~F.col(stays) | (F.col(nth) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _told(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Stored (a, b) that may link, with their sizes and tags."""
    side = lambda c: heads.select(F.col("sid").alias(c), F.struct("tag", "n", "odd").alias(f"h{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("ha", "hb", percent))
    return stored(both.select("a", "b", F.col("ha.n").alias("na"), F.col("hb.n").alias("nb"), F.col("ha.tag").alias("ta"), F.col("hb.tag").alias("tb")), "pairs")


def _torn(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Stored (name, sid, comp, parts) of lists whose members are in several components; parts: its blocks.  The others are done."""
    placed = stored(lists.select("name", "sid").join(comp, "sid"), "placed")
    torn = placed.groupBy("name").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("parts")).where("lo < hi").select("name", "parts")
    return stored(placed.join(torn, "name"), "torn")


def _across(torn: DataFrame, heads: DataFrame, percent: int, closest: bool) -> DataFrame:
    """_meet's rows for lists whose members are in several components: block against block."""
    rows = torn.withColumn("block", F.expr("cast(pmod(xxhash64(sid), parts) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).join(heads.select("sid", "n", "odd"), "sid")
    rows = rows.select("name", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "comp", "n", "odd")
    rows = rows.repartition("name", "lo", "hi").sortWithinPartitions("name", "lo", "hi")
    return rows.mapInArrow(_meet(percent, closest), "a long, b long, name long")


def _merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """comp (sid, comp) after the links ``found``: components of the components."""
    side = lambda c: comp.select(F.col("sid").alias(c), F.col("comp").alias(f"c{c}"))
    ends = found.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    up = components(stored(ends.distinct(), "ends")).select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return stored(comp.join(up, "comp", "left").select("sid", F.coalesce("up", "comp").alias("comp")), "comp")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """Those of _told's pairs that reach the threshold: overlaps counted in each fragment, summed per pair.  ``few`` pairs: only their sets are shuffled."""
    if few:
        used = pairs.select(F.col("a").alias("sid"), F.col("ta").alias("tag")).union(pairs.select("b", "tb")).distinct()
        sets = stored(sets.join(used, ["sid", "tag"], "left_semi"), "own")

    def side(c: str) -> DataFrame:
        own = sets
        if not few:  # each side's own sets only, by a filter of fixed size
            bits = bitmap(pairs.select(F.col(c).alias("sid"), F.col(f"t{c}").alias("tag")).distinct(), "sid", "tag")
            own = tested(sets, bits, "used", "sid", "tag").where("used")
        return own.select(F.col("sid").alias(c), F.col("tag").alias(f"t{c}"), "level", "frag", F.col("grams").alias(f"g{c}"))

    over = f"(greatest(na, nb) - 1) div {SEGMENT}"
    cut = pairs.withColumn("level", F.expr(f"case when {over} = 0 then 1 else length(bin({over})) end"))
    both = cut.join(side("a"), ["a", "ta", "level"]).join(side("b"), ["b", "tb", "level", "frag"])
    part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    out = stored(total.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "verified")
    if few:
        drop(sets)
    return out


def _block_links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        sid, first, who = np.unique(rows.column("sid").to_numpy(), return_index=True, return_inverse=True)
        n, block = (rows.column(c).to_numpy()[first].astype(np.int64) for c in ("n", "block"))
        grams = rows.column("grams").combine_chunks()
        who = np.repeat(who, grams.value_lengths().to_numpy())
        _, col, times = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[col] > 1
        who, (_, col) = who[shared], np.unique(col[shared], return_inverse=True)
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        common = np.zeros((len(sid), len(sid)), np.int64)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            i, j = np.searchsorted(col, [lo, lo + 4096])
            has = np.zeros((len(sid), 4096), np.float32)
            has[who[i:j], col[i:j] - lo] = 1
            common += (has @ has.T).astype(np.int64)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(linked, False)
        if rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():
            linked &= block[:, None] != block[None, :]
        return pa.table({"sid": pa.array(sid), "links": pa.array(linked.sum(1).astype(np.int64))})

    return run


def _counted(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, links) for the sets of all components (nodes: sid, tag, n, comp) of two or more."""
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("k"), F.sum("n").alias("grams")).where("k > 1")
    sizes = sizes.select("comp", "k", F.ceil(F.greatest(F.col("grams") / BLOCK, F.col("k") / BLOCK_SETS)).cast("int").alias("parts"))
    placed = stored(nodes.select("sid", "tag", "comp").join(sizes, "comp"), "members")
    pairs = placed.where("k = 2").select("sid", F.lit(1).cast("long").alias("links"))
    own = stored(sets.where("main").select("sid", "tag", "n", "frag", "grams").join(placed.where("k > 2"), ["sid", "tag"]), "members")
    dealt = own.withColumn("block", F.expr("pmod(xxhash64(sid), parts)").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "n", "grams")
    found = dealt.groupBy("comp", "lo", "hi").applyInArrow(_block_links(percent), "sid long, links long")
    out = stored(found.groupBy("sid").agg(F.sum("links").alias("links")).unionByName(pairs), "counted")
    drop(own, placed)
    return out
