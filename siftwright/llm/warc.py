r"""WARC archives: writing records of pages and reading any archive back.

*Writing* uses Spark's own text writer: a record is one row and
``\r\n\r\n`` the separator, so archives are written by all tasks, committed as
usual, to any file system.  Pages whose payloads are equal are written once;
the others are revisit records that name the first.  Digests are counted
without payloads; of a payload that occurs once the record is written where
its page is read, and of one that repeats a single copy is shuffled.

*Reading* splits archives at the magic ``WARC/1.1\r\n``.  What follows a magic
is only a candidate, as payloads may hold the magic too.  Each candidate gives
an edge from its offset to the offset where its record would end.  Only
candidates on the chain from the file's start are records.  A task follows
chains inside its own split; between splits, pointer jumping (reach and jump
tables doubled each round) finds the entries that are reached.  What lies
between two records of the chain is payload, whatever it looks like.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.splits import rows_in_order
from .bitmaps import bitmap, tested
from .storage import fresh_path, stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
NO_PAGE = "null"


def base32(hexed: Column) -> Column:
    """RFC 4648 base 32 (upper case, 160 bits need no padding) of a SHA-1 in hexadecimal."""
    five = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type, refers_to: of equal payloads, the largest page_id is the response.

    A revisit's payload is left empty; payload_bytes tells its length.  A null
    payload is empty; null page_ids are smallest, and of rows that repeat the
    largest page_id the first by url is the response.  Payloads of fewer than
    ``least_bytes`` bytes are all responses.  Repeated rows get a record each,
    other columns are ignored, an empty table has no records.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    large = rows.where(F.col("n") >= least_bytes)
    ids = large.groupBy("sha", "n", "page_id").agg(F.count("*").alias("c"))
    # times: how often the largest page_id repeats
    digests = stored(ids.groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.sum("c").alias("total"), F.coalesce(F.max_by("c", "page_id"), F.sum("c")).alias("times")), "digests")
    repeats = bitmap(digests.where("total > 1"), "sha", "n")
    # with digests that occur once but look repeated to the filter: whatever it marks is then found here
    marked = stored(tested(digests, repeats, "again", "sha", "n").where("again").select("sha", "n", "top", "times"), "repeats")
    tops = bitmap(marked, "sha", "n", "top")

    both = tested(large, repeats, "again", "sha", "n")
    again = both.where("again").drop("again")
    none = F.lit(None).cast("long")
    once = rows.where(F.col("n") < least_bytes).unionByName(both.where("not again").drop("again")).withColumn("refers_to", none)
    same, order = F.col("page_id").eqNullSafe(F.col("top")), Window.partitionBy("sha", "n", "page_id").orderBy("url")

    def met(some: DataFrame, response: bool) -> DataFrame:
        """Responses, or revisits, among rows of marked digests; only rows that repeat a largest page_id are ordered."""
        both = some.join(marked, ["sha", "n"])
        alone = both.where(same & (F.col("times") == 1) if response else ~same)
        several = both.where(same & (F.col("times") > 1)).withColumn("nth", F.row_number().over(order)).where("nth = 1" if response else "nth > 1").drop("nth")
        return alone.unionByName(several).withColumn("refers_to", none if response else F.col("top")).drop("top", "times")

    # bodies of the largest page_ids only, and keys of all others
    bodies = tested(again.withColumn("top", F.col("page_id")), tops, "mine", "sha", "n", "top").where("mine").drop("mine", "top")
    keys = again.drop("payload")
    parts = [(once, "response"), (met(bodies, True), "response"), (met(keys, False).withColumn("payload", F.lit(b"")), "revisit")]
    out = [p.select("page_id", "url", "payload", F.col("n").alias("payload_bytes"), base32(F.col("sha")).alias("digest"), F.lit(kind).alias("record_type"), "refers_to") for p, kind in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit(NO_PAGE)), F.lit(">"))


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes plan_records' rows as archives under ``path``; line breaks in a url are percent-encoded, a null url is left out."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.col("payload")
    revisit = F.when(F.col("record_type") == "revisit", F.concat(field("WARC-Refers-To", _name(F.col("refers_to"))), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
    head = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _name(F.col("page_id"))),
        F.coalesce(field("WARC-Target-URI", uri), F.lit("")),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(revisit, F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
    )
    # a string of any bytes: the writer copies them
    records.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, in the order of the files; mid names a row for good, as splits.rows_in_order fixes where files are cut."""
    raw = rows_in_order(spark, path, MAGIC)
    return raw.select("value", "file", "block", F.monotonically_increasing_id().alias("mid"))


def _chain(entries: bool):
    """Chains inside a split: each candidate's way out, or the candidates reached from given entries."""

    def run(key, rows: pa.Table, *more: pa.Table) -> pa.Table:
        file, block = (k.as_py() for k in key)
        rows = rows.sort_by("start")
        start, end = rows.column("start").to_pylist(), rows.column("end").to_pylist()
        after = dict(zip(start, end, strict=True))
        if not entries:
            leaves: dict[int, int | None] = {}
            for s in reversed(start):
                e = after[s]
                leaves[s] = e if e is None or e > start[-1] else leaves.get(e)
            return pa.table({"file": [file] * len(start), "start": pa.array(start, pa.int64()), "leaves": pa.array([leaves[s] for s in start], pa.int64())})
        reached = set()
        for s in more[0].column("start").to_pylist():
            while s in after and s not in reached:
                reached.add(s)
                s = after[s]
        reached = sorted(reached)
        return pa.table({"file": [file] * len(reached), "block": pa.array([block] * len(reached), pa.int64()), "start": pa.array(reached, pa.int64())})

    if entries:
        return lambda key, a, b: run(key, a, b)
    return lambda key, a: run(key, a)


def _reached(cand: DataFrame) -> DataFrame:
    """(file, block, start) of candidates (file, block, start, end) on the chains from offset 0."""
    way = cand.groupBy("file", "block").applyInArrow(_chain(False), "file string, start long, leaves long")
    way = stored(way, "ways")
    # only what some chain leads to, and the start of a file, can be an entry
    aims = way.where("leaves is not null").select("file", F.col("leaves").alias("start")).union(way.select("file", F.lit(0).cast("long"))).distinct()
    jump = stored(way.where("leaves is not null").join(aims, ["file", "start"], "left_semi").select("file", "start", F.col("leaves").alias("to")).distinct(), "jumps")
    reach = stored(cand.where("start = 0").select("file", "start").distinct(), "reach")
    n = reach.count()
    while n:
        more = reach.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        reach = stored(reach.union(more).distinct(), "reach")
        now = reach.count()
        if now == n:
            break
        n = now
        step = jump.select("file", F.col("start").alias("first"), F.col("to").alias("start"))
        far = step.join(jump, ["file", "start"]).select("file", F.col("first").alias("start"), "to")
        jump = stored(jump.union(far).distinct(), "jumps")
    entry = stored(reach.join(cand.select("file", "block", "start"), ["file", "start"]), "entries")
    return cand.groupBy("file", "block").cogroup(entry.groupBy("file", "block")).applyInArrow(_chain(True), "file string, block long, start long")


def _get(name: str, of: Column) -> Column:
    """A header field's value, null if it is missing or empty."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), of), rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))


def _record(value: Column, http: bool) -> dict[str, Column]:
    """What a record says whose header starts ``value``, payload last.  A declared length that is no number gives nulls."""
    head = F.substring_index(value, END, 1)
    n = _get("Content-Length", head).try_cast("int")
    block = F.substring(value.cast("binary"), F.octet_length(head) + len(END) + 1, n).cast("string")
    http_head = F.substring_index(block, END, 1) if http else F.lit("")
    skip = F.octet_length(http_head) + len(END) if http else F.lit(0)
    payload = F.substring(block.cast("binary"), skip + 1, F.octet_length(block))
    revisit = _get("WARC-Type", head) == "revisit"
    length = _get("Content-Length", http_head).try_cast("long") if http else F.lit(None).cast("long")
    return {
        "record_type": _get("WARC-Type", head),
        "record_id": _get("WARC-Record-ID", head),
        "target_uri": _get("WARC-Target-URI", head),
        "refers_to": _get("WARC-Refers-To", head),
        "digest": F.when(revisit, F.regexp_replace(_get("WARC-Payload-Digest", head), "(?i)^sha1:", "")).otherwise(base32(F.sha1(payload))),
        "payload_bytes": F.when(revisit, length).otherwise(F.octet_length(payload).cast("long")),
        "payload": payload,
    }


def read_warc(spark: SparkSession, path: str, http: bool = True, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    file, start, record_type, record_id, target_uri, refers_to (a record id),
    digest (its payload's SHA-1 in base 32, computed; for a revisit the one it
    names), payload_bytes (for a revisit the length its HTTP header names) and,
    if asked for, payload.  A record that ends beyond its file, or is not
    reached from the file's start, is left out; an empty file has none.

    Bodies are looked at where they are read: only numbers and header fields
    are shuffled, and the bodies of records that hold a magic themselves.
    """
    chunk = _chunks(spark, path)
    value, keys = F.col("value"), ["file", "block", "mid"]
    head = F.substring_index(value, END, 1)
    told = lambda d: {k: v for k, v in _record(d, http).items() if k != "payload"}
    said = list(told(value))
    fields = chunk.select(*keys, F.octet_length(value).cast("long").alias("size"), F.octet_length(head).cast("long").alias("head_bytes"), _get("Content-Length", head).try_cast("long").alias("n"), *[v.alias(k) for k, v in told(value).items()])
    fields = stored(fields, "chunks")
    # offsets: every byte is in one chunk or one magic
    order = Window.partitionBy("file", "block").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fields.select(*keys, "size", "head_bytes", "n").withColumn("ahead", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order), F.lit(0)))
    blocks = fields.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    sofar = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bytes").over(sofar), F.lit(0))).select("file", "block", "base")
    placed = sizes.join(blocks, ["file", "block"]).withColumn("start", F.col("base") + F.col("ahead") - len(MAGIC))
    placed = placed.withColumn("end", F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("n") + 2 * len(END))
    placed = stored(placed.where("start >= 0").select(*keys, "start", "end", "size"), "candidates")
    ends = placed.groupBy("file").agg(F.max(F.col("start") + F.col("size") + len(MAGIC)).alias("file_bytes"))
    cand = placed.where("end is not null").join(ends, "file").where("end <= file_bytes").select("file", "block", "start", "end")
    real = stored(_reached(stored(cand, "edges")), "real").withColumn("real", F.lit(True))
    marked = placed.join(real, ["file", "block", "start"], "left").withColumn("real", F.coalesce("real", F.lit(False)))
    whole = F.col("real") & (F.col("start") + len(MAGIC) + F.col("size") >= F.col("end"))
    marked = stored(marked.withColumn("whole", whole), "marked")

    simple = fields.join(marked.where("whole").select(*keys, "start"), keys)
    if payload:
        simple = simple.join(chunk, keys).withColumn("payload", _record(value, http)["payload"])
    said += ["payload"] * payload
    # records whose payload holds a magic, and the pieces they own: rare, and joined in the order of the file
    owner = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    torn = marked.where("not whole").withColumn("own", F.last(F.when(F.col("real"), F.struct("start", "end")), True).over(owner)).where("start < own.end")
    torn = stored(torn.select(*keys, "start", "own"), "torn")  # its size is then known: a few rows are broadcast
    pieces = chunk.join(torn, keys)
    glued = pieces.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    glued = glued.select("file", F.col("own.start").alias("start"), F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    glued = glued.select("file", "start", *[v.alias(k) for k, v in _record(value, http).items() if k in said])
    return simple.select("file", "start", *said).unionByName(glued)


def round_trip(pages: DataFrame, payload: bool = False, **columns) -> DataFrame:
    """Pages written as archives in the shared folder and read back: read_warc's rows with page_id and refers_to as numbers.

    Every row of ``pages`` comes back as one record, nulls, repetitions and
    ties as plan_records has them; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(plan_records(pages, **columns), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as long)")
    return read_warc(spark, path, payload=payload).withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to"))
