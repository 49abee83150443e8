"""WARC archives: writing, and reading back by boundary-chain verification.

Writing goes through Spark's text writer, so archives land on whatever file system the path names, as plain WARC/1.0
files that can be split.  Reading cuts the files at every magic ``WARC/1.0\\r\\n`` wherever it stands, in payloads too.
Each cut is only a candidate: a task parses what follows as a header and emits the candidate's offset and the offset of
its successor.  Pointer jumping from offset 0 of each file, doubling the step each round, keeps the candidates that the
chain of lengths reaches; a magic inside a payload is not among them, even if a whole record follows it.  A record whose
payload holds magics is put together again from its cuts.  A chain must lead to the very end of its file: an archive that
is cut off, or whose lengths are damaged, is an error that names the file and the place, never a shorter result.

Null html counts as an empty payload, a null url as an empty one; white space and control characters in a url are
written as %20.  Rows that repeat a page_id are records of their own.  Payloads under ``least`` bytes are never revisits.
An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import buffers, new_path, settled, shared_dir, small_batches, stored

MAGIC = "WARC/1.0\r\n"
#: Revisit rows that may be broadcast (under 100 bytes each); with more, the join is shuffled.
BROADCAST_ROWS = 50_000


def record_types(pages: DataFrame, least: int = 100) -> DataFrame:
    """(digest, refers_to) for digests that more than one payload of at least ``least`` bytes has."""
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n")).where(F.col("_n") >= least)
    return keyed.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies").checkpoint()


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """One record for each row of pages (page_id, url, html) into files under path."""
    shared_dir(pages.sparkSession)
    copies = record_types(pages, least)
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n"))
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(copies) if small else copies, "_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("_n") >= least) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "_body"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), named("page_id"),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.col("_url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("_digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), named("_first"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit("\r\n\r\n"),
    )
    rows = rows.withColumn("_block", block)
    rows.select(F.concat(head, "_block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n"))}


def _ident(x: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", x or b"")
    return int(m[1]) if m else None


def parse(head: bytes, block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record; a stored payload must have the digest that its header names."""
    f = _fields(head)
    kind, digest = f[b"warc-type"].decode(), f[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(_fields(http)[b"content-length"])
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a record's payload differs from its digest {digest}")
    return _ident(f.get(b"warc-record-id")), n, digest, kind, _ident(f.get(b"warc-refers-to"))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"))


def _candidates(batches):
    """For each cut, in file order: its place in its split, how many bytes it takes, how many its record takes by its header (null without one), and the record where the cut holds all of it."""
    magic, at, seen = len(MAGIC), None, (0, 0)
    for batch in batches:
        flat, off = buffers(batch.column(0))
        raw = flat.tobytes()
        out = []
        for i, (file, block, size) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
            if at != (file, block):
                at, seen = (file, block), (0, 0)
            k, place = seen
            cut = raw[off[i] : off[i + 1]]
            first = k == 0 and block == 0  # what stands before the first magic of a file
            unit = len(cut) + (0 if first else magic)
            head, gap, block_bytes = cut.partition(b"\r\n\r\n")
            length = None if first or not gap else re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", head)
            takes = magic + len(head) + 4 + int(length[1]) + 4 if length else None
            record = _tried(head, block_bytes[:-4]) if takes == unit else (None,) * 5
            out.append((file, block, size, k, place, unit, takes, record[3] is not None, *record))
            seen = (k + 1, place + unit)
        columns = list(zip(*out, strict=True)) or [()] * 13
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)


def _tried(head: bytes, block: bytes) -> tuple:
    """parse(), or nothing where this is no record: most often a magic in a payload.  A reachable record without a result is read again, and then an error is one."""
    try:
        return parse(head, block)
    except (KeyError, ValueError):
        return (None,) * 5


NAMES = ["file", "block", "file_size", "k", "place", "unit", "takes", "whole", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def reachable(edges: DataFrame) -> DataFrame:
    """(file, off) of every offset on the chain from offset 0 of its file; edges: (file, off, succ)."""
    size = edges.count()
    jump = settled(edges.where("succ is not null"), size)
    found = settled(jump.where("off = 0").select("file", "off"), size)
    n = found.count()
    while True:
        step = found.join(jump, ["file", "off"]).select("file", F.col("succ").alias("off"))
        found = settled(found.unionByName(step).distinct(), size)
        now = found.count()
        if now == n:
            # the last step of each chain is the end of its file, which is no record
            return found.join(edges.select("file", "off"), ["file", "off"], "left_semi")
        n = now
        far = jump.select("file", F.col("off").alias("succ"), F.col("succ").alias("_far"))
        jump = settled(jump.join(far, ["file", "succ"]).select("file", "off", F.col("_far").alias("succ")), size)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    shared_dir(spark)
    small_batches(spark)
    schema = f"file string, block long, file_size long, k long, place long, unit long, takes long, whole boolean, {RECORD}"
    cuts = stored(_cuts(spark, path).mapInArrow(_candidates, schema), "cuts")
    blocks = cuts.groupBy("file", "block", "file_size").agg(F.sum("unit").alias("_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("file")
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"), (F.sum("_size").over(total) == F.col("file_size")).alias("_fits"))
    placed = cuts.join(blocks, ["file", "block"]).withColumn("off", F.when(F.col("_fits"), F.col("_base") + F.col("place")).otherwise(F.raise_error("cuts do not add up to their file")))
    placed = placed.where("not (block = 0 and k = 0)").select("file", "off", "unit", (F.col("off") + F.col("takes")).alias("succ"), "whole", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    placed = settled(placed, cuts.count())
    real = placed.join(reachable(placed.select("file", "off", "succ")), ["file", "off"], "left_semi").checkpoint()
    ends = real.groupBy("file").agg(F.max(F.coalesce("succ", "off")).alias("_end"))
    sizes = cuts.groupBy("file").agg(F.max("file_size").alias("_size"))
    short = sizes.join(ends, "file", "left").where("_size > 0 and not (_end <=> _size)").orderBy("file").limit(3).collect()
    if short:
        raise ValueError("damaged archives: " + ", ".join(f"{r['file']} ends at {r['_size']}, its records at {r['_end']}" for r in short))
    fields = [c.split()[0] for c in RECORD.split(", ")]
    whole = real.where("whole and succ = off + unit").select(*fields)
    broken = real.where("not (whole and succ = off + unit)").select("file", F.col("off").alias("_from"), F.col("succ").alias("_to")).checkpoint()
    if broken.isEmpty():
        return whole
    return whole.unionByName(_joined(spark, path, blocks, broken))


def _joined(spark: SparkSession, path: str, blocks: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magics: their cuts, read again and put together."""

    def numbered(batches):
        at, k, place = None, 0, 0
        for batch in batches:
            values = batch.column(0).to_pylist()
            where = list(zip(*(batch.column(j).to_pylist() for j in (1, 2)), strict=True))
            places = []
            for v, w in zip(values, where, strict=True):
                if w != at:
                    at, k, place = w, 0, 0
                places.append(-1 if k == 0 and w[1] == 0 else place)  # what stands before a file's first magic is in no record
                place += len(v.encode()) + (0 if k == 0 and w[1] == 0 else len(MAGIC))
                k += 1
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.int64()), batch.column(0)], names=["file", "block", "place", "value"])

    again = _cuts(spark, path).drop("file_size").mapInArrow(numbered, "file string, block long, place long, value string")
    again = again.join(blocks, ["file", "block"]).select("file", (F.col("_base") + F.col("place")).alias("off"), "value")
    # a chunk of 64 MB at most lies between a record's start and each of its cuts' own chunk, so the join has a key besides the range
    step = 1 << 26
    spread = broken.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor(F.col("_to") / step))))
    held = again.withColumn("_chunk", F.floor(F.col("off") / step)).join(spread, ["file", "_chunk"]).where("off >= _from and off < _to")
    parts = held.groupBy("file", "_from", "_to").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("_parts"))

    def run(batches):
        for batch in batches:
            out = []
            for n, parts_ in zip((np.array(batch.column(2)) - np.array(batch.column(1))).tolist(), batch.column(3).to_pylist(), strict=True):
                raw = MAGIC.join(["", *[p["value"] for p in parts_]]).encode()[:n]
                head, _, block = raw[len(MAGIC) :].partition(b"\r\n\r\n")
                out.append(parse(head, block[:-4]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    return parts.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages into archives under the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path)
