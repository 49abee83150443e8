"""MinHash document fingerprints.

Each of ``perms`` universal hash permutations keeps its least value over a text's shingles (five lower-cased words; of a
shorter text the whole sequence as one); all permutations run at once in numpy.  The fingerprint is the hexadecimal
signature, so equal texts have equal fingerprints, and the share of equal components estimates the Jaccard similarity.
A text without words has the fingerprint of all ones, which is like itself and unlike any other.

``similar_classes`` joins bands of the signatures in Spark: documents that share a band's value are candidates, and the
Jaccard similarity of their shingle sets decides.  Equal sets are one member under their smallest id.  Each member is
verified against the smallest id of its band; what a band still holds in more than one class is divided by pivots and
compared in blocks as regions of the Jaccard join are (``jaccard_join.deeper``).  16 bands of 4 components find a pair of similarity 0.75 with probability 0.998 and a class through any of its links.
``similar_pairs`` gives the verified pairs themselves.

Null texts count as empty; rows that repeat a doc_id each get a result, and share its class; rows without an id have no
class.  An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import BROADCAST_ROUTES, LINK, _verified, deeper
from .shared import buffers, shared_dir, small_batches, stored, texts
from .words import groups, shingles

PERMS = 64


def coefficients(perms: int = PERMS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(61))
    return rng.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, perms, dtype=np.uint64)


def signature(sets: list[np.ndarray], perms: int = PERMS, block: int = 4096) -> np.ndarray:
    """perms 32-bit minima for each set: multiply-add modulo 2**64, whose upper half is universal."""
    a, b = coefficients(perms)
    out = np.full((len(sets), perms), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        for at in range(0, len(s), block):
            h = a[:, None] * s[None, at : at + block]
            h += b[:, None]
            out[i] = np.minimum(out[i], (h.min(1) >> np.uint64(32)).astype(np.uint32))
    return out


def sets_of(bodies: list[str]) -> list[np.ndarray]:
    flat, offsets = buffers(pa.array(bodies, pa.large_string()))
    out = []
    for at, to in groups(offsets):
        out += shingles(flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", perms: int = PERMS) -> DataFrame:
    """(id, fingerprint) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sig = signature(sets_of(texts(batch.column(1))), perms)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in sig], pa.string())], names=[id_col, "fingerprint"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string"
    return docs.select(id_col, text).mapInArrow(run, schema)


def banded(rows: DataFrame, bands: int) -> DataFrame:
    """(_id, _digest, _bands) of every row (id, text) with words: a 128-bit digest of its shingle set and a 64-bit one of each band of its signature."""

    def run(batches):
        for batch in batches:
            sets = sets_of(texts(batch.column(1)))
            sig = signature(sets)
            some = np.flatnonzero([len(s) > 0 for s in sets])
            keys = [[int.from_bytes(hashlib.blake2b(bytes([j]) + part.tobytes(), digest_size=8).digest(), "little", signed=True) for j, part in enumerate(np.split(sig[i], bands))] for i in some]
            digests = [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_digest", "_bands"])

    return rows.mapInArrow(run, f"_id {rows.schema[rows.columns[0]].dataType.simpleString()}, _digest binary, _bands array<long>")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bands: int = 16) -> DataFrame:
    """(id, class_id) of the documents with a link (similarity 0.75 or more, verified) or an equal set: the smallest id that links reach.  The others are a class of their own."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    rows = stored(banded(known, bands), "bands")
    heads = stored(rows.groupBy("_digest").agg(F.min("_id").alias("_head"), F.first("_bands").alias("_bands")), "heads")
    copies = rows.select("_id", "_digest").join(heads.select("_digest", "_head"), "_digest").where("_id <> _head").select(F.col("_id").alias("a"), F.col("_head").alias("b"))
    # a repeated id whose texts differ heads several sets: it is one document in links
    members = heads.select(F.col("_head").alias("a"), F.explode("_bands").alias("region")).distinct()
    low = members.groupBy("region").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = stored(members.join(low, "region").select("region", "a", "b"), "members")
    first = _verified(known, members.where("a <> b").select("a", "b").distinct(), parts, 5)
    label = components(first.where(LINK).select("a", "b")).select(F.col("node").alias("a"), "component").checkpoint()
    label = deeper(known, members.select("region", "a"), label)
    near = copies.join(label.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("class_id"))
    return near.unionByName(label.withColumnRenamed("component", "class_id")).groupBy(F.col("a").alias(id_col)).agg(F.min("class_id").alias("class_id"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.75, bands: int = 16, block: int = 128) -> DataFrame:
    """(id, other, similarity), other < id: all pairs of different sets that share a band value and are similar enough, verified on shingle sets.

    Equal sets stand for each other under their smallest id, with which each other copy makes one pair: a group of copies
    gives as many pairs as it has members, not their square.  Rows without an id or without words make no pairs.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = sets_of(texts(batch.column(1)))
            sig = signature(sets)
            keys = [[hashlib.blake2b(bytes([j]) + x[j * len(x) // bands : (j + 1) * len(x) // bands].tobytes(), digest_size=8).hexdigest() for j in range(bands)] if len(s) else [] for x, s in zip(sig, sets, strict=True)]
            raw = [s.tobytes() for s in sets]
            digests = [hashlib.blake2b(x, digest_size=16).hexdigest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.string())), pa.array(raw, pa.binary())], names=["_id", "_digest", "_bands", "_set"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(id_col, text).where(F.col(id_col).isNotNull())
    rows = stored(named.mapInArrow(run, f"_id {kind}, _digest string, _bands array<string>, _set binary"), "bands").where(F.size("_bands") > 0)
    heads = rows.groupBy("_digest").agg(F.min("_id").alias("_head"), F.first("_bands").alias("_bands"))
    copies = rows.select("_id", "_digest").join(heads.select("_digest", "_head"), "_digest").where("_id <> _head").select("_id", F.col("_head").alias("_other"), F.lit(1.0).alias("_sim"))
    member = heads.select("_digest", F.col("_head").alias("_id"), F.explode("_bands").alias("_band"))
    blocks = member.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_band", F.ceil(F.col("_n") / block).alias("_blocks"))
    # each member goes to the cells of its block with every block of the band, its own among them
    cells = member.join(blocks, "_band").withColumn("_block", F.pmod(F.xxhash64("_digest"), "_blocks"))
    cells = cells.select("_digest", "_id", "_band", "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_with"))
    cells = cells.select("_digest", "_id", "_band", "_block", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j"))
    full = cells.join(rows.select("_digest", "_set").dropDuplicates(["_digest"]), "_digest")

    def verified(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        ids, where, sets = cell["_id"].tolist(), cell["_block"].to_numpy(), [np.frombuffer(x, np.uint64) for x in cell["_set"]]
        sizes, out = np.array([len(x) for x in sets]), []
        for a in range(len(ids)):
            if where[a] != key[1]:
                continue
            fits = np.minimum(sizes, sizes[a]) >= threshold * np.maximum(sizes, sizes[a])
            fits &= (where != key[1]) if key[1] != key[2] else (np.arange(len(ids)) > a)
            for b in np.flatnonzero(fits):
                n = len(np.intersect1d(sets[a], sets[b], True))
                similarity = n / (sizes[a] + sizes[b] - n)
                if similarity >= threshold and ids[a] != ids[b]:
                    out.append((max(ids[a], ids[b]), min(ids[a], ids[b]), float(similarity)))
        return pd.DataFrame(out, columns=["_id", "_other", "_sim"])

    pairs = full.groupBy("_band", "_i", "_j").applyInPandas(verified, f"_id {kind}, _other {kind}, _sim double")
    found = pairs.unionByName(copies.where(F.col("_sim") >= threshold)).distinct()
    return found.select(F.col("_id").alias(id_col), F.col("_other").alias("other"), F.col("_sim").alias("similarity"))


def ranges_of(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The first (_key, _hash) of each of up to parts ranges of about the same number of rows, in descending order.

    Spark's range partitioner cuts the ids, which travel without their texts; the driver gets a row for each partition.
    """
    cut = rows.select("_key", "_hash").repartitionByRange(parts, F.desc("_key"), F.desc("_hash"))
    tops = cut.groupBy(F.spark_partition_id().alias("_p")).agg(F.max(F.struct("_key", "_hash")).alias("_top"))
    return sorted(((r["_top"]["_key"], r["_top"]["_hash"]) for r in tops.collect()), reverse=True)


def _sortable(key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """16 bytes for each pair of 64-bit numbers that sort as the pairs do."""
    both = np.stack([key, hashed], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def neighbours_and_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None, classes: bool = False) -> DataFrame:
    """Per row, in descending id order: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; with classes also class_id.

    The edited text replaces the last n_chars // 3 code points by as many of the next document's first ones (all, if it
    has fewer); after the last document comes the first.  Rows with one id follow each other by a hash of their text, rows
    without an id come last in such an order.  The rows are cut into ranges; each is sorted and read as a stream by one
    task, and the first row of the following range travels along with it, so the text is exchanged once and a task holds
    two documents at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own_id = F.col(f"`{id_col}`").cast("long")
    key = F.coalesce(own_id, F.pmod(F.xxhash64(body), F.lit(1 << 40)) + F.lit(-(2**63)))  # rows without an id spread over keys of their own
    rows = docs.select(own_id.alias("_id"), key.alias("_key"), F.xxhash64(body, F.lit(1)).alias("_hash"), body.alias("_text"))
    tops = ranges_of(rows, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = _sortable(*np.array(tops[::-1], np.int64).reshape(-1, 2).T)

    @F.pandas_udf("int")
    def place(keys, hashed):
        import pandas as pd

        return pd.Series((len(edges) - 1 - np.searchsorted(edges, _sortable(keys.to_numpy(), hashed.to_numpy()))).astype(np.int32))

    own = rows.select(place("_key", "_hash").alias("_range"), F.lit(0).alias("_tail"), "_id", "_key", "_hash", "_text")
    if tops:
        head = spark.createDataFrame([(*top, (i - 1) % len(tops)) for i, top in enumerate(tops)], "_key long, _hash long, _to int")
        first = rows.join(F.broadcast(head), ["_key", "_hash"]).groupBy("_to").agg(F.min("_text").alias("_text"))
        none = F.lit(None).cast("long")
        own = own.unionByName(first.select(F.col("_to").alias("_range"), F.lit(1).alias("_tail"), none.alias("_id"), none.alias("_key"), none.alias("_hash"), "_text"))
    dealt = own.repartitionById(max(1, len(tops)), F.col("_range")).sortWithinPartitions("_tail", F.desc("_key"), F.desc("_hash"), "_text").select("_tail", "_id", "_text")

    def run(batches):
        held = None  # the row whose next one is still to come
        for batch in batches:
            cur = [] if held is None else [held]
            cur += list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            if not cur:
                continue
            held, out, edited = cur[-1], [], []
            for x, y in zip(cur, cur[1:], strict=False):
                if not x[0]:
                    own, k = x[2], len(x[2]) // 3
                    out.append((x[1], len(own)))
                    edited.append(own[: len(own) - k] + y[2][:k])
            sig = signature(sets_of([x[2] for x in cur]))
            at = [i for i, x in enumerate(cur[:-1]) if not x[0]]
            sig2 = signature(sets_of(edited))
            own, nxt = sig[at], sig[[i + 1 for i in at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array([x.tobytes().hex() for x in own], pa.string()),
                    pa.array([x.tobytes().hex() for x in sig2], pa.string()),
                    pa.array((own == sig2).mean(1) if at else [], pa.float64()),
                    pa.array((own == nxt).mean(1) if at else [], pa.float64()),
                ],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    found = dealt.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    if not classes:
        return found
    named = stored(similar_classes(docs, id_col, text), "classes")
    few = named.limit(BROADCAST_ROUTES + 1).count() <= BROADCAST_ROUTES
    return found.join(F.broadcast(named) if few else named, id_col, "left").withColumn("class_id", F.coalesce("class_id", F.col(f"`{id_col}`")))
