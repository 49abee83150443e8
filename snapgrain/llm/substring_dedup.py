"""Substring dedup by super-k-mers.

A window is ``k`` consecutive words of one document.  Every window's minimiser is the least hash among its runs of ``m``
words; consecutive windows with one minimiser travel as one packed string to the minimiser's bucket, where all windows
are cut out again, sorted, and each gets the smallest document that starts it.  Words under a window that also starts in
a document with a smaller id are removed; windows are judged on the input.

Buckets and tasks are as many as the bytes of the texts ask for, so neither grows with the input.  Hot windows: a task
settles equal windows among its own documents first.  Only the smallest document's occurrence of a window leaves a chunk,
so a passage shared by a third of all documents costs its bucket one string for each chunk of the input.  Within that
document the one occurrence speaks for all: where the marks meet the text again, each place of a marked window follows.
Hot minimisers: a bucket of more than ``limit`` bytes is settled in parts, and what each part keeps of a window goes,
window by window, to buckets by the hash of the whole window; such rounds repeat until no bucket is too large.

Windows are compared by two 64-bit hashes over their words' 64-bit hashes (see ``words``).

Null texts have no words.  Rows that repeat a doc_id with the same text are alike and do not remove each other; doc_ids
with different texts should be distinct (else marks of one hold for the other, as far as it has words).  Rows without a
doc_id keep all words.  An empty table gives an empty result.  ``remove_repeats`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .shared import buffers, small_batches, stored, unused
from .words import hashes, mix, run_starts, spans

K, M = 13, 3
#: Bytes of text for one bucket and for one task, and the bytes of a bucket that are unpacked at once.
BUCKET_BYTES, TASK_BYTES, LIMIT = 4 << 20, 64 << 20, 64 << 20


def _windows(word: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window."""
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(k):
        w = word[starts + j]
        a *= np.uint64(0xD6E8FEB86659FD93)
        a += w
        b *= np.uint64(0xA0761D6478BD642F)
        b ^= w
    return mix(a), b


def _minimisers(word: np.ndarray, starts: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least hash of m words in each window."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    runs = np.zeros(len(word) - m + 1, np.uint64)
    for j in range(m):
        runs = runs * np.uint64(0x9FB21C651E98DF25) + word[j : len(word) - m + 1 + j]
    runs = mix(runs)
    width, span = k - m + 1, 1
    while span * 2 <= width:  # the minimum over a power of two of runs, then over two that overlap
        runs = np.minimum(runs[: len(runs) - span], runs[span:])
        span *= 2
    return np.minimum(runs[starts], runs[starts + width - span])


def _later(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a smaller document has the window too, whether this is the window's first occurrence in the smallest)."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # equal first hashes with different second ones: order these too
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    d, new = doc[order], np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(d)))) if len(d) else d
    later, first = np.empty(len(a), bool), np.zeros(len(a), bool)
    later[order] = d > least
    best = np.flatnonzero(d == least)
    if len(best):
        group = np.cumsum(new)[best]
        first[order[best[np.concatenate([[True], group[1:] != group[:-1]])]]] = True
    return later, first


def _marks(doc: np.ndarray, start: np.ndarray, bucket) -> list[tuple]:
    """Rows (bucket, document, starts of windows to remove)."""
    if not len(doc):
        return []
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<i4")
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return [(bucket, int(doc[i]), start[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(doc)], strict=True)]


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, m: int = M, limit: int = LIMIT) -> DataFrame:
    """(id, starts binary): word numbers (32-bit, little-endian) at which a window to remove starts; several rows a document.

    Of a window that a document holds more than once, one place at least is named; ``covered`` finds the others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    buckets = max(256, 4 * parts, total // BUCKET_BYTES)

    def chunk_rows(ids: list, flat: np.ndarray, offsets: np.ndarray, turn: int) -> list[tuple]:
        start, end, counts = spans(flat, offsets)
        word = hashes(flat, start, end, False)
        at = run_starts(counts, k)
        owner = np.repeat(np.arange(len(counts)), counts)[at]
        doc = np.array(ids, np.int64)[owner]
        first_word = np.concatenate([[0], np.cumsum(counts)])[owner]
        later, keep = _later(*_windows(word, at, k), doc)
        rows = [(-1 - (i + turn) % buckets, d, s) for i, (_, d, s) in enumerate(_marks(doc[later], (at - first_word)[later], -1))]
        least = _minimisers(word, at, k, m)
        sent = np.flatnonzero(keep)
        if len(sent):
            new = np.ones(len(sent), bool)
            new[1:] = (np.diff(sent) != 1) | (np.diff(at[sent]) != 1) | (owner[sent[1:]] != owner[sent[:-1]]) | (least[sent[1:]] != least[sent[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(sent)) - 1
            head, tail = sent[head], sent[tail]
            where = ((least[head] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            head, tail, where = head[order], tail[order], where[order]
            a, b = start[at[head]], end[at[tail] + k - 1]
            raw = flat.tobytes()
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            for i, j in zip(cuts, [*cuts[1:], len(where)], strict=True):
                strings = b"".join([raw[p:q] for p, q in zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)])
                rows.append((int(where[i]), None, blobs.packed([doc[head[i:j]], (at - first_word)[head[i:j]].astype("<i4"), (b[i:j] - a[i:j]).astype("<i4")], strings)))
        return rows

    def split(batches):
        for turn, (ids, flat, offsets) in enumerate(blobs.chunks(batches), 1):
            rows = chunk_rows(ids, flat, offsets, turn)
            for i in range(0, len(rows), 500):
                yield blobs.batch(rows[i : i + 500])
            del ids, flat, offsets, rows

    def bucket_rows(rows: list[tuple], whole: bool, turn: int) -> list[tuple]:
        docs_, firsts, sizes, strings = [], [], [], []
        for _, data in rows:
            (d, f, n), body = blobs.unpacked(data, ["<i8", "<i4", "<i4"])
            docs_.append(d), firsts.append(f), sizes.append(n), strings.append(body)
        d, f, n = (np.concatenate(x) for x in (docs_, firsts, sizes))
        raw = b"".join(strings)
        flat = np.frombuffer(raw, np.uint8)
        del strings
        start, end, counts = spans(flat, np.concatenate([[0], np.cumsum(n, dtype=np.int64)]))
        word = hashes(flat, start, end, False)
        at = run_starts(counts, k)
        owner = np.repeat(np.arange(len(counts)), counts)[at]
        doc = d[owner]
        a, b = _windows(word, at, k)
        later, keep = _later(a, b, doc)
        place = at - np.concatenate([[0], np.cumsum(counts)])[owner] + f[owner]
        out = _marks(doc[later], place[later], 0)
        if not whole and len(one := np.flatnonzero(keep)):
            # the windows of this part go on alone, to buckets 1, 2, ... by their own hash, another one each round
            where = (mix(b[one] + np.uint64(turn)) % np.uint64(buckets)).astype(np.int32) + 1
            order = np.argsort(where, kind="stable")
            one, where = one[order], where[order]
            x, y = start[at[one]], end[at[one] + k - 1]
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            for i, j in zip(cuts, [*cuts[1:], len(where)], strict=True):
                alone = b"".join([raw[p:q] for p, q in zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)])
                out.append((int(where[i]), None, blobs.packed([doc[one[i:j]], place[one[i:j]].astype("<i4"), (y[i:j] - x[i:j]).astype("<i4")], alone)))
        return out

    def settled_by(turn: int):
        def settle(batches):
            for bucket, rows, whole in blobs.by_bucket(batches, limit):
                out = [(0, i, data) for i, data in rows] if bucket < 0 else bucket_rows(rows, whole, turn)
                for i in range(0, len(out), 1000):
                    yield blobs.batch(out[i : i + 1000])
                del rows, out

        return settle

    left, turn, marks = known.mapInArrow(split, blobs.SCHEMA), 0, None
    while True:
        found = stored(left.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settled_by(turn), blobs.SCHEMA), "windows")
        here = found.where("bucket = 0").select(F.col("id").alias(id_col), F.col("data").alias("starts"))
        marks = here if marks is None else marks.unionByName(here)
        left, turn = found.where("bucket > 0"), turn + 1
        if left.isEmpty():
            return marks


def covered(text: bytes, starts: list[bytes], k: int = K) -> np.ndarray:
    """Which words of a text the windows cover, at every place where the text has them."""
    flat = np.frombuffer(text, np.uint8)
    start, end, counts = spans(flat, np.array([0, len(flat)]))
    places = run_starts(counts, k)  # of a single text: 0, 1, ...
    at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
    at = at[at < len(places)]
    if 0 < len(at) < len(places):
        a, b = _windows(hashes(flat, start, end, False), places, k)
        at = np.flatnonzero(np.isin(a, a[at]) & np.isin(b, b[at]))
    step = np.zeros(len(start) + 1, np.int64)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step)[:-1] > 0


def with_marks(docs: DataFrame, id_col: str, text: str, k: int, m: int) -> DataFrame:
    """The columns of docs and, last, a list of the starts that are marked; null without."""
    own, starts = unused(docs.columns, "_id", "_starts")
    marks = removed_windows(docs, id_col, text, k, m).groupBy(F.col(id_col).alias(own)).agg(F.collect_list("starts").alias(starts))
    return docs.join(marks, docs[f"`{id_col}`"] == marks[own], "left").select(*[docs[f"`{c}`"] for c in docs.columns], marks[starts])


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space)."""

    def run(batches):
        for batch in batches:
            flat, off = buffers(batch.column(1))
            raw, out = flat.tobytes(), []
            for i, starts in enumerate(batch.column(2).to_pylist()):
                body = raw[off[i] : off[i + 1]]
                words = body.split()
                n = len(words)
                if starts:
                    words = [w for w, gone in zip(words, covered(body, starts, k).tolist(), strict=True) if not gone]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    rows = with_marks(docs.select(f"`{id_col}`", f"`{text}`"), id_col, text, k, m)
    return rows.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """docs with the repeated words taken out of the text; a text that loses words is its other words joined by one space, any other stays as it is."""
    schema = docs.schema
    at = schema.names.index(text)

    def run(batches):
        for batch in batches:
            bodies, out = batch.column(at).to_pylist(), []
            for body, starts in zip(bodies, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if starts:
                    data = body.encode()
                    body = b" ".join([w for w, gone in zip(data.split(), covered(data, starts, k).tolist(), strict=True) if not gone]).decode()
                out.append(body)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return with_marks(docs, id_col, text, k, m).mapInArrow(run, schema)
