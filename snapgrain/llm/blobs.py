"""Packed rows: what one task sends to one bucket travels as a few large binary values instead of many small rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import buffers, released

SCHEMA = "bucket int, id long, data binary"
ARROW = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("data", pa.binary())])


def batch(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def packed(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Arrays of one length and a byte string, compressed column by column."""
    raw = np.array([len(arrays[0])], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays) + tail
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    size = int(np.frombuffer(data, "<i8", 1)[0])
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, raw[at:]


#: Rows of a part of a bucket at least; a row is what one chunk of 8 MB of texts has for a bucket.
LEAST = 4


def size_of(data: bytes | None) -> int:
    """Bytes of a packed value before compression."""
    return int(np.frombuffer(data, "<i8", 1)[0]) if data else 0


def by_bucket(batches, limit: int):
    """(bucket, its rows' (id, data), whether these are all) from rows that are sorted by bucket; a bucket of more than limit bytes comes in parts, of LEAST rows or more so that each can put rows together."""
    held, now, total, parts = [], None, 0, 0
    for b in batches:
        for bucket, i, data in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
            size = size_of(data) if bucket >= 0 else 0  # negative buckets are passed on as they are
            if held and (bucket != now or (total + size > limit and len(held) >= LEAST)):
                over = bucket == now
                yield now, held, not over and not parts
                held, total, parts = [], 0, parts + 1 if over else 0
            now = bucket
            held.append((i, data))
            total += size
    if held:
        yield now, held, not parts
        held = []
        released()


def chunks(batches, limit: int = 8 << 20):
    """(ids, bytes, offsets) of about limit bytes of text from batches of (id, text); a single longer text is a chunk of its own."""
    ids, flats, sizes, total = [], [], [], 0
    for b in batches:
        flat, off = buffers(b.column(1))
        ids += b.column(0).to_pylist()
        flats.append(flat)
        sizes.append(np.diff(off))
        total += len(flat)
        if total >= limit:
            yield ids, np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            ids, flats, sizes, total = [], [], [], 0
            released()
    if ids:
        yield ids, np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        ids, flats, sizes = [], [], []
        released()
