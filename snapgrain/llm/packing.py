"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens (a longer document is cut so that its first piece may be short and
all others are full).  Pieces are dealt over partitions by a hash; each partition packs its own by best-fit decreasing
and compares its bin count with a lower bound: the largest of the rounded-up token sum and dual-feasible functions of the
sizes.  Where both agree the count is proven optimal and the partition is done.  A partition with a gap, or whose last
bins are not full, keeps its full bins and hands the pieces of the others to fewer partitions, which pack again; the
rounds end with one partition when what is left is small.  Only pieces of bins with free room move, so each round moves a
small part of the one before.  Where the pieces that are left no longer fit fewer tasks (their bins stay open round after
round, so there is nothing to gain), the round closes them as they are, with a gap that no bound certifies.

Null texts count as empty: one piece with the closing id only.  Rows that repeat a doc_id make pieces of their own; rows
without one make pieces with a null id.  An empty table gives an empty result.  Other columns of the input are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored, texts

#: Pieces that one task packs at once.
PER_TASK = 20_000
#: White space in one run from which a text goes to the tokenizer file's own library, as the pattern's look-ahead would backtrack too far.
LONG_SPACE = re.compile(r"(?<!\s)\s{50000}")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full ones but for the first."""
    first = length % capacity or min(length, capacity)
    out, at = [(0, first)], first
    while at < length:
        out.append((at, capacity))
        at += capacity
    return out


def dual_feasible(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins that sizes need: the sum, and for each of many thresholds k the function that rounds sizes above capacity - k up to a bin, keeps the middle and drops those under k, and the one that counts whole capacity / (k + 1) shares."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, capacity // 2 + 1, max(1, capacity // 128)):
        f = np.where(size > capacity - k, capacity, np.where(size < k, 0, size))
        best = max(best, -(-int((count * f).sum()) // capacity))
    for k in range(1, 20):
        scaled = size * (k + 1)
        f = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, free room of each bin) by best-fit decreasing.  A set of bit marks says which amounts of room some bin has."""
    where = np.empty(len(sizes), np.int64)
    room: list[int] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = marks >> s
        if fit:
            r = (fit & -fit).bit_length() - 1 + s
            b = having[r].pop()
            if not having[r]:
                marks &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        where[i] = b
        room[b] = left = r - s
        if left:
            having[left].append(b)
            marks |= 1 << left
    return where, np.array(room, np.int64)


def pack(pieces: DataFrame, capacity: int, length: str = "length", per_task: int = PER_TASK) -> DataFrame:
    """pieces (1 <= length <= capacity) with sequence_id and offset; the columns of pieces stay.  sequence_id holds the round, the partition in 22 bits and the bin in 36."""
    schema = pieces.schema
    names = schema.names
    at_length = names.index(length)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def packer(level: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches):
            from pyspark import TaskContext

            got = [b for b in batches if b.num_rows]
            if not got:
                return
            table = pa.Table.from_batches(got).combine_chunks()
            sizes = table.column(at_length).to_numpy().astype(np.int64)
            where, room = best_fit(sizes, capacity)
            certified = len(room) == dual_feasible(sizes, capacity)
            # a certified partition gives up no more than the one bin with the most room; a gap opens every bin with room
            open_bin = (room == room.max()) & (room > 0) if certified else room > 0
            if certified and open_bin.any():
                one = np.zeros(len(room), bool)
                one[int(np.argmax(room))] = True
                open_bin = one
            if last:
                open_bin[:] = False
            order = np.lexsort((np.arange(len(sizes)), where))
            sizes, where = sizes[order], where[order]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(where, np.arange(len(room)))
            offset = before - before[first[where]]
            task = TaskContext.get().partitionId()
            table = table.take(pa.array(order))
            table = table.append_column("sequence_id", pa.array(((level << 22 | task) << 36) + where, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from table.append_column("_open", pa.array(open_bin[where])).to_batches()

        return run

    out_schema = f"{kind}, sequence_id long, offset long, _open boolean"
    closed: list[DataFrame] = []
    left = pieces
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    level, parts = 0, 0
    while True:
        n, before = left.count(), parts
        # a quarter of the partitions each round, unless a task would then get far more than its share
        parts = max(1, n // per_task if level == 0 else max(n // (16 * per_task), min(n // per_task, parts // 4)))
        last = parts == 1 or (level > 0 and parts >= before)
        dealt = left.repartition(parts, F.pmod(spread + level * 7919, F.lit(parts * 64))) if parts > 1 else left.coalesce(1)
        done = stored(dealt.mapInArrow(packer(level, last), out_schema), f"pack{level}")
        closed.append(done.where("not _open").drop("_open"))
        left = done.where("_open").select(*names)
        if last:
            break
        level += 1
    result = closed[0]
    for c in closed[1:]:
        result = result.unionByName(c)
    return result


def pieces_of(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every document's ids and the closing id."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode = encoder()
        for batch in batches:
            out = []
            for i, body in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode(body), closing], "<u4")
                out += [(i, j, s, n, zlib.crc32(ids[s : s + n].tobytes())) for j, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


_held: dict = {}


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[], Callable[[str], list[int]]]:
    """An encoder by the ranks file, whose ids equal those of the tokenizer file, special tokens included, at a quarter of the time; texts with very long white space take the tokenizer file itself."""

    def make():
        if json_path not in _held:
            import base64
            import json

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(json_path, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

            def encode(body: str) -> list[int]:
                if not LONG_SPACE.search(body):
                    return e.encode(body, allowed_special="all")
                if ranks_path not in _held:
                    from tokenizers import Tokenizer

                    _held[ranks_path] = Tokenizer.from_file(json_path)
                return _held[ranks_path].encode(body, add_special_tokens=False).ids

            _held[json_path] = encode
        return _held[json_path]

    return make


def pack_documents(docs: DataFrame, encoder, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text: str = "text", per_task: int = PER_TASK) -> DataFrame:
    pieces = stored(pieces_of(docs, encoder, capacity, closing, id_col, text), "pieces")
    return pack(pieces, capacity, per_task=per_task)
