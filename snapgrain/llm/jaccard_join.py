"""Exact n-gram Jaccard join in the metric space of shingle sets (d = 1 - Jaccard is a metric).

Two documents link when 100 * intersection >= 75 * union, that is d <= 0.25 =: e.

Level 0.  Between unrelated texts d is 1 and tells nothing, so the first pivots are the one-shingle sets {s}: d(x, {s}) < 1
only where x has s, and all of x's own pivots are equally near.  A fixed order of the shingles, rarest first, breaks the
tie and so names x's Voronoi region; sets within e of each other miss at most a quarter of each other's shingles, hence
x is replicated into the regions of its floor(n / 4) + 1 first shingles, and two that link meet in the region of their
first common shingle.  There the sizes and places bound what they can share, which drops most pairs.  The order comes
from a count sketch of fixed size over all shingles of all documents; any order gives the same links, a good one gives
small regions.

In every region the member with the smallest id is its first pivot: the others are measured against it.  Deeper levels
take what those links leave in more than one component: the other pairs of regions of up to ``small`` documents, and the
larger regions, those with the same smallest member made one.

Deeper levels.  A region with more than ``small`` documents elects documents as pivots and measures all its members
against them.  A member within e of a pivot links to it, so members of one ball are one component and need no further
comparison.  Every member belongs to the cell of its nearest pivot p, and is replicated into the cell of each pivot q with
d(x, q) <= d(x, p) + 2e: if y in q's cell is within e of x, then d(x, q) <= d(y, q) + e <= d(y, p) + e <= d(x, p) + 2e.
Cells whose members are all in one component are done; the others are regions again.  What has ``divide`` members or
fewer, what pivots do not divide and what is left after ``levels`` levels is compared exactly, in blocks of bounded size, by members of different components only.

Buckets and tasks of level 0 are as many as the number of replicas asks for.  A bucket that is still too large, as a hot
shingle's is, is met in parts: every region in it counts as a large one, so all its members meet at the deeper levels.
Components are contracted anew only where a level's links join them.

Shingles are compared by 64-bit hashes (see ``words``).  A document without words has an empty set and links with nothing.
Null texts have no words.  Rows that repeat a doc_id should repeat its text; they count as one document in links and each
get their row.  A row without a doc_id has no component and, in ``one_of_each``, stays.  An empty table gives an empty
result.  Other columns are left out by ``link_components`` and kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .components import components, extended
from .shared import buffers, settled, shared_dir, small_batches, stored, unused
from .words import shingles

#: Counters of the sketch that orders the shingles: 2 MB, whatever the input's size.
SKETCH = 1 << 19
SMALL, LEVELS, PIVOTS, BLOCK = 8, 3, 8, 64
#: Members up to which a region's pairs are tried by their sizes and places, all at once; larger regions keep all members.
PRUNE = 4096
#: Members up to which a region is compared without dividing it.
DIVIDE = 256
#: Members that meet a pivot in one task, at least.
SHARE = 128
#: Replicas (24 bytes each) for one bucket and for one task, and the bytes of a bucket that are unpacked at once.
BUCKET_ROWS, TASK_ROWS, LIMIT = 250_000, 2_000_000, 64 << 20
#: Routes (24 bytes each) that may be broadcast to the documents; with more of them, the join is shuffled.
BROADCAST_ROUTES = 400_000


def _sizes_and_sketch(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n) of every document, and the counts of all shingles by their low bits."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for ids, flat, offsets in blobs.chunks(batches):
            sets = shingles(flat, offsets, k)
            low = np.concatenate(sets) & np.uint64(SKETCH - 1)
            counts += np.bincount(low.astype(np.int64), minlength=SKETCH).astype(np.uint32)
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.binary())], names=["id", "n", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["id", "n", "counts"])

    rows = stored(docs.mapInArrow(run, "id long, n long, counts binary"), "sizes")
    parts = rows.where("n = -1").select("counts").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.uint32))
    return rows.where("n >= 0").select("id", "n"), parts.treeReduce(np.add) if not rows.isEmpty() else np.zeros(SKETCH, np.uint32)


def _regions(docs: DataFrame, k: int, rarity, buckets: int) -> DataFrame:
    """Packed (shingle, id, size, place) of every document's replicas at level 0."""

    def run(batches):
        count = rarity.value.astype(np.uint64)
        for ids, flat, offsets in blobs.chunks(batches):
            key, doc, size, place = [], [], [], []
            for i, s in zip(ids, shingles(flat, offsets, k), strict=True):
                n = len(s)
                if n:
                    first = (count[(s & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(34)) | (s >> np.uint64(30))
                    order = np.argsort(first, kind="stable")[: n // 4 + 1]
                    key.append(s[order]), place.append(np.arange(len(order), dtype=np.int32))
                    doc.append(np.full(len(order), i, np.int64)), size.append(np.full(len(order), n, np.int32))
            if not key:
                continue
            key, doc, size, place = (np.concatenate(x) for x in (key, doc, size, place))
            where = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            key, doc, size, place, where = key[order], doc[order], size[order], place[order], where[order]
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            rows = [(int(where[a]), None, blobs.packed([key[a:b], doc[a:b], size[a:b], place[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True)]
            for a in range(0, len(rows), 500):
                yield blobs.batch(rows[a : a + 500])

    return docs.mapInArrow(run, blobs.SCHEMA)


def _possible(nx, px, ny, py):
    """Whether sets of sizes nx, ny whose first common shingle is at places px, py can link."""
    least, most = np.minimum(nx, ny), np.maximum(nx, ny)
    share = np.minimum(nx - px, ny - py)
    return (4 * least >= 3 * most) & (7 * share >= 3 * (nx + ny))


def _meet(regions: DataFrame, parts: int, small: int, limit: int = LIMIT) -> DataFrame:
    """What the regions of level 0 ask for, by kind: 0 pairs (a, b) of a member and the region's smallest id, its pivot; 1 other pairs of small regions; 2 members a of large regions."""

    def run(batches):
        for _, rows, whole in blobs.by_bucket(batches, limit):
            cols = [blobs.unpacked(data, ["<u8", "<i8", "<i4", "<i4"])[0] for _, data in rows]
            del rows
            key, doc, size, place = (np.concatenate(x) for x in zip(*cols, strict=True))
            del cols
            order = np.lexsort((doc, key))
            key, doc, size, place = key[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            g = np.diff(np.append(head, len(key)))

            def possible(x, y, doc=doc, size=size, place=place):
                ok = _possible(size[x], place[x], size[y], place[y]) & (doc[x] != doc[y])
                return np.stack([doc[y[ok]], doc[x[ok]]], 1)

            pairs = [possible(np.repeat(head, g), np.arange(len(key)))]
            least = small if whole else 0  # the other members of a region in a part of a bucket may be in another part
            others = [possible(at + i, at + j) for n in range(3, least + 1) if len(at := head[g == n]) for i, j in combinations(range(1, n), 2)]
            for kind, found in ((0, pairs), (1, others)):
                if found and len(found := np.unique(np.concatenate(found), axis=0)):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["kind", "region", "a", "b"])
            large = np.repeat(g > least, g)
            for a in np.flatnonzero((g > least) & (g <= PRUNE)) if whole else ():  # a member that can link to no other one there leaves the region
                at = np.arange(head[a], head[a] + g[a])
                x, y = at[:, None], at[None, :]
                large[at] = (_possible(size[x], place[x], size[y], place[y]) & (doc[x] != doc[y])).any(1)
            if large.any():
                n = int(large.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.array(key[large].view(np.int64)), pa.array(doc[large]), pa.nulls(n, pa.int64())], names=["kind", "region", "a", "b"])

    return regions.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, region long, a long, b long")


def _sent(docs: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(target, share, turn, label, id, set): every document's set, once for each of its routes (id, target, share, turn, label)."""
    listed = stored(routes.groupBy("id").agg(F.collect_list(F.struct("target", "share", "turn", "label")).alias("routes")), "routes")
    few = routes.count() <= BROADCAST_ROUTES
    met = docs.join(F.broadcast(listed) if few else listed, "id").select("id", "text", "routes")

    def run(batches):
        for batch in batches:
            ids, routes_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = [(r["target"], r["share"], r["turn"], r["label"], i, s.tobytes()) for i, rs, s in zip(ids, routes_, shingles(*buffers(batch.column(1)), k), strict=True) for r in rs]
            for at in range(0, len(rows), 1000):
                columns = list(zip(*rows[at : at + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)

    return met.mapInArrow(run, "target long, share int, turn int, label long, id long, set binary")


NAMES = ["target", "share", "turn", "label", "id", "set"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _verified(docs: DataFrame, pairs: DataFrame, parts: int, k: int) -> DataFrame:
    """pairs (a, b) with the sizes of their intersection and union.

    The sets of all a of one b meet the set of b.  A b with many a is dealt in shares of SHARE or the root of their number, and its set goes to each share.
    """
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    if not n:
        return pairs.select("a", "b", F.lit(0).cast("long").alias("both"), F.lit(1).cast("long").alias("any"))
    shares = settled(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(SHARE), F.sqrt(F.count(F.lit(1))))).cast("int").alias("shares")), n)
    none = F.lit(None).cast("long").alias("label")
    routes = pairs.join(shares, "b").select(F.col("a").alias("id"), F.col("b").alias("target"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("turn"), none)
    own = shares.select(F.col("b").alias("id"), F.col("b").alias("target"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("turn"), none)
    sent = _sent(docs, settled(routes.unionByName(own), 2 * n), k).drop("label")

    def run(batches):
        now, own = None, None
        for batch in batches:
            out = []
            for target, share, turn, i, data in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if turn == 0:
                    now, own = (target, share), s
                elif now == (target, share):
                    both = len(np.intersect1d(own, s, True))
                    out.append((i, target, both, len(own) + len(s) - both))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "both", "any"])

    dealt = sent.repartition(parts, "target", "share").sortWithinPartitions("target", "share", "turn")
    return stored(dealt.mapInArrow(run, "a long, b long, both long, any long"), "verified")


LINK = "100 * both >= 75 * any"


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """(region, a, component, size): members (region, a) of the regions that are not yet one component."""
    n = members.count()
    rows = settled(members.join(label, "a", "left").select("region", "a", F.coalesce("component", "a").alias("component")), n)
    mixed = settled(rows.groupBy("region").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("size")).where("_low <> _high").select("region", "size"), n)
    return settled(rows.join(mixed, "region"), n)


def _merged(members: DataFrame) -> DataFrame:
    """(region, a) of regions with the same smallest member made one: a group of near copies meets in the region of each of its common shingles, and needs to be compared once."""
    low = settled(members.groupBy("region").agg(F.min("a").alias("b")), members.count())
    return members.join(low, "region").select(F.col("b").alias("region"), "a").distinct()


def _divide(docs: DataFrame, members: DataFrame, level: int, pivots: int, parts: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to pivots, members of the cells, members of regions that pivots do not divide): one level of the recursion."""
    n = members.count()
    order = F.struct(F.xxhash64("a", F.lit(level)).alias("p"), F.col("a").alias("pivot"))
    chosen = settled(members.groupBy("region", F.pmod(F.xxhash64("a"), F.lit(pivots)).alias("_slot")).agg(F.min(order).alias("_p")).select("region", F.col("_p.pivot").alias("pivot")), n)
    met = settled(members.select("region", "a").join(chosen, "region").where("a <> pivot"), n * pivots)
    measured = _verified(docs, met.select("a", F.col("pivot").alias("b")).distinct(), parts, k)
    links = measured.where(LINK).select("a", "b")
    near = met.join(measured.select("a", F.col("b").alias("pivot"), (1 - F.col("both") / F.col("any")).alias("d")), ["a", "pivot"])
    # pivots have been compared with every member of their region and leave it
    near = settled(near.join(chosen.withColumnRenamed("pivot", "a"), ["region", "a"], "left_anti"), n * pivots)
    least = settled(near.groupBy("region", "a").agg(F.min("d").alias("_d")), n)
    cells = near.join(least, ["region", "a"]).where("d <= _d + 0.5 + 1e-9").select(F.col("region").alias("of"), F.xxhash64("region", "pivot").alias("region"), "a", (F.col("d") <= F.col("_d")).alias("home"))
    cells = settled(cells, n * pivots)
    # a region whose members are about as far from all pivots falls into cells that are as large as itself: it stays whole
    wide = settled(cells.groupBy("of").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("home").alias("_homes")).where("2 * _rows > 3 * _homes").select("of"), n)
    whole = near.select(F.col("region").alias("of"), "a").distinct().join(wide, "of", "left_semi").select(F.col("of").alias("region"), "a")
    cells = cells.join(wide, "of", "left_anti")
    owned = settled(cells.where("home").select("region").distinct(), n)
    return links, settled(cells.select("region", "a").join(owned, "region", "left_semi").distinct(), n * pivots), settled(whole, n)


def _compared(docs: DataFrame, members: DataFrame, parts: int, k: int) -> DataFrame:
    """Links among members of one region and different components, block by block; a pair of blocks gives a spanning forest of its links."""

    def forest(held):
        parent = {label: label for _, label, _, _ in held}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (a, la, x, sa), (b, lb, y, sb) in combinations(held, 2):
            if (sa == 0 or sa != sb) and top(la) != top(lb) and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(np.intersect1d(x, y, True))
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    parent[top(la)] = top(lb)
                    yield a, b

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for target, _, side, label, i, data in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if target != now:
                    out += forest(held)
                    now, held = target, []
                held.append((i, label, np.frombuffer(data, np.uint64), side))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])
        columns = list(zip(*forest(held), strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("a"), F.col("_blocks")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    target = F.xxhash64("region", F.least("_own", "_other"), F.greatest("_own", "_other"))
    routes = dealt.select(F.col("a").alias("id"), target.alias("target"), F.lit(0).alias("share"), side.alias("turn"), F.col("component").alias("label")).checkpoint()
    sent = _sent(docs, routes, k).repartition(parts, "target").sortWithinPartitions("target", "turn")
    return stored(sent.mapInArrow(run, "a long, b long"), "compared")


def deeper(known: DataFrame, members: DataFrame, label: DataFrame, k: int = 5, levels: int = LEVELS, pivots: int = PIVOTS, divide: int = DIVIDE) -> DataFrame:
    """label (a, component) with all links among members (region, a) of one region: large regions are divided by pivots, level by level, what is left is compared in blocks."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _merged(_mixed(members, label))
    whole = members.limit(0)
    for level in range(levels):
        members = _mixed(members, label)
        if members.isEmpty():
            break
        whole = whole.unionByName(members.where(F.col("size") <= divide).select("region", "a"))
        members = members.where(F.col("size") > divide)
        if members.isEmpty():
            break
        found, members, kept = _divide(known, members, level, pivots, parts, k)
        label, whole = extended(label, found), whole.unionByName(kept)
    rest = _mixed(members.select("region", "a").unionByName(whole), label)
    return label if rest.isEmpty() else extended(label, _compared(known, rest, parts, k))


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, small: int = SMALL, levels: int = LEVELS, pivots: int = PIVOTS, divide: int = DIVIDE, limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_shingles, component_id."""
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sizes, counts = _sizes_and_sketch(rows, k)
    replicas = sizes.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    tasks = max(parts, replicas // TASK_ROWS)
    buckets = max(256, 4 * tasks, replicas // BUCKET_ROWS)
    rarity = spark.sparkContext.broadcast(counts)
    known = rows.where("id is not null")
    met = stored(_meet(_regions(known, k, rarity, buckets), tasks, small, limit), "met")
    first = _verified(known, met.where("kind = 0").select("a", "b").distinct(), parts, k)
    label = components(first.where(LINK).select("a", "b")).select(F.col("node").alias("a"), "component").checkpoint()
    # a set that equals its pivot's is one point with it: they share all regions, so the pivot stands for both from here on
    same = stored(first.where("both = any").select("a").distinct(), "same")
    other = met.where("kind = 1").select("a", "b").distinct().join(same, "a", "left_anti").join(same.withColumnRenamed("a", "b"), "b", "left_anti").join(label, "a", "left").withColumnRenamed("component", "_ca")
    other = other.join(label.select(F.col("a").alias("b"), F.col("component").alias("_cb")), "b", "left").where("coalesce(_ca, a) <> coalesce(_cb, b)").select("a", "b")
    label = extended(label, _verified(known, other, parts, k).where(LINK))
    members = met.where("kind = 2").select("region", "a").distinct().join(same, "a", "left_anti")
    label = deeper(known, members, label, k, levels, pivots, divide)
    out = sizes.join(label.withColumnRenamed("a", "node"), sizes["id"] == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns; those without an id stay."""
    (other,) = unused(docs.columns, "_other")
    heads = link_components(docs, id_col, text, **how).where(f"`{id_col}` <> component_id").select(F.col(f"`{id_col}`").alias(other)).distinct()
    return docs.join(heads, docs[f"`{id_col}`"] == heads[other], "left_anti")
