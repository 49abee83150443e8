"""Overlap, nearest and prefix joins, each with an equality in its key.

The nearest joins give cases their sizes' neighbours by merging: cases and sizes grow with the input, and a small file of many
rows would be sent through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def touched_spans(spans: DataFrame, hunks: DataFrame, key: list[str]) -> DataFrame:
    """spans (start, length) with whether a hunk (lo, hi) of the same key touches [start, start + max(length, 1))."""
    s = spans.withColumn("_id", F.struct(*key, "start", "length"))
    hit = s.join(hunks, key).where((F.col("lo") < F.col("start") + F.greatest("length", F.lit(1))) & (F.col("hi") >= F.col("start"))).select("_id").distinct().withColumn("_hit", F.lit(True))
    return s.join(hit, "_id", "left").withColumn("touched", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")


def nearest_sibling(cases: DataFrame, pool: DataFrame, key: list[str], size: str, ident: str, low: float = 0.66, high: float = 1.5) -> DataFrame:
    """For each case the pool row of the same key with the nearest size within [low, high] times its own; ties go to the smaller ident, and no ident matches itself.

    The cases' sizes and the two smallest idents of each size of the pool meet in order of size, up and down, never as
    pairs: beside a size stand the nearest row and the nearest of another ident, one of which is not the case.
    """
    if not low <= 1 <= high:
        raise ValueError("the band must hold the size itself")
    a = cases.select(*key, F.col(ident).alias("case"), F.col(size).alias("_s"))
    b = pool.select(*key, F.col(size).alias("_s"), F.col(ident).alias("_i")).dropna(subset=[*key, "_s", "_i"])
    few = b.withColumn("_rn", F.dense_rank().over(Window.partitionBy(*key, "_s").orderBy("_i"))).where("_rn <= 2").drop("_rn").distinct()
    points = a.select(*key, "_s").dropna().distinct().withColumn("_i", F.lit(None).cast(b.schema["_i"].dataType))
    d = points.withColumn("_side", F.lit(0)).unionByName(few.withColumn("_side", F.lit(1)))
    for c, order in (("_down", F.asc("_s")), ("_up", F.desc("_s"))):
        # of a size the larger ident comes first and the point last, so the last row of the pool before the point is the nearest
        w = Window.partitionBy(*key).orderBy(order, F.desc("_side"), F.desc("_i"))
        d = d.withColumn(c, F.last(F.when(F.col("_side") == 1, F.struct("_s", "_i")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        other = F.when((F.col("_side") == 1) & (F.col(f"{c}._i") != F.col("_i")), F.col(c))
        d = d.withColumn(f"{c}2", F.last(other, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    j = a.join(d.where("_side = 0").drop("_side", "_i").hint("merge"), [*key, "_s"])

    def near(c):
        return F.when(_fits(F.col(f"{c}._s"), low, high) & (F.col(f"{c}._i") != F.col("case")), F.struct(F.abs(F.col(f"{c}._s") - F.col("_s")).alias("gap"), F.col(f"{c}._i").alias("match")))

    j = j.withColumn("_b", F.least(*[near(c) for c in ("_down", "_down2", "_up", "_up2")])).where("_b is not null")
    best = j.groupBy(*key, "case").agg(F.min("_b").alias("_b"))
    return best.select(*key, "case", F.col("_b.match").alias("match"), F.col("_b.gap").alias("gap"))


def prefix_join(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 7) -> DataFrame:
    """Rows of which one's hash is a prefix of the other's: equality on the first characters, then either direction."""
    j = left.join(right, F.substring(F.col(a), 1, least) == F.substring(F.col(b), 1, least))
    return j.where(F.col(a).startswith(F.col(b)) | F.col(b).startswith(F.col(a)))


def sorted_neighbours(cases: DataFrame, pool: DataFrame, key: list[str], size: str, ident: str, low: float = 0.66, high: float = 1.5, keep: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(key, case, match, gap, keep, carry): for each case the pool row of its key with the nearest size within [low, high] times its own, which may serve many cases.

    Of two as near the one above wins, of equal sizes above the smaller ident, below the larger.  keep names columns of the
    cases, carry of the pool, that come with their rows.
    """
    if not low <= 1 <= high:
        raise ValueError("the band must hold the size itself")
    a = cases.select(*key, F.col(ident).alias("case"), F.col(size).alias("_s"), *(keep or []))
    b = pool.select(*key, F.col(size).alias("_s"), F.struct(F.col(ident).alias("match"), *(carry or [])).alias("_i")).dropna(subset=[*key, "_s"])
    few = b.groupBy(*key, "_s").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))

    def near(c, after):
        return F.when(_fits(F.col(f"{c}._s"), low, high), F.struct(F.abs(F.col(f"{c}._s") - F.col("_s")).alias("gap"), F.lit(after).alias("after"), F.col(f"{c}._i").alias("_i")))

    points = _beside(a.select(*key, "_s").dropna().distinct(), few, key).withColumn("_b", F.least(near("_up", 0), near("_down", 1))).where("_b is not null").drop("_up", "_down")
    return a.join(points.hint("merge"), [*key, "_s"]).select(*key, "case", F.col("_b._i.match").alias("match"), F.col("_b.gap").alias("gap"), *(keep or []), *[F.col(f"_b._i.{c}").alias(c) for c in carry or []])


def _beside(points: DataFrame, pool: DataFrame, key: list[str]) -> DataFrame:
    """points (key, _s and more) with the pool's sizes beside their own: _up (_s, _i) at or above it with _lo as _i, _down below it with _hi.  pool: key, _s, _lo, _hi, a row for each size.

    Two running windows, one in order of size and one against it; a frame without an end would be gone through again for each row.
    """
    none = F.lit(None)
    both = points.withColumns({"_side": F.lit(0), "_lo": none.cast(pool.schema["_lo"].dataType), "_hi": none.cast(pool.schema["_hi"].dataType)})
    both = both.unionByName(pool.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    mine = lambda c: F.last(F.when(F.col("_side") == 1, F.struct("_s", F.col(c).alias("_i"))), True)
    # a point stands before the pool's row of its size
    w = lambda *order: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_down": mine("_hi").over(w(F.asc("_s"), F.asc("_side")))}).withColumns({"_up": mine("_lo").over(w(F.desc("_s"), F.desc("_side")))})
    return both.where("_side = 0").drop("_side", "_lo", "_hi")


def _fits(size, low: float, high: float):
    return (size >= low * F.col("_s")) & (size <= high * F.col("_s"))


def date_nearest(cases: DataFrame, pool: DataFrame, snapshot: str, date: str, size: str, ident: str, low: float = 0.66, high: float = 1.5, carry: list[str] | None = None) -> DataFrame:
    """(case, match, tier, day_gap, gap, carry): the nearest size within the band in the case's own snapshot (tier 0), else in the snapshot nearest by date (tier 1); unmatched cases are left out.

    Sizes are positive; carry names columns of the pool that come with its rows.  The distinct sizes of a snapshot meet in
    order of size, never as pairs.  A size without a match there finds its day from the least and largest size of each day
    in each step of the logarithm, of which the band spans two: a step reaches past one of the band's ends at most, so one
    of the two fits if any size of it does.  Then the sizes of that day meet as before.
    """
    if not 0 < low <= 1 <= high or low == high:
        raise ValueError("the band must hold the size itself")
    place = lambda c: F.floor(F.ln(c) / (math.log(high / low) / 2))
    a = cases.where(F.col(size) > 0).select(F.col(ident).alias("case"), F.col(snapshot).alias("_snap"), F.to_date(date).alias("_day"), F.col(size).alias("_s"))
    b = pool.where(F.col(size) > 0).select(F.struct(F.col(ident).isNull().alias("_none"), F.col(ident).alias("match"), *(carry or [])).alias("_i"), F.col(snapshot).alias("_snap"), F.to_date(date).alias("_at"), F.col(size).alias("_s"))
    few = lambda k: b.where(F.col(k).isNotNull()).groupBy(k, "_s").agg(F.min("_i").alias("_lo")).withColumn("_hi", F.col("_lo"))

    def near(c):
        return F.when(_fits(F.col(f"{c}._s"), low, high), F.struct(F.abs(F.col(f"{c}._s") - F.col("_s")).alias("gap"), F.col(f"{c}._i").alias("_i")))

    best = F.least(near("_up"), near("_down"))
    own = _beside(a.select("_snap", "_day", "_s").distinct(), few("_snap"), ["_snap"]).select("_snap", "_day", "_s", best.alias("_b"))
    left = own.where("_b is null")
    days = b.where("_at is not null").groupBy("_at", place(F.col("_s")).alias("_k")).agg(F.min("_s").alias("_least"), F.max("_s").alias("_most"))
    met = left.select("_day", "_s").distinct().withColumn("_k", F.explode(F.sequence(place(low * F.col("_s")), place(high * F.col("_s"))))).join(days, "_k")
    met = met.where(_fits(F.col("_least"), low, high) | _fits(F.col("_most"), low, high)).groupBy("_day", "_s").agg(F.min(F.abs(F.datediff("_day", "_at"))).alias("day_gap"))
    met = met.where("day_gap is not null").withColumn("_at", F.explode(F.array_distinct(F.array(F.date_sub("_day", F.col("day_gap")), F.date_add("_day", F.col("day_gap"))))))
    far = _beside(met, few("_at"), ["_at"]).groupBy("_day", "_s", "day_gap").agg(F.min(best).alias("_b"))
    found = own.where("_b is not null").select("_snap", "_day", "_s", F.lit(0).alias("tier"), F.lit(0).alias("day_gap"), "_b")
    found = found.unionByName(left.drop("_b").join(far, ["_day", "_s"]).withColumn("tier", F.lit(1)))
    j = a.alias("a").join(found.hint("merge").alias("f"), F.col("a._snap").eqNullSafe(F.col("f._snap")) & F.col("a._day").eqNullSafe(F.col("f._day")) & (F.col("a._s") == F.col("f._s")))
    g = j.groupBy("case").agg(F.min(F.struct("tier", "day_gap", F.col("_b.gap").alias("gap"), F.col("_b._i").alias("_i"))).alias("_b"))
    return g.select("case", F.col("_b._i.match").alias("match"), "_b.tier", "_b.day_gap", "_b.gap", *[F.col(f"_b._i.{c}").alias(c) for c in carry or []])


def greedy_controls(commits: DataFrame, key: list[str], order: list[str], event: str, width: int = 400) -> DataFrame:
    """(key, ident, control, cost): for each event commit in order the cheapest of the width - 1 commits before it that is no event, has files and was not taken before.

    Cost is 50 * |files| + |churn|; of equal costs the newest commit wins.  commits: key, order, ident, files, churn, event.
    Spark makes the pairs, by places in blocks of width, and sorts them; a task then streams a key's pairs and holds the
    controls taken so far.  Events without files get no control.
    """
    import pandas as pd

    c = commits.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    e = c.where(F.col(event) & (F.col("files") > 0)).select(*key, F.col("ident"), F.col("_at").alias("_e"), F.col("files").alias("_f"), F.col("churn").alias("_c"))
    e = e.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor((F.col("_e") - width + 1) / width), F.floor((F.col("_e") - 1) / width)))))
    p = c.where(~F.col(event) & (F.col("files") > 0)).select(*key, F.col("ident").alias("control"), "_at", "files", "churn", F.floor(F.col("_at") / width).alias("_block"))
    j = e.join(p, [*key, "_block"]).where((F.col("_at") < F.col("_e")) & (F.col("_at") > F.col("_e") - width))
    j = j.select(*key, "_e", "ident", (50 * F.abs(F.col("files") - F.col("_f")) + F.abs(F.col("churn") - F.col("_c"))).cast("long").alias("cost"), "_at", "control")

    def run(batches):
        now, taken, served = None, set(), None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                group, (place, ident, cost, _, control) = tuple(r[: len(key)]), r[len(key) :]
                if group != now:
                    now, taken, served = group, set(), None
                if place != served and control not in taken:
                    taken.add(control)
                    served = place
                    out.append((*group, ident, control, cost))
            yield pd.DataFrame(out, columns=[*key, "ident", "control", "cost"])

    kinds = ", ".join(f"{k} {commits.schema[k].dataType.simpleString()}" for k in key)
    kind = commits.schema["ident"].dataType.simpleString()
    return j.repartition(*key).sortWithinPartitions(*key, "_e", "cost", F.desc("_at")).mapInPandas(run, f"{kinds}, ident {kind}, control {kind}, cost long")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def dwell(first: DataFrame, second: DataFrame, ident: list[str], at: str, place: str) -> DataFrame:
    """(ident, gap): time from the first event of an ident to its second; of several on a side the one that stands last in the list counts."""
    last = lambda df, name: df.groupBy(*ident).agg(F.max_by(at, place).alias(name))
    return last(first, "_a").join(last(second, "_b"), ident).select(*ident, (F.col("_b") - F.col("_a")).alias("gap"))
