"""Rename-aware differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_delta(parent: DataFrame, child: DataFrame, change: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Full outer join of parent and child on the path, through renames.

    parent and child: key, path, metrics; change: key, old_path, new_path, status.  A child without its parent row is "added",
    a parent row that no child came from is "deleted", others have the change's status or "untouched".
    """
    c = child.join(change.withColumnRenamed("new_path", "path"), [*key, "path"], "left")
    c = c.withColumn("old", F.when(F.col("status") == "added", None).otherwise(F.coalesce("old_path", "path"))).select(*key, "path", "old", "status", *[F.col(m).alias(f"after_{m}") for m in metrics])
    p = parent.select(*key, F.col("path").alias("old"), *[F.col(m).alias(f"before_{m}") for m in metrics], F.lit(True).alias("_was"))
    j = c.withColumn("_is", F.lit(True)).join(p, [*key, "old"], "full_outer")
    status = F.when(F.col("_is").isNull(), "deleted").when(F.col("_was").isNull(), "added").otherwise(F.coalesce("status", F.lit("untouched")))
    delta = [(F.coalesce(f"after_{m}", F.lit(0)) - F.coalesce(f"before_{m}", F.lit(0))).alias(f"delta_{m}") for m in metrics]
    return j.select(*key, F.coalesce("path", "old").alias("path"), F.when(F.col("_was"), F.col("old")).alias("old"), status.alias("status"), *delta)


def event_means(deltas: DataFrame, event: list[str], value: str) -> DataFrame:
    """One observation for each event: the mean over its touched rows, and their signs."""
    v = F.col(value)
    return deltas.groupBy(*event).agg(F.avg(v).alias("mean_delta"), F.count_if(v < 0).alias("n_neg"), F.count_if(v > 0).alias("n_pos"), F.count_if(v == 0).alias("n_zero"))


def parity(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ between two panels: side, and the names of differing columns in order."""
    a = left.select(*key, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_r"))
    j = a.join(b, key, "full_outer")
    differing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), c) for c in columns])), ",")
    side = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").otherwise("both")
    out = j.select(*key, side.alias("side"), F.when(side == "both", differing).otherwise("").alias("columns"))
    return out.where("side <> 'both' OR columns <> ''")


def split_means(deltas: DataFrame, event: list[str], values: list[str]) -> DataFrame:
    """event, touched, n and the mean of each delta, for the files with both sides: added and deleted ones are skipped."""
    both = deltas.where("status IN ('touched', 'untouched')").withColumn("touched", F.col("status") == "touched")
    return both.groupBy(*event, "touched").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def pair_record(before: DataFrame, after: DataFrame, key: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """(key, record): one JSON object a file with before, after and delta of each column; a column that is null on either side is left out of the delta."""
    a = before.select(*key, F.struct(*[F.col(c) for c in columns]).alias("before"))
    b = after.select(*key, F.struct(*[F.col(c) for c in columns]).alias("after"))
    delta = F.struct(*[F.round(F.col(f"after.{c}") - F.col(f"before.{c}"), digits).alias(c) for c in columns])
    return a.join(b, key, "full_outer").select(*key, F.to_json(F.struct("before", "after", delta.alias("delta"))).alias("record"))
