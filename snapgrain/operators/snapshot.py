"""Snapshots of a panel: rows of one revision, discovered signals, dates, releases, and events resolved to pairs of revisions.

A panel has a row for each (sha, path); further key columns such as a repository may be named.  Small dimensions (revisions,
releases, event pairs) are joined to it; nothing loops over revisions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes of signal columns, and formatting signals that are left out.
SIGNAL_PREFIXES = ("struct_", "def_", "state_", "arch_", "bitwise_ops", "llm_", "ml_", "dl_")
FORMATTING = ("struct_tabs", "struct_spaces", "struct_linear")


def signal_columns(df: DataFrame, prefixes=SIGNAL_PREFIXES, leave=FORMATTING) -> list[str]:
    """The signals that a panel has, found by the prefix of their name, in column order."""
    return [c for c in df.columns if c.startswith(tuple(prefixes)) and c not in leave]


def total(columns: list[str]) -> Column:
    """Sum of columns, null as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def rows_at(panel: DataFrame, shas: DataFrame, columns: list[str], sha: str = "sha") -> DataFrame:
    """(sha, path, columns) of the revisions in shas, which are few; a null measure stays null."""
    return panel.join(F.broadcast(shas.select(sha).distinct()), sha).select(sha, "path", *columns)


def structural(panel: DataFrame, risks: list[str], loc: str = "loc", sha: str = "sha") -> DataFrame:
    """(sha, path, structural, loc): the sum of the risk columns, null as 0."""
    return panel.select(sha, "path", total(risks).alias("structural"), F.coalesce(F.col(loc), F.lit(0)).alias("loc"))


def measures_or_zero(panel: DataFrame, measures: list[str], sha: str = "sha") -> DataFrame:
    return panel.select(sha, "path", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def dated(shas: DataFrame, registry: DataFrame, log: DataFrame) -> DataFrame:
    """shas (sha) with the registry's date (sha, date), else the log's; null where neither has the revision."""
    r, g = registry.select("sha", F.col("date").alias("_r")), log.select("sha", F.col("date").alias("_g"))
    return shas.join(F.broadcast(r), "sha", "left").join(F.broadcast(g), "sha", "left").withColumn("date", F.coalesce("_r", "_g")).drop("_r", "_g")


def every_nth(revisions: DataFrame, order: str, n: int) -> DataFrame:
    """Every n-th revision from the first on, and the last one; idx counts those kept from 0.  A list of revisions is a small table."""
    w = Window.orderBy(order)
    d = revisions.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_last", F.lead(order).over(w).isNull())
    return d.where((F.col("_rn") % n == 0) | F.col("_last")).withColumn("idx", F.row_number().over(w) - 1).drop("_rn", "_last")


def release_panel(panel: DataFrame, walk: DataFrame, language: str, columns: list[str]) -> DataFrame:
    """(idx, path, columns) of the releases in walk (idx, sha), files of one language, in one scan."""
    return panel.where(F.col("language") == language).join(F.broadcast(walk.select("idx", "sha")), "sha").select("idx", "path", *columns)


def resolved(events: DataFrame, parents: DataFrame) -> DataFrame:
    """events (sha) with the first parent of their commit from parents (sha, parent, ord); root commits have none and are left out."""
    first = parents.groupBy("sha").agg(F.min_by("parent", "ord").alias("parent"))
    return events.join(first, "sha").where("parent is not null")


def touched(change: DataFrame, panel: DataFrame) -> DataFrame:
    """change (parent, sha, old_path, new_path, status) rows that were touched, with in_child, in_parent: both for a measured change, the parent alone for a positive."""
    child = panel.select("sha", F.col("path").alias("new_path"), F.lit(True).alias("in_child"))
    parent = panel.select(F.col("sha").alias("parent"), F.col("path").alias("old_path"), F.lit(True).alias("in_parent"))
    d = change.where("status = 'touched'").join(child, ["sha", "new_path"], "left").join(parent, ["parent", "old_path"], "left")
    return d.select("parent", "sha", "old_path", "new_path", F.coalesce("in_child", F.lit(False)).alias("in_child"), F.coalesce("in_parent", F.lit(False)).alias("in_parent"))


def first_present(change: DataFrame, panel_paths: DataFrame) -> DataFrame:
    """(sha, path): of an event's touched paths the first one that the panel has, new paths before old ones, each in order."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("new_path").alias("path")), F.struct(F.lit(1).alias("side"), F.col("old_path").alias("path")))
    named = change.where("status = 'touched'").select("sha", F.inline(sides)).where("path is not null")
    hit = named.join(panel_paths.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("sha").agg(F.min(F.struct("side", "path")).alias("_f")).select("sha", F.col("_f.path").alias("path"))


def event_status(events: DataFrame, change: DataFrame, parents: DataFrame, usable: Column) -> DataFrame:
    """(sha, status, n_files, n_left_out): no_parent, usable where one changed file is, else bystander_only; with the files left out."""
    kept = change.groupBy("sha").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~usable).alias("n_left_out"))
    d = events.select("sha").join(parents.select("sha", "parent"), "sha", "left").join(kept, "sha", "left")
    n, out = F.coalesce("n_files", F.lit(0)), F.coalesce("n_left_out", F.lit(0))
    status = F.when(F.col("parent").isNull(), "no_parent").when(n > out, "usable").otherwise("bystander_only")
    return d.select("sha", status.alias("status"), n.alias("n_files"), out.alias("n_left_out"))


def functions_of(functions: DataFrame, files: DataFrame) -> DataFrame:
    """function rows with their file's sha and path, by file_id."""
    return functions.join(files.select(F.col("id").alias("file_id"), "sha", "path"), "file_id")


def function_pairs(parent: DataFrame, child: DataFrame, key: list[str], values: list[str], rowid: str) -> DataFrame:
    """Functions of the parent with those of the child by name; of a name that repeats in the child the last row counts, null where it is gone."""
    last = child.groupBy(*key, "name").agg(*[F.max_by(v, rowid).alias(f"after_{v}") for v in values])
    return parent.select(*key, "name", *values).join(last, [*key, "name"], "left")
