"""Commit streams: windows before an anchor, files and churn of a commit, process features and their join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DOC_PREFIXES
from .entropy import cochange, entropy_bits


def under(path: Column, prefixes=DOC_PREFIXES) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | path.startswith(p)
    return hit


def window_before(commits: DataFrame, anchors: DataFrame, days: int = 365, cap: int = 4000) -> DataFrame:
    """(anchor, sha, at, age): the commits (sha, at) of the days before each anchor (anchor: date), the newest cap of them; what came at the anchor or later is never seen.

    Anchors are spread over the calendar years that their window touches, so the join has a key besides the range.
    """
    a = anchors.select("anchor", F.explode(F.sequence(F.year(F.date_sub("anchor", days)), F.year("anchor"))).alias("_y")).distinct()
    j = commits.withColumn("_y", F.year("at")).join(F.broadcast(a), "_y")
    j = j.withColumn("age", F.datediff("anchor", "at")).where((F.col("age") > 0) & (F.col("age") <= days)).drop("_y")
    rn = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("at"), "sha"))
    return j.withColumn("_rn", rn).where(F.col("_rn") <= cap).drop("_rn")


def numstat(files: DataFrame, commit: str = "sha", path: str = "path", extensions=(".c", ".h")) -> DataFrame:
    """(sha, files, churn) of the code files of each commit; documents and tests do not count, nor binary files, whose counts are null."""
    code = F.lit(False)
    for e in extensions:
        code = code | F.col(path).endswith(e)
    kept = files.where(code & ~under(F.col(path)) & F.col("added").isNotNull())
    return kept.groupBy(commit).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("added") + F.col("removed")).alias("churn"))


def process_features(touches: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """touches (anchor, sha, author, path) -> per (anchor, path): churn (commits), ownership entropy, scatter (partners) and change entropy of co-changes.

    Entropies are rounded to 6 digits; change entropy is 0 below two partners.
    """
    t = touches.distinct()
    churn = t.groupBy("anchor", "path").agg(F.count_distinct("sha").alias("churn"))
    own = entropy_bits(t.groupBy("anchor", "path", "author").agg(F.count_distinct("sha").alias("c")), ["anchor", "path"], "c").select("anchor", "path", F.abs(F.round("entropy", 6)).alias("ownership"))
    both = t.select(F.struct("anchor", "sha").alias("sha"), F.struct("anchor", "path").alias("path"))
    co = cochange(both, "sha", least, most).select("path.anchor", "path.path", F.col("partners").alias("scatter"), "change_entropy")
    return churn.join(own, ["anchor", "path"]).join(co, ["anchor", "path"], "left").withColumns({"scatter": F.coalesce("scatter", F.lit(0)), "change_entropy": F.coalesce("change_entropy", F.lit(0.0))})


def with_features(rows: DataFrame, features: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with the features of their key; a missing one counts as 0."""
    return rows.join(features.select(*key, *columns), key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def chronological(events: DataFrame, order: list[str], usable: Column) -> DataFrame:
    """The events with order_idx, their place by time counted over all of them, also those that are skipped later; then the usable ones.

    Ranks come from counts of each day and a place within it, so no window sees all events.
    """
    at, tie = order
    days = events.groupBy(F.to_date(at).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("_base", F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).drop("_n")
    d = events.withColumn("_day", F.to_date(at)).join(F.broadcast(days), "_day")
    place = F.row_number().over(Window.partitionBy("_day").orderBy(at, tie))
    return d.withColumn("order_idx", F.col("_base") + place - 1).where(usable).drop("_day", "_base")


def area(path: Column) -> Column:
    """The first two parts of a path, with a slash behind a folder (a part without a dot); a file at the top is its own area."""
    parts = F.split(path, "/")
    second = F.get(parts, F.lit(1))
    return F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.lit(0)), F.lit("/"), second, F.when(second.contains("."), "").otherwise("/"))).otherwise(path)


def is_test(path: Column) -> Column:
    return path.startswith("tests/")


def message_area(subject: Column) -> Column:
    """What stands before the first colon of a subject, in lower case: a colon among the first 24 characters, 2 to 16 characters without a space before it; else null."""
    text = F.trim(subject)
    head = F.lower(F.trim(F.substring_index(text, ":", 1)))
    return F.when(F.substring(text, 1, 24).contains(":") & ~head.contains(" ") & F.length(head).between(2, 16), head)
