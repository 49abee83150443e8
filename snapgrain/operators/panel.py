"""Trajectories of entities over ordered releases: runs, lookbacks, outcomes, as-of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, path: list[str], idx: str) -> DataFrame:
    """run_start and run_end of the unbroken run of releases that a row is in."""
    island = F.col(idx) - F.row_number().over(Window.partitionBy(*path).orderBy(idx))
    d = df.withColumn("_island", island)
    w = Window.partitionBy(*path, "_island")
    return d.withColumn("run_start", F.min(idx).over(w)).withColumn("run_end", F.max(idx).over(w)).drop("_island")


def lookback(df: DataFrame, path: list[str], idx: str, value: str, width: int = 8) -> DataFrame:
    """For rows with width releases in their run: slope over them, changes that are not 0, and the deviation of changes."""
    w = Window.partitionBy(*path, "run_start").orderBy(idx)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    frame, diffs = w.rowsBetween(-(width - 1), 0), w.rowsBetween(-(width - 2), 0)
    d = d.withColumn("slope", F.regr_slope(value, idx).over(frame)).withColumn("n_moves", F.sum((F.col("_d") != 0).cast("int")).over(diffs)).withColumn("sd_moves", F.stddev_pop("_d").over(diffs))
    return d.where(F.col(idx) - F.col("run_start") >= width - 1).drop("_d")


def growth_ratio(df: DataFrame, path: list[str], idx: str, top: str, bottom: str, back: int = 8) -> DataFrame:
    """Cumulative positive growth of two measures since the run's start, their ratio (denominator 1 at least) and its drift."""
    w = Window.partitionBy(*path, "run_start").orderBy(idx)
    d = df
    for c in (top, bottom):
        d = d.withColumn(f"grown_{c}", F.col(c) - F.lag(c).over(w))
        d = d.withColumn(f"grown_{c}", F.sum(F.greatest(F.coalesce(f"grown_{c}", F.lit(0)), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("ratio", F.col(f"grown_{top}") / F.greatest(F.col(f"grown_{bottom}"), F.lit(1)))
    return d.withColumn("drift", F.col("ratio") - F.lag("ratio", back).over(w))


def value_ahead(df: DataFrame, path: list[str], idx: str, value: str, ahead: int = 8) -> DataFrame:
    w = Window.partitionBy(*path, "run_start").orderBy(idx)
    return df.withColumn("ahead", F.when(F.col("run_end") >= F.col(idx) + ahead, F.lead(value, ahead).over(w)))


def next_gap(events: DataFrame, path: list[str], idx: str, tie: str, within: int = 12) -> DataFrame:
    """Gap to the entity's next event (null: censored) and whether another follows after 0 and within that many releases."""
    w = Window.partitionBy(*path).orderBy(idx, tie)
    r = Window.partitionBy(*path).orderBy(idx).rangeBetween(1, within)
    return events.withColumn("gap", F.lead(idx).over(w) - F.col(idx)).withColumn("again", F.count(F.lit(1)).over(r) > 0)


def asof_forward(events: DataFrame, releases: DataFrame, date: str, release_date: str, idx: str) -> DataFrame:
    """The first release at or after each event's date, by one sorted pass over the union; null after the last."""
    cols = events.columns
    u = events.withColumn("_rel", F.lit(None).cast(releases.schema[idx].dataType)).withColumn("_at", F.col(date)).unionByName(releases.select(F.col(release_date).alias("_at"), F.col(idx).alias("_rel")), allowMissingColumns=True)
    # releases are few and dates repeat: first reduce to distinct dates, so that the window has a row for each date only
    dates = u.groupBy("_at").agg(F.min("_rel").alias("_rel"))
    w = Window.orderBy("_at").rowsBetween(0, Window.unboundedFollowing)
    dates = dates.withColumn(idx, F.min("_rel").over(w)).drop("_rel")
    return events.join(dates, events[date] == dates["_at"], "left").select(*[events[c] for c in cols], idx)


def outcome_ahead(panel: DataFrame, events: DataFrame, path: list[str], idx: str, ahead: int = 4) -> DataFrame:
    """Whether the entity has an event in (idx, idx + ahead]: events spread over the releases before them, then an equi-join."""
    hit = events.select(*path, F.explode(F.sequence(F.col(idx) - ahead, F.col(idx) - 1)).alias(idx)).distinct().withColumn("_hit", F.lit(True))
    return panel.join(hit, [*path, idx], "left").withColumn("outcome", F.coalesce("_hit", F.lit(False))).drop("_hit")


def prior_count(df: DataFrame, path: list[str], order: str) -> DataFrame:
    """Events of the entity strictly earlier in evaluation order."""
    w = Window.partitionBy(*path).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("prior", F.count(F.lit(1)).over(w))
