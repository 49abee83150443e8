"""Ranks, percentiles, quantiles and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import running


def percentile_within(df: DataFrame, snapshot: list[str], value: str, out: str = "pct") -> DataFrame:
    """100 * (values below) / max(n - 1, 1) within a snapshot."""
    return df.withColumn(out, 100 * F.percent_rank().over(Window.partitionBy(*snapshot).orderBy(value)))


def unpivoted(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def rank_quartile(df: DataFrame, by: list[str], value: str, ordinal: str, out: str = "band") -> DataFrame:
    """Four bands of equal count with edges floor(i * n / 4); ties keep the ordinal's order."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(value, ordinal))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(out, F.least(F.lit(3), F.floor((4 * rn - 1) / n)).cast("int"))


def rank_quartile_of_all(df: DataFrame, value: str, *ordinals: str, out: str = "band") -> DataFrame:
    """``rank_quartile`` over all rows: places from running counts of the distinct values and a place among equal ones, so no task sorts them all."""
    h = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    h = running(h, [], value, {"_to": "_c"})
    n = df.sparkSession.createDataFrame([(df.count(), 1)], "_n long, _one int")
    place = F.row_number().over(Window.partitionBy(value).orderBy(*ordinals))
    d = df.withColumn("_rn", place).join(h, value).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    rn = F.col("_to") - F.col("_c") + F.col("_rn")
    return d.withColumn(out, F.least(F.lit(3), F.floor((4 * rn - 1) / F.col("_n"))).cast("int")).drop("_rn", "_to", "_c", "_one", "_n")


# Upper edges of the absolute size bands.
BAND_EDGES = (22, 48, 108)


def absolute_band(value: Column, edges=BAND_EDGES) -> Column:
    """0 to len(edges), edges inclusive below."""
    band = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        band = F.when(value <= edges[i], i).otherwise(band)
    return band


def quantile_nearest(df: DataFrame, by: list[str], value: str, f: float, out: str) -> DataFrame:
    """by, out: the value at index round-half-even(f * (n - 1)) of each group's sorted values, from counts of distinct values."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    h = h.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    return h.where(F.col("_to") > F.bround(f * (F.col("_n") - 1))).groupBy(*by).agg(F.min("_v").alias(out))


def quantile_linear(value: str, f: float) -> Column:
    return F.percentile(value, F.lit(f))


def first_per(df: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def box_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the extreme values within 1.5 interquartile ranges."""
    q = df.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.median(value).alias("q2"), F.percentile(value, F.lit(0.75)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return df.join(q, by).groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))
