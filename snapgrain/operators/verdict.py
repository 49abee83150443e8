"""Decision rules over tables of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_headline(bands: DataFrame, by: list[str], supported: str, clears: int = 3) -> DataFrame:
    """by, n_supported, n_bands, all_bands, any_band, clears (at least that many bands); a null verdict is no support."""
    s = F.coalesce(F.col(supported), F.lit(False))
    n = bands.groupBy(*by).agg(F.count_if(s).alias("n_supported"), F.count(F.lit(1)).alias("n_bands"))
    k = F.col("n_supported")
    return n.withColumn("all_bands", k == F.col("n_bands")).withColumn("any_band", k > 0).withColumn("clears", k >= clears)


def monotone_share(lifts: DataFrame, iteration: str, band: str, lift: str, n_bands: int = 4, least: float = 0.99) -> DataFrame:
    """(n_valid, share, supported): iterations whose lifts fall strictly from band to band; those with an undefined band do not count."""
    w = Window.partitionBy(iteration).orderBy(band)
    d = lifts.where(F.col(lift).isNotNull() & ~F.isnan(F.col(lift).cast("double"))).withColumn("_up", F.col(lift) >= F.lag(lift).over(w))
    i = d.groupBy(iteration).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_up").alias("_ups")).where(F.col("_n") == n_bands)
    s = i.agg(F.count(F.lit(1)).alias("n_valid"), F.avg((F.col("_ups") == 0).cast("double")).alias("share"))
    return s.withColumn("supported", F.coalesce(F.col("share") >= least, F.lit(False)))


def equivalent(df: DataFrame, p: str, low: str, high: str, delta: float, level: float = 0.01) -> DataFrame:
    """df with equivalent: no difference at the level, and the interval inside [-delta, delta], its bounds included; an undefined one is not equivalent."""
    return df.withColumn("equivalent", F.coalesce((F.col(p) >= level) & (F.col(low) >= -delta) & (F.col(high) <= delta), F.lit(False)))


def bonferroni(cells: DataFrame, positives: str, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """(n_powered, level): alpha over the number of cells with enough positives, which is fixed before resampling."""
    n = F.count_if(F.col(positives) >= least)
    return cells.agg(n.alias("n_powered"), F.when(n > 0, alpha / n).otherwise(alpha).alias("level"))


def frozen(df: DataFrame, by: list[str], value, still) -> DataFrame:
    """by, n, worst (the largest absolute value, 0 without any) and frozen: whether what must not move is 0 throughout.  Columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.abs(value)), F.lit(0)).alias("worst"), (F.coalesce(F.max(F.abs(still)), F.lit(0)) == 0).alias("frozen"))


def counted_sample(df: DataFrame, by: list[str], hit: str, ident: str, k: int) -> DataFrame:
    """by, n (rows with a hit) and sample: the k smallest distinct idents of them, joined by commas."""
    n = df.groupBy(*by).agg(F.count_if(hit).alias("n"))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(ident))
    some = df.where(hit).select(*by, ident).distinct().withColumn("_rn", rn).where(F.col("_rn") <= k)
    joined = some.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", ident))), lambda x: x[ident].cast("string")), ",").alias("sample"))
    return n.join(joined, by, "left").withColumn("sample", F.coalesce("sample", F.lit("")))
