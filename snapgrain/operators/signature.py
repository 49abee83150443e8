"""Signatures of changes: flags on sums of signal deltas, rates and densities, prevalence, and what is listed of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import total


def signal_stats(deltas: DataFrame, event: list[str], signals: list[str]) -> DataFrame:
    """One row an event with mean_ and sum_ of each signal's delta, in one wide pass."""
    return deltas.groupBy(*event).agg(*[x for s in signals for x in (F.avg(s).alias(f"mean_{s}"), F.sum(s).alias(f"sum_{s}"))])


def flags(df: DataFrame, branch: Column, pointer: Column, alloc: Column, cast: Column) -> DataFrame:
    """On sums of deltas.  loose: branches or pointers rise; strict: both rise; fix_shaped: loose without new allocations or casts.  The three do not exclude each other."""
    loose = (branch > 0) | (pointer > 0)
    return df.withColumns({"loose": loose, "strict": (branch > 0) & (pointer > 0), "fix_shaped": loose & (alloc <= 0) & (cast <= 0)})


def patch_flags(df: DataFrame, net_branch: Column, net_pointer: Column, added_alloc: Column, added_cast: Column) -> DataFrame:
    """The same at the grain of a patch, where the veto of fix_shaped looks at what was added, not at the net."""
    loose = (net_branch > 0) | (net_pointer > 0)
    return df.withColumns({"loose": loose, "strict": (net_branch > 0) & (net_pointer > 0), "fix_shaped": loose & ~((added_alloc > 0) | (added_cast > 0))})


def guard_rate(guards: list[str], risks: list[str]) -> Column:
    """Guards for each risk; 1 in the denominator keeps it defined."""
    return total(guards) / (total(risks) + 1)


def density(columns: list[str], loc: str, strict: bool = True) -> Column:
    """Sum for each line: null without lines, or with strict=False over one line at least."""
    lines = F.col(loc)
    return F.when(lines > 0, total(columns) / lines) if strict else total(columns) / F.greatest(lines, F.lit(1))


def prevalence(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, n, and for each flag its count and share; a null flag does not hold."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x for c in names for x in (F.count_if(c).alias(f"n_{c}"), F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(f"share_{c}"))])


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, share): rows in which a column is not 0; a null counts as 0."""
    some = df.select([(F.coalesce(F.col(c), F.lit(0)) != 0).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    return some.unpivot(["n"], columns, "column", "share").select("column", "n", "share")


def redundancy(df: DataFrame, a: str, b: str, factor: float = 1000.0, tolerance: float = 1e-6) -> DataFrame:
    """(n, n_apart): rows in which a is not factor times b."""
    apart = F.abs(F.coalesce(F.col(a), F.lit(0)) - factor * F.coalesce(F.col(b), F.lit(0))) > tolerance
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(apart).alias("n_apart"))


def composition(df: DataFrame, group: str, attribute: str, least: float = 0.0) -> DataFrame:
    """(group, attribute, n, share, lift): the share of an attribute within a group against its share of all rows; shares under least are left out."""
    c = df.groupBy(group, attribute).agg(F.count(F.lit(1)).alias("n"))
    base = c.groupBy(attribute).agg(F.sum("n").alias("_b"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group))).join(F.broadcast(base), attribute)
    whole = c.sparkSession.createDataFrame([(df.count(),)], "_all long")
    c = c.join(F.broadcast(whole), F.col("_all") > 0)
    return c.where(F.col("share") >= least).select(group, attribute, "n", "share", (F.col("share") * F.col("_all") / F.col("_b")).alias("lift"))


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median and the share above 0 of the defined values."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.avg((v > 0).cast("double")).alias("share_up"))


def signal_gaps(df: DataFrame, signals: list[str], first: str, least: int = 20) -> DataFrame:
    """(signal, n_first, n_other, gap): the mean among rows of first minus that of the others; a signal with under least defined values on a side is left out."""
    side = F.col(first)
    long = df.unpivot([first], signals, "signal", "value").where("value is not null")
    g = long.groupBy("signal").agg(F.count_if(side).alias("n_first"), F.count_if(~side).alias("n_other"), (F.avg(F.when(side, F.col("value"))) - F.avg(F.when(~side, F.col("value")))).alias("gap"))
    return g.where((F.col("n_first") >= least) & (F.col("n_other") >= least))


def moving(df: DataFrame, signals: list[str], least: float = 0.03, most: int = 25) -> DataFrame:
    """(signal, share): signals that move (are not 0) in at least that share of the rows, the most active first; names break ties."""
    return coverage(df, signals).where(F.col("share") >= least).select(F.col("column").alias("signal"), "share").orderBy(F.desc("share"), "signal").limit(most)


def top(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows by an order that must be total."""
    return df.orderBy(*order).limit(k)


def argmax(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """(by, name, value) of the largest value; undefined ones come last, and the smaller name wins a tie."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), name))
    return df.withColumn("_rn", rank).where("_rn = 1").select(*by, name, value)


def net_markers(lines: DataFrame, ident: str, sign: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(ident, net_loc, net_<pattern>): lines (ident, sign 1 or -1, text) of a diff, and the marker words in them, added minus removed."""
    s = F.col(sign)
    return lines.groupBy(ident).agg(F.sum(s).alias("net_loc"), *[F.sum(s * F.regexp_count(F.col(text), F.lit(p))).alias(f"net_{k}") for k, p in patterns.items()])
