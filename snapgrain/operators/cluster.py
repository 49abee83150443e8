"""Groups of signals that move together."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals are columns chosen beforehand; more than this many are refused.
MOST = 200


def _rho(a: str, b: str) -> Column:
    """Correlation over rows with both; null where one is constant, for which Spark's corr divides by zero."""
    spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def correlations(df: DataFrame, signals: list[str]) -> DataFrame:
    """(a, b, rho) for each pair of signals, from one aggregate over the rows."""
    if len(signals) > MOST:
        raise ValueError(f"{len(signals)} signals, at most {MOST}")
    pairs = list(combinations(signals, 2))
    row = df.agg(*[_rho(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])))


def single_linkage(df: DataFrame, signals: list[str], least: float = 0.5) -> DataFrame:
    """(signal, cluster): signals joined by chains of |rho| >= least, named by the smallest member.  The graph has one node a column."""
    near: dict[str, set[str]] = {s: set() for s in signals}
    for r in correlations(df, signals).where(F.abs("rho") >= least).collect():  # at most MOST squared rows
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])
    name: dict[str, str] = {}
    for s in sorted(signals):
        wave = {s} - name.keys()
        while wave:
            name |= dict.fromkeys(wave, s)
            wave = set().union(*(near[x] for x in wave)) - name.keys()
    return df.sparkSession.createDataFrame(sorted(name.items()), "signal string, cluster string")
