"""Cluster bootstrap of AUC and of lifts through the pair matrix.

A[i, j] sums, over positives of cluster i and negatives of cluster j, 1 for a higher score and a half for a tie.  A resample
is a vector of multiplicities w, and AUC(w) = w'Aw / ((w.P)(w.N)): the data are ranked once, not once a resample.  Clusters
are events or sources: their number is bounded by design, and CLUSTERS refuses more than one task can hold as a matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Clusters of a cell at most: a matrix of 8 bytes each is 200 MB.  More are refused, not cut.
CLUSTERS = 5000


def pair_matrix(df: DataFrame, cluster: str, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, a2): twice A, as integers, for each cell.

    Scores are first reduced to a histogram for each cluster.  A positive score meets each cluster that has negatives in its
    cell, by equality on the cell, and one window over (cell, cluster) in order of score counts the negatives below it.
    """
    by = by or []
    cell = [F.col(b) for b in by]
    h = df.where(F.col(score).isNotNull()).groupBy(*cell, F.col(cluster).alias("c"), F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    neg = h.where("n > 0").select(*by, F.col("c").alias("j"), "s", "n", F.lit(None).cast(df.schema[cluster].dataType).alias("i"), F.lit(0).cast("long").alias("p"))
    pos = h.where("p > 0").select(*by, F.col("c").alias("i"), "s", "p").withColumn("_one", F.lit(1))
    clusters = neg.select(*by, "j").distinct().withColumn("_one", F.lit(1))
    met = pos.join(F.broadcast(clusters), [*by, "_one"]).select(*by, "j", "s", F.lit(0).cast("long").alias("n"), "i", "p")
    w = Window.partitionBy(*by, "j").orderBy("s")
    upto, tied = F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum("n").over(w.rangeBetween(0, 0))
    a2 = F.sum(F.col("p") * (2 * F.col("_upto") - F.col("_tied"))).alias("a2")
    return met.unionByName(neg).withColumns({"_upto": upto, "_tied": tied}).where("p > 0").groupBy(*by, "i", "j").agg(a2)


def counts(df: DataFrame, cluster: str, positive: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(cluster).alias("c")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))


def resampled_auc(matrix: DataFrame, count: DataFrame, weights: DataFrame) -> DataFrame:
    """(iter, auc) for weights (iter, c, w); a resample without positives or negatives is left out."""
    wi, wj = weights.select("iter", F.col("c").alias("i"), F.col("w").alias("wi")), weights.select("iter", F.col("c").alias("j"), F.col("w").alias("wj"))
    top = matrix.join(wi, "i").join(wj, ["iter", "j"]).groupBy("iter").agg(F.sum(F.col("a2") * F.col("wi") * F.col("wj")).alias("top"))
    base = count.join(weights, "c").groupBy("iter").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n")).where("p > 0 AND n > 0")
    return base.join(top, "iter", "left").select("iter", (F.coalesce("top", F.lit(0)) / (2.0 * F.col("p") * F.col("n"))).alias("auc"))


def drawn(k: int, draws: int, seed: int) -> np.ndarray:
    """Seeded multiplicities of k clusters drawn k times with replacement: a row each draw."""
    return np.random.default_rng(seed).multinomial(k, np.full(k, 1 / k), draws)


def weight_table(spark: SparkSession, clusters: list, draws: int, seed: int) -> DataFrame:
    """(iter, c, w) of ``drawn`` for the sorted clusters."""
    rows = [(i, c, int(x)) for i, row in enumerate(drawn(len(clusters), draws, seed)) for c, x in zip(sorted(clusters), row, strict=True)]
    return spark.createDataFrame(rows, ["iter", "c", "w"])


def lift_draws(rows: DataFrame, cluster: str, positive: str, base: str, measures: list[str], bands: list[str], draws: int = 5000, seed: int = 2982, joint: bool = False) -> DataFrame:
    """(bands, measure, iter, auc, base_auc, lift): each draw's AUC of a measure, of the base measure on the same draw, and their difference.

    The clusters of the whole population are drawn, so a band may miss some of them.  A band has a seed of its own (seed
    plus its number, ordered by its key) unless joint, where all bands of an iteration share one draw.  A draw without
    positives or negatives in a band is left out.  Rows in which a measure or the base is null do not count for that measure.

    The data are reduced to pair matrices by Spark; a cell's matrix then goes to one task with its draws, which are made
    there from the seed, so no table of weights travels.
    """
    import pandas as pd

    names = [r["c"] for r in rows.select(F.col(cluster).alias("c")).distinct().orderBy("c").limit(CLUSTERS + 1).collect()]
    if len(names) > CLUSTERS:
        raise ValueError(f"more than {CLUSTERS} clusters")
    keys = [tuple(r) for r in rows.select(*bands).distinct().orderBy(*bands).limit(1000).collect()] if bands else [()]
    place = {c: i for i, c in enumerate(names)}
    number = {k: i for i, k in enumerate(keys)}
    long = rows.select(*bands, cluster, positive, base, *[m for m in measures if m != base])
    long = long.select(*bands, cluster, positive, F.col(base).cast("double").alias("_base"), F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_score")) for m in measures])))
    long = long.where("_base is not null and _score is not null")
    by = [*bands, "measure"]
    kind = rows.schema[cluster].dataType
    none = F.lit(None).cast(kind)
    parts = [pair_matrix(long, cluster, s, positive, by).select(*by, F.lit(i).alias("_kind"), "i", "j", F.col("a2").cast("long").alias("x"), F.lit(0).cast("long").alias("y")) for i, s in enumerate(("_score", "_base"))]
    totals = counts(long, cluster, positive, by).select(*by, F.lit(2).alias("_kind"), F.col("c").alias("i"), none.alias("j"), F.col("p").alias("x"), F.col("n").alias("y"))
    cells = parts[0].unionByName(parts[1]).unionByName(totals)
    columns = [*by, "iter", "auc", "base_auc", "lift"]

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        k, band = len(place), tuple(x.item() if hasattr(x, "item") else x for x in key[:-1])
        a, b, p, n = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
        for t, i, j, x, y in cell[["_kind", "i", "j", "x", "y"]].itertuples(index=False):
            if t == 2:
                p[place[i]], n[place[i]] = x, y
            else:
                (a if t == 0 else b)[place[i], place[j]] = x
        w = drawn(k, draws, seed + (0 if joint else number[band])).astype(float)
        pairs = 2 * (w @ p) * (w @ n)
        ok = pairs > 0
        auc, low = (((w @ m) * w).sum(1)[ok] / pairs[ok] for m in (a, b))
        out = pd.DataFrame({"iter": np.flatnonzero(ok), "auc": auc, "base_auc": low, "lift": auc - low})
        for name, value in zip(by, key, strict=True):
            out[name] = value
        return out[columns]

    schema = ", ".join([*(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in bands), "measure string, iter long, auc double, base_auc double, lift double"])
    return cells.groupBy(*by).applyInPandas(run, schema)


def lift_table(rows: DataFrame, cluster: str, positive: str, base: str, measures: list[str], bands: list[str], draws: DataFrame, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """(bands, measure, n_pos, n_neg, auc, base_auc, lift, low, n_valid, level, verdict) of the sample itself and of its draws.

    The lower bound is the linear quantile at the level alpha over the number of powered cells, which is fixed from the
    counts before any draw is looked at.
    """
    from .stats import auc as auc_of

    by = [*bands, "measure"]
    long = rows.select(*bands, positive, F.col(base).cast("double").alias("_base"), F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_score")) for m in measures]))).where("_base is not null and _score is not null")
    own = auc_of(long, "_score", positive, by).join(auc_of(long, "_base", positive, by).select(*by, F.col("auc").alias("base_auc")), by)
    powered = own.where(F.col("n_pos") >= least).count()
    level = alpha / max(powered, 1)
    bound = draws.groupBy(*by).agg(F.percentile("lift", F.lit(level)).alias("low"), F.count(F.lit(1)).alias("n_valid"))
    d = own.withColumn("lift", F.col("auc") - F.col("base_auc")).join(bound, by, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0))).withColumn("level", F.lit(level))
    return d.withColumn("verdict", verdict(F.col("n_pos"), F.col("auc"), F.col("lift"), F.col("low"), least))


def verdict(n_pos, auc, lift, low, least: int = 20):
    """UNDERPOWERED below least positives; SUPPORTED where AUC > 0.5, the lift and its lower bound are above 0; an undefined one does not support.  Columns."""
    yes = F.coalesce((auc > 0.5) & (lift > 0) & (low > 0), F.lit(False))
    return F.when(n_pos < least, "UNDERPOWERED").when(yes, "SUPPORTED").otherwise("NOT SUPPORTED")
