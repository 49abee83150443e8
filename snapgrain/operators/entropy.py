"""Co-change, ownership and decayed change entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy_bits(df: DataFrame, by: list[str], count: str) -> DataFrame:
    """Shannon entropy in bits of a count distribution, from sums: log2(N) - sum(c * log2(c)) / N."""
    s = df.groupBy(*by).agg(F.sum(count).alias("total"), F.sum(F.col(count) * F.log2(F.col(count).cast("double"))).alias("_s"), F.count(F.lit(1)).alias("n_kinds"))
    return s.select(*by, "total", "n_kinds", (F.log2(F.col("total").cast("double")) - F.col("_s") / F.col("total")).alias("entropy"))


def narrow(commit_file: DataFrame, commit: str, least: int, most: int) -> DataFrame:
    """Rows of commits that touch between least and most files."""
    size = commit_file.groupBy(commit).agg(F.count_distinct("path").alias("_n")).where(F.col("_n").between(least, most)).drop("_n")
    return commit_file.join(size, commit, "left_semi")


def cochange(commit_file: DataFrame, commit: str = "sha", least: int = 2, most: int = 50) -> DataFrame:
    """Per path: distinct partners in its commits and the entropy of its partner counts (0 below two partners).  The breadth filter bounds the self-join."""
    n = narrow(commit_file.select(commit, "path").distinct(), commit, least, most)
    pairs = n.join(n.withColumnRenamed("path", "partner"), commit).where("path <> partner").groupBy("path", "partner").agg(F.count(F.lit(1)).alias("c"))
    e = entropy_bits(pairs, ["path"], "c")
    return e.select("path", F.col("n_kinds").alias("partners"), F.when(F.col("n_kinds") < 2, 0.0).otherwise(F.round("entropy", 6)).alias("change_entropy"))


def period(age: Column, length: int) -> Column:
    """Periods count backward from the anchor; a negative age is in period 0, what is older than a year in the oldest."""
    n = -(-365 // length)
    return F.least(F.floor(F.greatest(age, F.lit(0)) / length), F.lit(n - 1)).cast("int")


ATTRIBUTION, DECAY, LENGTHS = ("weighted", "shared", "full"), ("none", "exp", "linear", "log"), (30, 90, 180)


def change_entropy_variants(touches: DataFrame, lengths=LENGTHS) -> DataFrame:
    """touches (anchor, path, age in days, one row a change) -> (anchor, path, length, attribution, decay, value): all variants in one pass over each period length."""
    out = None
    for length in lengths:
        t = touches.select("anchor", "path", period(F.col("age"), length).alias("k")).groupBy("anchor", "k", "path").agg(F.count(F.lit(1)).alias("c"))
        e = entropy_bits(t, ["anchor", "k"], "c")
        h = e.select("anchor", "k", "total", F.col("n_kinds").alias("files"), F.when(F.col("n_kinds") < 2, 0.0).otherwise(F.col("entropy") / F.log2(F.col("n_kinds").cast("double"))).alias("h"))
        j = t.join(h, ["anchor", "k"])
        mid = F.col("k") * length + length / 2
        share = {"weighted": F.col("c") / F.col("total") * F.col("h"), "shared": F.col("h") / F.col("files"), "full": F.col("h")}
        decay = {"none": F.lit(1.0), "exp": F.exp(-mid / 180), "linear": F.greatest(F.lit(0.0), 1 - mid / 365), "log": 1 / F.log2(2 + mid / 30)}
        sums = [F.sum(share[a] * decay[d]).alias(f"{a}_{d}") for a in ATTRIBUTION for d in DECAY]
        wide = j.groupBy("anchor", "path").agg(*sums).withColumn("length", F.lit(length))
        long = wide.unpivot(["anchor", "path", "length"], [f"{a}_{d}" for a in ATTRIBUTION for d in DECAY], "variant", "value")
        out = long if out is None else out.unionByName(long)
    return out


def flavour(touches: DataFrame, length: int = 90, most: int = 30) -> DataFrame:
    """touches (anchor, path, sha, age) -> (anchor, path, value): weighted attribution with exponential decay, commits of over most files left out."""
    t = touches.withColumn("_commit", F.struct("anchor", "sha"))
    kept = narrow(t, "_commit", 1, most).select("anchor", "path", "age")
    return change_entropy_variants(kept, (length,)).where("variant = 'weighted_exp'").select("anchor", "path", "value")
