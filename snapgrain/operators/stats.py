"""Rank statistics over histograms of distinct scores, so that no window sees single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which the scores of a single group are cut, so that its running sums are not one task's.
RANGES = 64


def running(h: DataFrame, by: list[str], score: str, values: dict[str, str]) -> DataFrame:
    """h (a row for each distinct score) with the running sum of each value (new name: column) up to and with the score, within by.

    Groups sum in windows of their own.  Without groups the scores are cut at quantiles: sums within each range, and the
    totals of the ranges below, which are RANGES rows.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(score)
        return h.withColumns({n: F.sum(v).over(w) for n, v in values.items()})
    cuts = sorted(set(h.approxQuantile(score, [i / RANGES for i in range(1, RANGES)], 0.2 / RANGES)))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(score))) if cuts else F.lit(0)
    d = h.withColumn("_range", place)
    w = Window.partitionBy("_range").orderBy(score)
    totals = d.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(below), F.lit(0)).alias(f"_b_{n}") for n in values])
    d = d.withColumns({n: F.sum(v).over(w) for n, v in values.items()}).join(F.broadcast(totals), "_range")
    return d.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in values}).drop("_range", *[f"_b_{n}" for n in values])


def _histogram(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Distinct scores with their positives, negatives, and the negatives and rows below."""
    h = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    h = running(h.withColumn("_all", F.col("p") + F.col("n")), by, score, {"below_n": "n", "below": "_all"})
    return h.withColumns({"below_n": F.col("below_n") - F.col("n"), "below": F.col("below") - F.col("_all")}).drop("_all")


def auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """by, n_pos, n_neg, auc (null where a class is empty).  Ties count a half."""
    by = by or []
    h = _histogram(df, by, score, positive)
    out = h.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (2 * F.col("below_n") + F.col("n"))).alias("_twice"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_twice") / (2 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def mann_whitney(df: DataFrame, score: str, first: str, by: list[str] | None = None) -> DataFrame:
    """U of the first sample, the tie-corrected z with continuity for "first is smaller"; z is null where the variance is 0 or a sample is empty."""
    by = by or []
    h = _histogram(df, by, score, first)
    t = F.col("p") + F.col("n")
    s = h.groupBy(*by).agg(F.sum("p").cast("double").alias("n1"), F.sum("n").cast("double").alias("n2"), F.sum(F.col("p") * (F.col("below") + (t + 1) / 2)).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    variance = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return s.select(*by, "n1", "n2", "u", F.when((n > 1) & (variance > 0), (F.col("u") - F.col("n1") * F.col("n2") / 2 + 0.5) / F.sqrt(variance)).alias("z"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of mid-ranks, from distinct value pairs; null for fewer than 3 rows or no variance."""
    by = by or []
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))
    for v, r in ((x, "rx"), (y, "ry")):
        h = pairs.groupBy(*by, v).agg(F.sum("c").alias("k"))
        h = running(h, by, v, {"_to": "k"}).select(*by, v, (F.col("_to") - F.col("k") / 2 + 0.5).alias(r))
        pairs = pairs.join(h, [*by, v])
    c, a, b = (F.col(k) for k in ("c", "rx", "ry"))
    s = pairs.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(c * a).alias("sx"), F.sum(c * b).alias("sy"), F.sum(c * a * a).alias("sxx"), F.sum(c * b * b).alias("syy"), F.sum(c * a * b).alias("sxy"))
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    return s.select(*by, "n", F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).alias("rho"))


def budget_recall(df: DataFrame, by: list[str], score: str, path: str, length: str, positive: str, budget: float = 0.2) -> DataFrame:
    """Share of positives among the rows read by descending score while less than the budget of the total length is spent; the row that crosses it counts."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), path)
    spent = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(length).over(Window.partitionBy(*by))
    limit = F.when(total == 0, 1).otherwise(budget * total)
    taken = df.withColumn("_in", spent < limit)
    return taken.groupBy(*by).agg(F.count_if("_in").alias("n_read"), F.count_if(F.col(positive)).alias("n_pos"), (F.count_if(F.col("_in") & F.col(positive)) / F.nullif(F.count_if(F.col(positive)), F.lit(0))).alias("recall"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: precision, recall and F1, 0 where undefined."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("c")).selectExpr("c", "inline(array(struct(t AS class, c AS actual, 0L AS guessed, if(t = g, c, 0L) AS hit), struct(g AS class, 0L AS actual, c AS guessed, 0L AS hit)))")
    s = c.groupBy("class").agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0))
    return s.select("class", "actual", "guessed", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def index_split(df: DataFrame, order: str) -> DataFrame:
    """df with part: derivation strictly before the value at place n // 2 of the sorted values, holdout from it on."""
    h = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count(F.lit(1)).alias("_c"))
    whole = F.sum("_c").over(Window.partitionBy())
    upto = F.sum("_c").over(Window.orderBy(order))
    cut = h.select(order, upto.alias("_to"), whole.alias("_n")).where(F.col("_to") >= F.floor(F.col("_n") / 2) + 1).agg(F.min(order).alias("_cut"), F.lit(1).alias("_one"))  # a row a distinct value
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one")
    return d.withColumn("part", F.when(F.col(order) < F.col("_cut"), "derivation").otherwise("holdout")).drop("_one", "_cut")
