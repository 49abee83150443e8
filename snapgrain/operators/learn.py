"""Multinomial classifier over event features: standardise on train, choose the penalty by stratified folds, refit."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import confusion


def standardised(train: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """z-scores by the train part's mean and population deviation; a deviation under 1e-9 counts as 1."""
    s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = {c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] if (s[f"s_{c}"] or 0) >= 1e-9 else 1.0) for c in columns}
    return train.withColumns(z), other.withColumns(z)


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_multinomial(train: DataFrame, columns: list[str], label: str, penalty: float, steps: int = 100, tolerance: float = 1e-9):
    """Softmax likelihood with (penalty / 2n) * |W|^2, intercepts free."""
    n = train.count()
    return LogisticRegression(family="multinomial", labelCol=label, regParam=penalty / n, elasticNetParam=0.0, standardization=False, maxIter=steps, tol=tolerance).fit(_vector(train, columns))


def macro_f1(model, df: DataFrame, columns: list[str], label: str) -> float:
    guess = model.transform(_vector(df, columns)).select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("g"))
    return confusion(guess, "t", "g").agg(F.avg("f1")).first()[0] or 0.0


def folds(df: DataFrame, label: str, ident: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold: each class is dealt over k folds in an order that the seed and the ident give, so any executor deals alike."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(order, ident)) - 1) % k)


GRID = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)


def select_penalty(train: DataFrame, columns: list[str], label: str, ident: str, grid=GRID, k: int = 5) -> tuple[float, dict[float, float]]:
    """The first penalty with the best mean macro-F1 over the folds, and all means.  Each fold is standardised by its own train part."""
    parts = folds(train, label, ident, k).persist()

    def one(i: int) -> list[float]:
        tr, va = standardised(parts.where(F.col("fold") != i), parts.where(F.col("fold") == i), columns)
        if va.isEmpty() or tr.isEmpty():
            return []
        tr, va = tr.persist(), va.persist()
        scores = [macro_f1(fit_multinomial(tr, columns, label, g, 50, 1e-6), va, columns, label) for g in grid]
        tr.unpersist(), va.unpersist()
        return scores

    with ThreadPoolExecutor(k) as pool:  # the folds' jobs run beside each other
        found = [x for x in pool.map(one, range(k)) if x]
    parts.unpersist()
    means = {g: sum(x[i] for x in found) / len(found) if found else -1.0 for i, g in enumerate(grid)}
    return max(grid, key=lambda g: means[g]), means


def select_and_fit(train: DataFrame, test: DataFrame, columns: list[str], label: str, ident: str, grid=GRID, k: int = 5) -> DataFrame:
    """test with the argmax class and its probability, by a model of all of train with the selected penalty."""
    best, _ = select_penalty(train, columns, label, ident, grid, k)
    train, test = standardised(train, test, columns)
    model = fit_multinomial(train, columns, label, best)
    out = model.transform(_vector(test, columns)).withColumn("p", F.array_max(vector_to_array("probability")))
    return out.select(ident, F.col(label).cast("int").alias("truth"), F.col("prediction").cast("int").alias("guess"), F.round("p", 6).alias("p"), F.lit(best).alias("penalty"))


def temporal_parts(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame, int]:
    """(train before the cutoff, test from it on, rows without a date, which are in neither)."""
    day = F.to_date(F.lit(cutoff))
    return df.where(F.col(date) < day), df.where(F.col(date) >= day), df.where(F.col(date).isNull()).count()


def active(train: DataFrame, columns: list[str], least: float = 0.03) -> list[str]:
    """The signals that are not 0 in at least that share of train."""
    share = train.agg(*[F.avg((F.coalesce(F.col(c), F.lit(0)) != 0).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if (share[c] or 0) >= least]


def contrasts(model, columns: list[str], first: list[int], second: int) -> list[tuple[str, float]]:
    """(column, difference of coefficients): the mean over the classes of first minus the second class, the largest absolute one first; names break ties."""
    w = model.coefficientMatrix.toArray()
    diff = w[first].mean(0) - w[second]
    return sorted(zip(columns, map(float, diff), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def collapsed(df: DataFrame, label: str, first: list[int]) -> DataFrame:
    """df with the label made two classes: 1 for those of first, else 0."""
    return df.withColumn(label, F.col(label).isin(first).cast("int"))
