"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score z is a sum of three terms: hashed words by one weight vector, divided by the root of their number; a few
text measures; and, for each distinct word and each opening of a word, a sparse weight of its presence, which long texts do
not dilute; an opening stands for words of its kind that the sample does not hold.  Ordered
thresholds t_1 < t_2 turn z into P(grade >= j) = sigmoid(z - t_j).  From these come the expected grade and the tail probability for selection.

Grades from labels (quality, toxic): 0 of low quality, 1 of good quality but toxic, 2 clean.  The model is fitted on the
``sample`` labelled rows with the smallest hash of their id (a documented bound; all rows where there are fewer), every
document is scored on its whole text.  Of a sampled row's text the driver gets no more than its features: hashes of words
and measures, about 8 bytes a word.  Rows without a quality label or without a document do not count; a null toxic label
counts as not toxic.  Of clashing labels of one doc_id the lowest grade holds.  Without any usable label, or with labels of
one grade only, nothing can be learned: expected and tail are null and all documents stay.

A null text counts as empty.  Rows that repeat a doc_id are scored each by its text; of those, a label trains on the text
with the least hash.  Rows without an id are scored and have no label.  Other columns of the input stay, but for those
named expected, tail or kept in any case, in whose place ``graded`` puts its own; ``select_good`` keeps all.  An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, small_batches, unused
from .words import LOWER, groups, hashes, mix, spans

BITS, SAMPLE, DENSE, GRADES = 18, 4000, 12, 3
#: Bytes of the openings of longer words that count as present, beside the words.
OPENINGS = (3, 4)
#: Rows of the sample that a word or opening is in at least to get a presence weight; in fewer, its pull cannot pass SPARSE.
HOLDERS = 3
#: A document stays if P(grade >= 2) is at least this.
KEEP = 0.5
#: Words whose pull on the likelihood stays below this have no presence weight.
SPARSE = 0.002

Features = tuple[np.ndarray, ...]


def distinct_of(word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (word, owner) pairs, in order of owner."""
    order = np.lexsort((word, owner))
    w, o = word[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    return w[new], o[new]


def features(flat: np.ndarray, offsets: np.ndarray) -> Features:
    """(hashed word numbers, words per text, measures per text, hashes of distinct words and openings, their number per text) of many texts."""
    n = len(offsets) - 1
    start, end, counts = spans(flat, offsets)
    # one closing punctuation mark does not make another word
    tail = flat[end - 1] if len(end) else flat
    marked = ~((LOWER[tail] - 97 < 26) | (tail >= 128)) & (end - start > 1) if len(end) else np.zeros(0, bool)
    word = hashes(flat, start, end - marked, True)
    owner = np.repeat(np.arange(n), counts)
    dense = np.zeros((n, DENSE))
    seen, distinct, present = np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(start):
        mean = lambda x: np.bincount(owner, x, n) / np.maximum(counts, 1)
        last, before = flat[end - 1], flat[np.maximum(end - 2, start)]
        letter = (LOWER[flat] - 97 < 26) | (flat >= 128)
        total = np.concatenate([[0], np.cumsum(letter)])
        upper = np.concatenate([[0], np.cumsum((flat >= 65) & (flat <= 90))])
        letters, uppers = total[end] - total[start], upper[end] - upper[start]
        odd = ~((LOWER[last] - 97 < 26) | (last >= 128) | ((last >= 48) & (last <= 57)))
        dense[:, 0] = mean((odd & (last == before) & (end - start > 1)).astype(float))
        dense[:, 1] = mean((letters == 0).astype(float))
        dense[:, 2] = mean(((uppers == letters) & (letters > 1)).astype(float))
        again = np.zeros(len(word))
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        dense[:, 3] = mean(again)
        dense[:, 4] = mean((odd & (last != 44) & (last != 46)).astype(float))
        dense[:, 5] = mean((end - start) / 10.0)
        w, o = distinct_of(word, owner)
        distinct = np.bincount(o, minlength=n)
        dense[:, 6] = distinct / np.maximum(counts, 1) * (counts >= 20)
        dense[:, 7] = (distinct < 0.3 * counts) * (counts >= 20)
        for size in OPENINGS:
            long = end - marked - start > size
            x, y = distinct_of(mix(hashes(flat, start[long], start[long] + size, True) + np.uint64(size)), owner[long])
            w, o = np.concatenate([w, x]), np.concatenate([o, y])
        seen, present = w[np.argsort(o, kind="stable")], np.bincount(o, minlength=n)
    dense[:, 8] = np.log1p(counts) / 10
    dense[:, 9] = counts == 0
    dense[:, 10] = counts < 20
    dense[:, 11] = 1 / (1 + counts)
    return (word & np.uint64((1 << BITS) - 1)).astype(np.int64) if len(start) else np.zeros(0, np.int64), counts, dense, seen, present


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total, ends = np.concatenate([[0.0], np.cumsum(values)]), np.cumsum(counts)
    return total[ends] - total[ends - counts]


@dataclass
class Model:
    words: np.ndarray
    dense: np.ndarray
    steps: np.ndarray  # thresholds
    keys: np.ndarray  # sorted hashes of words with a presence weight
    presence: np.ndarray

    def score(self, index: np.ndarray, counts: np.ndarray, dense: np.ndarray, seen: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2."""
        z = sums(self.words[index], counts) / np.sqrt(np.maximum(counts, 1)) + dense @ self.dense
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, seen), len(self.keys) - 1)
            z = z + sums(np.where(self.keys[at] == seen, self.presence[at], 0.0), distinct)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.steps[None], -30, 30)))


def fit(index: np.ndarray, counts: np.ndarray, dense: np.ndarray, seen: np.ndarray, distinct: np.ndarray, grade: np.ndarray, rounds: int = 600, decay: float = 3e-3, sparse: float = SPARSE) -> Model:
    """Maximum penalised likelihood by Adam; presence weights by proximal steps scaled to their curvature, whose absolute penalty leaves most at exactly 0.  Thresholds are a first one and positive gaps, so they stay in order.  Grades weigh alike in the root of their frequency."""
    n, owner = len(counts), np.repeat(np.arange(len(counts)), counts)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    used, index = np.unique(index, return_inverse=True)
    keys, place = np.unique(seen, return_inverse=True)
    holder = np.repeat(np.arange(n), distinct)
    often = np.bincount(place, minlength=len(keys)) >= HOLDERS if len(keys) else np.zeros(0, bool)
    held = often[place]
    keys, place, holder = keys[often], (np.cumsum(often) - 1)[place[held]], holder[held]
    distinct = np.bincount(holder, minlength=n)
    params = [np.zeros(len(used)), np.zeros(DENSE), np.array([-1.0, 0.0])]
    u = np.zeros(len(keys))
    share = np.bincount(grade, minlength=GRADES) / n
    weight = 1 / np.sqrt(np.maximum(share, 1e-3))[grade]
    weight /= weight.sum()
    reach = 1 / (2 * np.bincount(place, weight[holder], len(keys)) + 1e-12)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        w, d, s = params
        z = sums(w[index], counts) * scale + dense @ d + sums(u[place], distinct)
        steps = np.array([s[0], s[0] + np.exp(s[1])])
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - steps, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
        p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], 1)
        upper, lower = slope[np.arange(n), grade] / p * weight, slope[np.arange(n), grade + 1] / p * weight
        dz = -(upper - lower)
        dsteps = np.array([upper[grade == j].sum() - lower[grade == j - 1].sum() for j in (1, 2)])
        grads = [np.bincount(index, (dz * scale)[owner], len(used)) + decay * w, dense.T @ dz + 2e-5 * d, np.array([dsteps.sum(), dsteps[1] * np.exp(s[1])])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-6)
        if t > rounds // 4:  # once the thresholds have settled
            u = u - reach * np.bincount(place, dz[holder], len(keys))
            u = np.sign(u) * np.maximum(np.abs(u) - reach * sparse, 0.0)
    words = np.zeros(1 << BITS)
    words[used] = params[0]
    return Model(words, params[1], np.array([params[2][0], params[2][0] + np.exp(params[2][1])]), keys[u != 0], u[u != 0])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list:
    """The features and the grade of at most sample labelled documents; a row each, in order of id."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    lowest = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(grade).alias("grade"))
    chosen = lowest.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded by sample, so it may be broadcast
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), body, F.xxhash64(body).alias("_hash"))
    found = own.join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "grade").agg(F.min(F.struct("_hash", "_text")).alias("_row")).select("_id", F.col("_row._text").alias("_text"), "grade")

    def run(batches):
        for batch in batches:
            flat, offsets = buffers(batch.column(1))
            rows = []
            for a, b in groups(offsets):
                index, counts, dense, seen, distinct = features(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words, kinds = np.split(index.astype("<i4"), np.cumsum(counts)[:-1]), np.split(seen.astype("<u8"), np.cumsum(distinct)[:-1])
                rows += [(w.tobytes(), d.tolist(), k.tobytes()) for w, d, k in zip(words, dense, kinds, strict=True)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            arrays = [batch.column(0), batch.column(2), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "grade", "words", "dense", "seen"])

    kind = docs.schema[id_col].dataType.simpleString()
    return sorted(one.mapInArrow(run, f"_id {kind}, grade int, words binary, dense array<double>, seen binary").collect(), key=lambda r: r["_id"])


def train(rows: list) -> Model | None:
    grade = np.array([r["grade"] for r in rows], np.int64)
    if len(np.unique(grade)) < 2:
        return None
    words, seen = ([np.frombuffer(r[c], kind) for r in rows] for c, kind in (("words", "<i4"), ("seen", "<u8")))
    size = lambda parts: np.array([len(x) for x in parts], np.int64)
    return fit(np.concatenate(words).astype(np.int64), size(words), np.array([r["dense"] for r in rows]), np.concatenate(seen).astype(np.uint64), size(seen), grade)


def scores(docs: DataFrame, labels: DataFrame, names: tuple[str, str, str], id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs with expected (grade), tail (P(grade >= 2)) and kept under names, which docs must not have."""
    spark = docs.sparkSession
    small_batches(spark)
    own = [F.col(f"`{c}`") for c in docs.columns]
    model = train(labelled(docs, labels, id_col, text, sample))
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(*own, none.alias(names[0]), none.alias(names[1]), F.lit(True).alias(names[2]))
    shared = spark.sparkContext.broadcast(model)  # 2 MB and the presence weights of the sample, whatever the input

    @F.pandas_udf("struct<expected double, tail double>")
    def score(bodies):
        import pandas as pd

        flat, offsets = buffers(pa.array(bodies.fillna(""), pa.large_string()))
        out = [shared.value.score(*features(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in groups(offsets)]
        tail = np.concatenate(out) if out else np.zeros((0, 2))
        return pd.DataFrame({"expected": tail.sum(1), "tail": tail[:, 1]})

    (s,) = unused([*docs.columns, *names], "_score")
    scored = docs.select(*own, score(F.col(f"`{text}`")).alias(s))
    return scored.select(*own, F.col(f"{s}.expected").alias(names[0]), F.col(f"{s}.tail").alias(names[1]), (F.col(f"{s}.tail") >= keep).alias(names[2]))


def graded(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs with expected (grade), tail (P(grade >= 2)) and kept; columns of docs with these names give way."""
    names = ("expected", "tail", "kept")
    return scores(docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in names]), labels, names, **how)


def select_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that stay, with their columns."""
    names = unused(docs.columns, "_expected", "_tail", "_kept")
    return scores(docs, labels, tuple(names), **how).where(F.col(names[2])).select(*[f"`{c}`" for c in docs.columns])
