"""Operators against brute force on small, tie-heavy input."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrain.functions import stats as tails
from snapgrain.operators import boot, delta, entropy, match, panel, rank, stats
from snapgrain.sources import events


def brute_auc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None


def test_auc_ties_and_one_class(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(rng.randint(0, 4), rng.random() < 0.4) for _ in range(40)]
        df = spark.createDataFrame(rows, "s long, y boolean")
        assert stats.auc(df, "s", "y").first()["auc"] == pytest.approx(brute_auc(rows))
    assert stats.auc(spark.createDataFrame([(1, True)], "s long, y boolean"), "s", "y").first()["auc"] is None
    assert stats.mann_whitney(spark.createDataFrame([(1, True), (1, False)], "s long, y boolean"), "s", "y").first()["z"] is None


def test_spearman(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(30)]
    mid = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    want = np.corrcoef(mid([r[0] for r in rows]), mid([r[1] for r in rows]))[0, 1]
    assert stats.spearman(spark.createDataFrame(rows, "a long, b long"), "a", "b").first()["rho"] == pytest.approx(want)
    assert stats.spearman(spark.createDataFrame(rows[:2], "a long, b long"), "a", "b").first()["rho"] is None


def test_rename_delta(spark):
    parent = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "gone", 5), ("r", "same", 7)], "repo string, path string, m long")
    child = spark.createDataFrame([("r", "a2", 4), ("r", "b", None), ("r", "new", 9), ("r", "same", 7)], "repo string, path string, m long")
    change = spark.createDataFrame([("r", "a", "a2", "touched"), ("r", "b", "b", "touched"), ("r", None, "new", "added")], "repo string, old_path string, new_path string, status string")
    got = {r.path: (r.status, r.delta_m) for r in delta.snapshot_delta(parent, child, change, ["repo"], ["m"]).collect()}
    assert got == {"a2": ("touched", 3), "b": ("touched", -2), "new": ("added", 9), "gone": ("deleted", -5), "same": ("untouched", 0)}


def test_bands(spark):
    for n in (5, 6, 7, 8):
        df = spark.createDataFrame([("s", i // 2, i) for i in range(n)], "s string, v long, o long")
        got = [r.band for r in rank.rank_quartile(df, ["s"], "v", "o").orderBy("o").collect()]
        edges = [i * n // 4 for i in range(1, 4)]
        assert got == [sum(i >= e for e in edges) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in (22, 23, 48, 49, 108, 109)], "v long")
    assert [r[0] for r in df.select(rank.absolute_band(F.col("v"))).collect()] == [0, 1, 1, 2, 2, 3]


def test_bootstrap_matrix_equals_resampling(spark):
    rng = random.Random(3)
    rows = [(c, rng.randint(0, 3), rng.random() < 0.5) for c in range(5) for _ in range(6)]
    df = spark.createDataFrame(rows, "c long, s long, y boolean")
    draws = [[rng.randrange(5) for _ in range(5)] for _ in range(8)]
    weights = spark.createDataFrame([(i, c, d.count(c)) for i, d in enumerate(draws) for c in range(5)], "iter long, c long, w long")
    got = {r.iter: r.auc for r in boot.resampled_auc(boot.pair_matrix(df, "c", "s", "y"), boot.counts(df, "c", "y"), weights).collect()}
    for i, d in enumerate(draws):
        want = brute_auc([(s, y) for c in d for k, s, y in rows if k == c])
        assert got.get(i) == (pytest.approx(want) if want is not None else None)
    judged = spark.createDataFrame([(3, 0.9, 0.1, 0.1), (30, 0.9, 0.1, 0.01), (30, 0.9, 0.1, -0.01), (30, 0.4, 0.1, 0.01), (30, None, None, None)], "n long, auc double, lift double, low double")
    assert [r[0] for r in judged.select(boot.verdict(*map(F.col, judged.columns))).collect()] == ["UNDERPOWERED", "SUPPORTED", "NOT SUPPORTED", "NOT SUPPORTED", "NOT SUPPORTED"]


def test_panel(spark):
    df = spark.createDataFrame([("p", i, float(i * i)) for i in (0, 1, 2, 3, 5, 6)], "path string, idx int, v double")
    runs = panel.with_runs(df, ["path"], "idx")
    assert {(r.run_start, r.run_end) for r in runs.collect()} == {(0, 3), (5, 6)}
    one = panel.lookback(runs, ["path"], "idx", "v", 4).collect()
    assert len(one) == 1 and one[0].slope == pytest.approx(np.polyfit(range(4), [0, 1, 4, 9], 1)[0])
    ev = spark.createDataFrame([("e", 3), ("f", 9)], "e string, day int")
    rel = spark.createDataFrame([(2, 0), (3, 1), (7, 2)], "at int, idx int")
    assert {r.e: r.idx for r in panel.asof_forward(ev, rel, "day", "at", "idx").collect()} == {"e": 1, "f": None}


def test_match_and_entropy(spark):
    spans = spark.createDataFrame([("f", 10, 5), ("f", 20, 0)], "k string, start long, length long")
    hunks = spark.createDataFrame([("f", 1, 9), ("f", 14, 14), ("f", 21, 30)], "k string, lo long, hi long")
    assert {r.start: r.touched for r in match.touched_spans(spans, hunks, ["k"]).collect()} == {10: True, 20: False}
    cf = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a")], "sha long, path string")
    assert {r.path: (r.partners, r.change_entropy) for r in entropy.cochange(cf).collect()} == {"a": (2, 1.0), "b": (1, 0.0), "c": (1, 0.0)}


def test_tails():
    from math import comb

    assert tails.sign_tail(3, 0) == pytest.approx(0.125) and tails.sign_tail(0, 0) is None and tails.sign_tail(0, 4) == pytest.approx(1.0)
    for n in (1, 7, 30, 3000):
        for w in {0, 1, n // 2, n}:
            assert tails.sign_tail(w, n - w) == pytest.approx(sum(comb(n, k) for k in range(w, n + 1)) / 2**n, rel=1e-9)
    for a, b, c, d in [(0, 2, 2, 0), (3, 5, 4, 2), (10, 1, 2, 9), (0, 0, 3, 4), (5, 5, 0, 0), (40, 60, 70, 20)]:
        lower = sum(comb(a + b, k) * comb(c + d, a + c - k) for k in range(max(0, a - d), a + 1)) / comb(a + b + c + d, a + c)
        upper = sum(comb(a + b, k) * comb(c + d, a + c - k) for k in range(a, min(a + b, a + c) + 1)) / comb(a + b + c + d, a + c)
        assert tails.hypergeometric_tails([[a, b], [c, d]]) == (pytest.approx(lower), pytest.approx(upper))


def test_sources(spark, tmp_path):
    body = {"repo": "r", "source": "s", "pool_head": "h", "counts": {"a": 2}, "events": [{"id": "1", "class": "a", "sha": "x"}, {"id": "2", "class": "b", "sha": "x"}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    path = str(tmp_path / "e.json")
    assert events.read_events(spark, [path]).count() == 2
    assert [r["class"] for r in events.read_events(spark, [path], dedup=True).collect()] == ["a"]
    diff = "--- a/f.c\n+++ b/f.c\n@@ -3,2 +3 @@\n--- old\n-x\n+y\n"
    got = events.parse_diffs(spark.createDataFrame([(1, diff), (2, None)], "i long, t string"), "i", "t").collect()
    assert [(r.path, r.lo, r.hi, r.added, r.removed) for r in got] == [("f.c", 3, 4, ["y"], ["-- old", "x"])]


def test_stream_takes_a_key_once_over_batches_and_retries(spark, tmp_path):
    from snapgrain.streaming.ingest import watch_panel

    schema = "repo_name string, commit_hash string, file_path string, loc long"
    land, panel_, seen = str(tmp_path / "land"), str(tmp_path / "panel"), []

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        watch_panel(spark, land, schema, panel_, str(tmp_path / "ck"), lambda pairs: seen.append(sorted(map(tuple, pairs.collect())))).awaitTermination()
        return sorted((r.commit_hash, r.file_path) for r in spark.read.parquet(panel_).collect())

    assert step([("r", "c", "f", 1), ("r", "c", "f", 1)]) == [("c", "f")]
    assert step([("r", "c", "f", 1), ("r", "c", "g", 2), ("r", "d", "f", 3)]) == [("c", "f"), ("c", "g"), ("d", "f")]
    assert seen == [[("r", "c")], [("r", "c"), ("r", "d")]]
    (tmp_path / "ck" / "commits" / "1").unlink()  # the second batch broke off before it was committed
    for crc in (tmp_path / "ck" / "commits").glob(".1.crc"):
        crc.unlink()
    assert step([("r", "e", "f", 9)]) == [("c", "f"), ("c", "g"), ("d", "f"), ("e", "f")]
