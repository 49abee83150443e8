"""Harvesting, resampling, verdicts, clusters and reports against small cases worked out apart."""

import random
import statistics

import duckdb
import numpy as np
import pytest

from snapgrain.operators import boot, cluster, harvest, resample, verdict
from snapgrain.plans import evidence  # noqa: F401
from snapgrain.plans.catalog import ORACLE, QUERIES
from snapgrain.sources import report

A, B, C = ("a" * 40, "b" * 40, "c" * 40)


def test_vulnerability_commits(spark):
    entries = [
        {"id": "V1", "summary": "s", "database_specific": {"severity": None, "CWE": {"id": "CWE-1", "desc": "d"}}, "affected": [{"database_specific": {"severity": "low"}, "ecosystem_specific": {"severity": "high"}, "ranges": [{"type": "SEMVER", "repo": None, "events": [{"introduced": C, "fixed": None}]}, {"type": "GIT", "repo": "x/Y", "events": [{"introduced": B, "fixed": None}, {"introduced": "0", "fixed": None}, {"introduced": None, "fixed": A}, {"introduced": C, "fixed": None}]}]}]},
        {"id": "V2", "summary": None, "database_specific": None, "affected": [{"database_specific": None, "ecosystem_specific": None, "ranges": [{"type": "GIT", "repo": None, "events": [{"introduced": "0", "fixed": None}]}]}]},
        {"id": "V3", "summary": None, "database_specific": None, "affected": None},
    ]
    df = spark.createDataFrame(entries, harvest.VULNERABILITY)
    known = spark.createDataFrame([(A,)], "sha string")
    got = {(r["id"], r["class"], r["sha"], r["severity"], r["cwe"], r["known"]) for r in harvest.vulnerability_commits(df, known).collect()}
    assert got == {("V1", "security-fix", A, "high", "CWE-1", True), ("V1", "introduced", C, "high", "CWE-1", False)}
    assert harvest.vulnerability_commits(df, known, "y").count() == 2 and harvest.vulnerability_commits(df, known, "other").count() == 0


def test_follow_ups_take_the_first_known_reference(spark):
    rows = [("1", 'Revert "x"', "see"), ("2", "Fix", f"follow-up to {'d' * 9}\nFollowup to {'b' * 7}, Follow-up to {A}"), ("3", "no Revert", None), ("4", None, "Follow-up to aaaaaa")]
    commits = spark.createDataFrame(rows, "sha string, subject string, body string")
    fixes = spark.createDataFrame([(A,), (B,), (B,)], "sha string")
    assert [tuple(r) for r in harvest.follow_ups(commits, fixes).collect()] == [("2", B)]
    assert [tuple(r) for r in harvest.reverts(commits).collect()] == [("1", "revert")]


def test_label_draw_is_disjoint_and_repeatable(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(x for x in ("Fixes #1", "\nBug: u", "a Regression") if rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "sha long, body string")
    labelled = harvest.message_labels(df, "body")
    assert {r.sha for r in labelled.collect()} == {i for i, b in rows if b.strip()}
    plan = [("regression", None), ("bugfix-fixes", 10), ("bugfix-bug", 500)]
    draw = lambda x: sorted((r["sha"], r["class"]) for r in harvest.label_draw(x, spark.createDataFrame([(0,), (1,)], "sha long"), "sha", plan, 7).collect())
    got = draw(labelled)
    assert got == draw(labelled.repartition(7)) and len({s for s, _ in got}) == len(got) and not {0, 1} & {s for s, _ in got}
    kinds = [c for _, c in got]
    assert kinds.count("bugfix-fixes") == 10 and kinds.count("regression") == sum("Reg" in b for i, b in rows if i > 1)


def test_resampling_against_expansion(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.randrange(8), rng.random() < 0.5) for _ in range(60)]
    df = spark.createDataFrame(rows, "c long, s long, y boolean")
    p, n = ([(i, c, rng.randrange(3)) for i in range(8) for c in range(6)] for _ in range(2))
    wp, wn = (spark.createDataFrame(x, "iter long, c long, w long") for x in (p, n))
    got = {r.iter: r.auc for r in resample.two_sample_auc(boot.pair_matrix(df, "c", "s", "y"), boot.counts(df, "c", "y"), wp, wn).collect()}
    mid = {r.iter: r["diff"] for r in resample.median_difference(df, wp, "c", "s", "y").collect()}
    for i in range(8):
        up, down = ({c: w for k, c, w in x if k == i} for x in (p, n))
        pos = [s for c, s, y in rows if y for _ in range(up[c])]
        neg = [s for c, s, y in rows if not y for _ in range(down[c])]
        assert got.get(i) == (pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))) if pos and neg else None)
        other = [s for c, s, y in rows if not y for _ in range(up[c])]
        assert mid.get(i) == (statistics.median(pos) - statistics.median(other) if pos and other else None)
    pairs = spark.createDataFrame([(0, 2, 1), (1, 1, 1), (2, 0, 1)], "c long, a long, b long")
    w = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 0)], "iter long, c long, w long")
    assert [tuple(r) for r in resample.win_rate(pairs, w, "c", "a", "b").collect()] == [(0, 0.5)]


def test_pairs_are_drawn_without_a_join(spark, tmp_path):
    rows = [(1, 950.0, 2), (2, 940.0, 2), (2, 900.0, 2), (4, 1000.0, 1), (7, None, 3), (None, 990.0, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    files = f"read_parquet('{tmp_path}/part.parquet/*.parquet')"
    for name in ("matched_pair_boot", "paired_median_boot"):
        df = QUERIES[name](spark, str(tmp_path))
        # a join has a side that is as large as the table, which Spark may send through the driver
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r[0], round(r[1], 6)) for r in df.collect())
        assert got == sorted((i, round(x, 6)) for i, x in duckdb.sql(f"WITH part AS (FROM {files}) SELECT * FROM ({ORACLE[name]})").fetchall())


def explicit_pairs(pairs, i, seed):
    """(auc, base_auc) of draw i by picking the pairs one by one and counting every positive against every control."""

    def mix(x):
        x = (x ^ x >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return x ^ x >> 16

    whole = sorted(x for x in pairs if None not in x)
    n = len(whole)
    picked = [whole[n * mix(mix(k + 1) ^ mix(65536 * seed + i)) >> 32] for k in range(n)]
    return [sum((x[a] > y[a + 1]) + 0.5 * (x[a] == y[a + 1]) for x in picked for y in picked) / n**2 for a in (0, 2)]


def test_matched_pairs_against_explicit_resampling(spark):
    rng = random.Random(4)
    pairs = [tuple(None if rng.random() < 0.03 else float(rng.randrange(m)) for m in (9, 7, 4, 5)) for _ in range(40)]
    pairs += pairs[:10]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = {r.iter: r for r in resample.matched_draws(df.repartition(5), *"abcd", draws=30, seed=7, parts=4).collect()}
    assert sorted(got) == list(range(30)) and len({r.auc for r in got.values()}) > 20
    for i, r in got.items():
        auc, base = explicit_pairs(pairs, i, 7)
        assert (r.auc, r.base_auc, r.lift) == pytest.approx((auc, base, auc - base))
    assert resample.matched_draws(df.limit(0), *"abcd", draws=3).count() == 0 and resample.matched_draws(df, *"abcd", draws=3).count() == 3
    with pytest.raises(ValueError):
        resample.matched_draws(df, *"abcd", draws=1 << 16)


def test_matched_pairs_are_drawn_like_a_generator_does(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 4)) + [0.4, 0, 0.1, 0]
    got = resample.matched_draws(spark.createDataFrame(v.tolist(), "a double, b double, c double, d double"), *"abcd", draws=2000).toPandas()
    wins = [v[:, None, a] > v[None, :, a + 1] for a in (0, 2)]
    w = rng.multinomial(300, np.full(300, 1 / 300), 2000)
    auc, base = (((w @ m) * w).sum(1) / 300**2 for m in wins)
    for name, x in (("auc", auc), ("base_auc", base), ("lift", auc - base)):
        assert abs(got[name].mean() - x.mean()) < 0.1 * x.std() and 0.9 < got[name].std() / x.std() < 1.1


def test_matched_pair_boot_is_the_pooled_lift(spark, tmp_path):
    """Positives of a draw meet the controls of all its pairs, for price and for size, in 5000 draws; wins within own pairs are another statistic."""
    rows = [(7 * k, 900.0 + 30 * (k * k % 11), 1 + k % 4) for k in range(25)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r[0]: r[1] for r in QUERIES["matched_pair_boot"](spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(f"{i}:{m}" for i in range(5000) for m in ("auc", "base_auc", "lift"))
    pairs = [(price, 20.0 * size + 900, float(size), float(size + k % 3 - 1)) for k, price, size in rows]
    for i in (0, 1, 17, 4999):
        auc, base = explicit_pairs(pairs, i, 2982)
        assert [got[f"{i}:{m}"] for m in ("auc", "base_auc", "lift")] == pytest.approx([auc, base, auc - base])


def test_verdicts(spark):
    bands = spark.createDataFrame([("v", 0, True), ("v", 1, True), ("v", 2, True), ("v", 3, None), ("u", 0, True), ("u", 1, True)], "v string, b int, s boolean")
    got = {r.v: tuple(r)[1:] for r in verdict.band_headline(bands, ["v"], "s").collect()}
    assert got == {"v": (3, 4, False, True, True), "u": (2, 2, True, True, False)}
    lifts = {0: (4, 3, 2, 1), 1: (4, 4, 2, 1), 2: (4, 3, 2, None), 3: (4, 3, 2, float("nan")), 4: (1, 2, 3, 4), 5: (9, 5, 2, 0)}
    df = spark.createDataFrame([(i, b, None if x is None else float(x)) for i, l in lifts.items() for b, x in enumerate(l)], "i long, b int, x double")
    assert tuple(verdict.monotone_share(df, "i", "b", "x").first()) == (4, 0.5, False)
    assert tuple(verdict.monotone_share(df.where("i in (0, 5)"), "i", "b", "x").first()) == (2, 1.0, True)
    assert tuple(verdict.monotone_share(df.limit(0), "i", "b", "x").first()) == (0, None, False)
    ranges = spark.createDataFrame([(0.5, -0.05, 0.05), (0.5, -0.2, 0.05), (0.001, -0.05, 0.05), (0.01, -0.1, 0.1), (None, 0.0, 0.0)], "p double, lo double, hi double")
    assert [r.equivalent for r in verdict.equivalent(ranges, "p", "lo", "hi", 0.1).collect()] == [True, False, False, True, False]
    cells = spark.createDataFrame([(25,), (20,), (19,)], "n long")
    assert tuple(verdict.bonferroni(cells, "n").first()) == (2, 0.025)


def test_single_linkage_chains(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        y = x + rng.gauss(0, 1)
        rows.append((x, y, y + rng.gauss(0, 1.5), -z, z, 1.0))
    got = dict(tuple(r) for r in cluster.single_linkage(spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double"), ["a", "b", "c", "d", "e", "f"], 0.6).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    with pytest.raises(ValueError):
        cluster.correlations(spark.range(1), [f"x{i}" for i in range(cluster.MOST + 1)])


def test_report_refuses_rather_than_cuts(spark):
    df = spark.createDataFrame([("a|b", 1.23456), (None, None)], "k string, v double")
    text = report.markdown("T", {"S": df})
    assert text.startswith("# T\n") and "## S" in text and "| a\\|b | 1.235 |" in text and "|  |  |" in text
    with pytest.raises(ValueError):
        report.table(spark.range(5), most=4)
