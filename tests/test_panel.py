"""Snapshot, history, signature, matching and lift operators against small cases worked out apart."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapgrain.operators import boot, delta, entropy, history, learn, match, rank, signature, snapshot, stats
from snapgrain.plans import composites  # noqa: F401
from snapgrain.plans.catalog import QUERIES
from snapgrain.sources import events

DAY = datetime.date


def test_lift_draws_against_resampled_rows(spark):
    """Each draw's AUC and lift equal those of the rows expanded by the same multiplicities; joint draws are alike in all bands."""
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(5)}", rng.randrange(2), rng.random() < 0.4, rng.randrange(4), rng.randrange(5) if rng.random() < 0.9 else None) for _ in range(120)]
    df = spark.createDataFrame(rows, "c string, band int, y boolean, size int, m int")
    names = sorted({r[0] for r in rows})

    def auc(sample):
        p, n = [s for s, y in sample if y], [s for s, y in sample if not y]
        return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else None

    for joint in (False, True):
        got = {(r.band, r.iter): r for r in boot.lift_draws(df, "c", "y", "size", ["m"], ["band"], 30, 7, joint).collect()}
        for band in (0, 1):
            for i, w in enumerate(boot.drawn(5, 30, 7 + (0 if joint else band)).tolist()):
                sample = [r for r in rows if r[1] == band and r[4] is not None for _ in range(w[names.index(r[0])])]
                want, base = auc([(r[4], r[2]) for r in sample]), auc([(r[3], r[2]) for r in sample])
                if want is None:
                    assert (band, i) not in got
                else:
                    r = got[band, i]
                    assert (r.auc, r.base_auc, r.lift) == (pytest.approx(want), pytest.approx(base), pytest.approx(want - base))
    t = boot.lift_table(df, "c", "y", "size", ["m"], ["band"], boot.lift_draws(df, "c", "y", "size", ["m"], ["band"], 30, 7), least=1).collect()
    for r in t:
        own = [x for x in rows if x[1] == r.band and x[4] is not None]
        assert (r.auc, r.level) == (pytest.approx(auc([(x[4], x[2]) for x in own])), 0.025)
    one = boot.lift_draws(df.where("y"), "c", "y", "size", ["m"], [], 5, 1)
    assert one.count() == 0
    w = boot.weight_table(spark, ["b", "a"], 4, 3).collect()
    assert [r.c for r in w[:2]] == ["a", "b"] and all(sum(r.w for r in w if r.iter == i) == 2 for i in range(4))


def test_pair_matrix_by_cells(spark):
    rng = random.Random(6)
    rows = [(i % 2, rng.randrange(4), rng.randrange(5), rng.random() < 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "b int, c int, s int, y boolean")
    got = {(r.b, r.i, r.j): r.a2 for r in boot.pair_matrix(df, "c", "s", "y", ["b"]).collect()}
    for b in (0, 1):
        for i in range(4):
            for j in range(4):
                want = sum(2 * (x[2] > z[2]) + (x[2] == z[2]) for x in rows for z in rows if x[:2] == (b, i) and x[3] and z[:2] == (b, j) and not z[3])
                assert got.get((b, i, j), 0) == want


def test_running_sums_and_bands_of_all_rows(spark):
    rng = random.Random(9)
    for n in (1, 5, 6, 7, 301):
        rows = [(rng.randrange(40), i) for i in range(n)]
        df = spark.createDataFrame(rows, "v int, o int")
        order = sorted(rows)
        got = {r.o: r.band for r in rank.rank_quartile_of_all(df, "v", "o").collect()}
        edges = [i * n // 4 for i in range(1, 4)]
        assert got == {o: sum(i >= e for e in edges) for i, (_, o) in enumerate(order)}
        h = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        assert {r.v: r.t for r in stats.running(h, [], "v", {"t": "c"}).collect()} == {v: sum(x <= v for x, _ in rows) for v, _ in rows}
        q = sorted(v for v, _ in rows)[round(0.9 * (n - 1))]
        assert rank.quantile_nearest(df, [], "v", 0.9, "q").first().q == q


def test_greedy_controls_against_the_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, i, rng.choice([0, 1, 1, 2, 3]), rng.randrange(40), rng.random() < 0.3) for i in range(160)]
    df = spark.createDataFrame(rows, "repo string, at int, ident long, files long, churn long, hit boolean").repartition(5)
    got = {r.ident: (r.control, r.cost) for r in match.greedy_controls(df, ["repo"], ["at"], "hit", 20).collect()}
    want = {}
    for repo in "ab":
        own, taken = [r for r in rows if r[0] == repo], set()
        for i, e in enumerate(own):
            if e[5] and e[3]:
                best = None
                for c in own[max(0, i - 19) : i][::-1]:  # the newest first
                    if c[5] or not c[3] or c[2] in taken:
                        continue
                    cost = 50 * abs(c[3] - e[3]) + abs(c[4] - e[4])
                    if best is None or cost < best[1]:
                        best = (c[2], cost)
                if best:
                    taken.add(best[0])
                    want[e[2]] = best
    assert got == want and len(want) > 10


def test_nearest_matches(spark):
    rng = random.Random(5)
    cases = [(i, rng.choice("xy"), DAY(2020, 1, 1 + rng.randrange(28)), rng.randrange(1, 60)) for i in range(40)]
    pool = [(100 + i, rng.choice("xz"), DAY(2020, 1, 1 + rng.randrange(28)), rng.randrange(1, 60)) for i in range(25)]
    a, b = (spark.createDataFrame(x, "id long, snap string, day date, s long") for x in (cases, pool))
    got = {r.case: (r.match, r.tier) for r in match.date_nearest(a, b, "snap", "day", "s", "id").collect()}
    for i, snap, day, s in cases:
        fits = [p for p in pool if 0.66 * s <= p[3] <= 1.5 * s]
        same = sorted((abs(p[3] - s), p[0]) for p in fits if p[1] == snap)
        near = sorted((abs((p[2] - day).days), abs(p[3] - s), p[0]) for p in fits)
        assert got.get(i) == ((same[0][1], 0) if same else (near[0][2], 1) if near else None)
    got = {r.case: (r.match, r.gap) for r in match.sorted_neighbours(a, b, ["snap"], "s", "id").collect()}
    for i, snap, _, s in cases:
        fits = sorted((abs(p[3] - s), p[3] < s, -p[0] if p[3] < s else p[0]) for p in pool if p[1] == snap and 0.66 * s <= p[3] <= 1.5 * s)
        assert got.get(i) == ((abs(fits[0][2]), fits[0][0]) if fits else None)


def joined(df) -> int:
    """Rows that the largest join of df made, after its run."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        x = plans.pop()
        name = x.nodeName()
        if "Join" in name:
            most = max(most, x.metrics().apply("numOutputRows").value())
        children = x.children()
        plans += [children.apply(i) for i in range(children.size())]
        plans += [x.executedPlan()] if name == "AdaptiveSparkPlan" else [x.plan()] if "QueryStage" in name else []
    return most


def test_date_nearest_makes_no_pairs(spark):
    rows = lambda first, n: spark.range(first, first + n).selectExpr("id", "id % 2 AS snap", "date_add(DATE'2020-01-01', CAST(id % 2 AS INT)) AS day", "40 + id % 3 AS s")
    m = match.date_nearest(rows(0, 3000), rows(10000, 3000), "snap", "day", "s", "id")
    assert m.count() == 3000 and joined(m) <= 3000
    far = match.date_nearest(rows(0, 3000).where("snap = 0"), rows(10000, 3000).where("snap = 1"), "snap", "day", "s", "id")
    assert [r.tier for r in far.select("tier").distinct().collect()] == [1] and far.count() == 1500 and joined(far) <= 1500


def test_nearest_sibling_makes_no_pairs_and_never_matches_itself(spark):
    many = lambda first: spark.range(first, first + 4000).selectExpr("id", "id % 2 AS k", "100 + id % 5 AS s")
    m = match.nearest_sibling(many(0), many(10000), ["k"], "s", "id")
    assert m.count() == 4000 and joined(m) <= 4000
    rng = random.Random(11)
    for most in (3, 9, 200):  # few idents stand at many sizes
        side = lambda n: [(rng.choice(["x", "y", None]), rng.choice([None, *range(most)]), rng.choice([None, *range(-2, 40)])) for _ in range(n)]
        cases, pool = side(60), side(40)
        cases += pool[:20]
        a, b = (spark.createDataFrame(x, "k string, id long, s long") for x in (cases, pool))
        got = {(r.k, r.case): (r.gap, r.match) for r in match.nearest_sibling(a, b, ["k"], "s", "id").collect()}
        want = {}
        for k, i, s in cases:
            fits = [(abs(t - s), m) for q, m, t in pool if k and q == k and None not in (i, s, m, t) and m != i and 0.66 * s <= t <= 1.5 * s]
            if fits:
                want[k, i] = min(want.get((k, i), min(fits)), min(fits))
        assert got == want
    with pytest.raises(ValueError):
        match.nearest_sibling(a, b, ["k"], "s", "id", 1.1)


def test_sorted_neighbours_go_once_through_a_key(spark):
    many = lambda first: spark.range(first, first + 4000).selectExpr("id", "id % 2 AS k", "100 + id % 5 AS s", "id * 3 AS own", "id * 5 AS other")
    m = match.sorted_neighbours(many(0), many(10000), ["k"], "s", "id", keep=["own"], carry=["other"])
    rows = m.collect()
    assert len(rows) == 4000 and joined(m) <= 4000 and all(r.own == 3 * r.case and r.other == 5 * r.match for r in rows)
    for df in (m, QUERIES["nearest_by_size"](spark, "/root/testdata/sf0.001"), QUERIES["q10_density_specificity"](spark, "/root/testdata/sf0.001")):
        # Spark goes again through the rest of a frame without an end for each row
        assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString()
    a, b = (spark.createDataFrame(x, "k string, id long, s long") for x in ([("x", 1, 10), (None, 2, 10), ("x", 3, None), ("x", 4, 100), ("y", 5, 10)], [("x", 7, 11), ("x", 8, 9), ("x", 9, 9), ("x", 6, 11), (None, 1, 10), ("x", 2, None)]))
    assert sorted(tuple(r) for r in match.sorted_neighbours(a, b, ["k"], "s", "id").collect()) == [("x", 1, 6, 1)]
    assert [r.match for r in match.sorted_neighbours(a, b.where("s < 10"), ["k"], "s", "id").collect()] == [9]


def test_nearest_cases_are_not_broadcast(spark):
    d = "/root/testdata/sf0.001"
    for name in ("length_matched_pairs", "nearest_by_size", "q10_density_specificity"):
        assert "BroadcastHashJoin" not in QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_date_nearest_far_and_undated(spark):
    rng = random.Random(9)
    side = lambda first, n, snaps: [(first + i, rng.choice(snaps), rng.choice([None, *range(1, 29)]), rng.choice([None, 0, 1, 2, 3, 5, 8, 13, 50, 66, 99, 100, 150, 227, 1000])) for i in range(n)]
    for snaps in ("xyzu", "xx"):
        cases, pool = side(0, 60, [*snaps, None]), side(100, 12, ["x", "v", None])
        a, b = (spark.createDataFrame([(i, p, d and DAY(2020, 1, d), s) for i, p, d, s in x], "id long, snap string, day date, s long").withColumn("own", F.col("id") * 2) for x in (cases, pool))
        got = {r.case: (r.match, r.tier, r.day_gap, r.gap, r.own) for r in match.date_nearest(a, b, "snap", "day", "s", "id", carry=["own"]).collect()}
        want = {}
        for i, snap, day, s in cases:
            fits = [p for p in pool if s and p[3] and 0.66 * s <= p[3] <= 1.5 * s]
            same = sorted((0, abs(p[3] - s), p[0]) for p in fits if snap and p[1] == snap)
            near = sorted((abs(p[2] - day), abs(p[3] - s), p[0]) for p in fits if day and p[2])
            if same or near:
                g, gap, m = (same or near)[0]
                want[i] = (m, 0 if same else 1, g, gap, 2 * m)
        assert got == want
    with pytest.raises(ValueError):
        match.date_nearest(a, b, "snap", "day", "s", "id", 1.1, 1.5)


def test_first_event_profile_reads_the_lines_before_it_matches(spark):
    plan = QUERIES["q15_first_event_profile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "Relation" not in plan


def test_snapshots_and_events(spark):
    p = spark.createDataFrame([(1, "a", 3, 1, None), (1, "b", 0, 2, 5), (2, "a2", 4, 0, 1)], "sha int, path string, loc long, risk_a long, risk_b long")
    assert [tuple(r) for r in snapshot.structural(p, ["risk_a", "risk_b"]).orderBy("sha", "path").collect()] == [(1, "a", 1, 3), (1, "b", 7, 0), (2, "a2", 1, 4)]
    assert snapshot.signal_columns(spark.createDataFrame([(1, 2, 3, 4)], "struct_a int, x int, bitwise_ops int, struct_tabs int")) == ["struct_a", "bitwise_ops"]
    revisions = spark.createDataFrame([(i,) for i in range(8)], "sha int")
    assert [(r.sha, r.idx) for r in snapshot.every_nth(revisions, "sha", 3).orderBy("sha").collect()] == [(0, 0), (3, 1), (6, 2), (7, 3)]
    assert [r.sha for r in snapshot.every_nth(revisions.limit(7), "sha", 3).orderBy("sha").collect()] == [0, 3, 6]
    ups = spark.createDataFrame([(2, 1, 0), (2, 9, 1), (1, None, 0)], "sha int, parent int, ord int")
    ev = spark.createDataFrame([(1,), (2,), (7,)], "sha int")
    assert [tuple(r) for r in snapshot.resolved(ev, ups).collect()] == [(2, 1)]
    ch = spark.createDataFrame([(1, 2, "a", "a2", "touched"), (1, 2, "b", "b", "touched"), (1, 2, "q", "q", "touched"), (1, 2, None, "n", "added")], "parent int, sha int, old_path string, new_path string, status string")
    assert {(r.old_path, r.in_child, r.in_parent) for r in snapshot.touched(ch, p).collect()} == {("a", True, True), ("b", False, True), ("q", False, False)}
    assert [tuple(r) for r in snapshot.first_present(ch, p).collect()] == [(2, "a2")]
    assert [tuple(r) for r in snapshot.first_present(ch, p.where("sha = 1")).collect()] == [(2, "b")]  # a new path comes before the old path a
    st = {r.sha: (r.status, r.n_files, r.n_left_out) for r in snapshot.event_status(ev, ch, ups.where("ord = 0"), F.col("new_path") != "q").collect()}
    assert st == {1: ("no_parent", 0, 0), 2: ("usable", 4, 1), 7: ("no_parent", 0, 0)}
    dates = snapshot.dated(ev, spark.createDataFrame([(1, "r")], "sha int, date string"), spark.createDataFrame([(1, "g"), (2, "g")], "sha int, date string"))
    assert {tuple(r) for r in dates.collect()} == {(1, "r"), (2, "g"), (7, None)}
    f = spark.createDataFrame([("f", "n", 1, 0.5), ("f", "n", 2, 0.7), ("f", "m", 3, 0.1)], "path string, name string, rowid long, rate double")
    pairs = snapshot.function_pairs(f.where("rowid <> 2"), f, ["path"], ["rate"], "rowid")
    assert {(r["name"], r.rate, r.after_rate) for r in pairs.collect()} == {("n", 0.5, 0.7), ("m", 0.1, 0.1)}


def test_history(spark):
    c = spark.createDataFrame([(i, DAY(2020, 1, 1) + datetime.timedelta(days=40 * i)) for i in range(12)], "sha int, at date")
    a = spark.createDataFrame([(DAY(2021, 1, 1),), (DAY(2020, 3, 21),)], "anchor date")
    got = sorted((str(r.anchor), r.sha) for r in history.window_before(c, a, 365, 4).collect())
    assert got == [("2020-03-21", 0), ("2020-03-21", 1), *[("2021-01-01", i) for i in (6, 7, 8, 9)]]  # nothing of the anchor's day or later
    n = spark.createDataFrame([("s", "lib/a.c", 2, 1), ("s", "docs/b.c", 9, 9), ("s", "lib/x.bin", 1, 1), ("s", "lib/b.h", None, None), ("s", "lib/d.h", 0, 4)], "sha string, path string, added long, removed long")
    assert [tuple(r) for r in history.numstat(n).collect()] == [("s", 2, 7)]
    paths = spark.createDataFrame([("lib/net/x/y.c",), ("README",), ("tests/unit1.c",), ("src/test_a.c",), ("contest/a.c",)], "p string")
    got = [tuple(r) for r in paths.select(history.area(F.col("p")), history.is_test(F.col("p"))).collect()]
    assert got == [("lib/net/", False), ("README", False), ("tests/unit1.c", True), ("src/test_a.c", False), ("contest/a.c", False)]
    s = spark.createDataFrame([(" URL: fix",), ("no area",), ("two words: x",), (": x",), (None,), ("x: y",), ("a-prefix-of-over-16: y",)], "s string")
    assert [r[0] for r in s.select(history.message_area(F.col("s"))).collect()] == ["url", None, None, None, None, None, None]
    e = spark.createDataFrame([(i, datetime.datetime(2020, 1, 1 + i % 3, i % 5)) for i in range(12)], "i int, at timestamp")
    order = [r["i"] for r in sorted(e.collect(), key=lambda r: (r["at"], r["i"]))]
    assert {r["i"]: r.order_idx for r in history.chronological(e, ["at", "i"], F.col("i") > 3).collect()} == {i: order.index(i) for i in range(4, 12)}
    t = spark.createDataFrame([("A", 1, "u", "a"), ("A", 1, "u", "b"), ("A", 2, "v", "a"), ("A", 2, "v", "c"), ("A", 3, "v", "a")], "anchor string, sha int, author string, path string")
    f = {r.path: (r.churn, r.ownership, r.scatter, r.change_entropy) for r in history.process_features(t).collect()}
    assert f == {"a": (3, 0.918296, 2, 1.0), "b": (1, 0.0, 1, 0.0), "c": (1, 0.0, 1, 0.0)}
    many = spark.createDataFrame([("A", f"p{i}", s, 5) for s, n in ((1, 4), (2, 2)) for i in range(n)], "anchor string, path string, sha int, age int")
    assert {r.path for r in entropy.flavour(many, most=3).collect()} == {"p0", "p1"}


def test_signatures(spark):
    s = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1), (0, 0, 0, 0), (-1, 2, -1, -1)], "b int, p int, a int, c int")
    assert [tuple(r)[4:] for r in signature.flags(s, *map(F.col, "bpac")).collect()] == [(True, False, True), (True, True, False), (False, False, False), (True, False, True)]
    assert [r.fix_shaped for r in signature.patch_flags(s, *map(F.col, "bpac")).collect()] == [True, False, False, True]
    d = spark.createDataFrame([(2, 4), (3, 0), (None, 2)], "x int, loc int")
    assert [tuple(r) for r in d.select(signature.density(["x"], "loc"), signature.density(["x"], "loc", False), signature.guard_rate(["x"], ["loc"])).collect()] == [(0.5, 0.5, 0.4), (None, 3.0, 3.0), (0.0, 0.0, 0.0)]
    c = {r.column: r.share for r in signature.coverage(d, ["x", "loc"]).collect()}
    assert c == {"x": pytest.approx(2 / 3), "loc": pytest.approx(2 / 3)}
    g = signature.group_summary(spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", None), ("b", None)], "k string, v double"), ["k"], "v").collect()
    assert [tuple(r) for r in g] == [("a", 2, 0.0, 0.5)]
    best = signature.argmax(spark.createDataFrame([("g", "u", None), ("g", "w", 1.0), ("g", "v", 1.0), ("h", "z", None)], "g string, n string, x double"), ["g"], "n", "x")
    assert {tuple(r) for r in best.collect()} == {("g", "v", 1.0), ("h", "z", None)}
    comp = signature.composition(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "g string, x int"), "g", "x", 0.5)
    assert {(r.g, r.x, r.n, round(r.lift, 6)) for r in comp.collect()} == {("a", 1, 2, 1.333333), ("b", 2, 1, 2.0)}


def test_records_and_split_means(spark):
    a = spark.createDataFrame([("f", 1, None), ("g", 2, 2)], "path string, x long, y long")
    b = spark.createDataFrame([("f", 4, 3), ("h", 1, 1)], "path string, x long, y long")
    got = {r.path: json.loads(r.record) for r in delta.pair_record(a, b, ["path"], ["x", "y"]).collect()}
    assert got["f"] == {"before": {"x": 1}, "after": {"x": 4, "y": 3}, "delta": {"x": 3}} and got["g"]["delta"] == {} and "before" not in got["h"]
    n = events.nested_sample(a, b, ["path"], ["x", "y"]).first()
    assert (n.before, n.after, n.delta) == ({"x": 1.0, "y": None}, {"x": 4.0, "y": 3.0}, {"x": 3.0, "y": 3.0})


def test_classifier(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, float(i % 3) + rng.gauss(0, 0.2), rng.gauss(0, 1), 0.0, DAY(2021, 1, 1) if i < 90 else DAY(2023, 1, 1) if i < 118 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double, still double, day date")
    train, test, undated = learn.temporal_parts(df, "day", "2022-01-01")
    assert (train.count(), test.count(), undated) == (90, 28, 2)
    assert learn.active(train, ["a", "b", "still"]) == ["a", "b"]
    f = learn.folds(train, "label", "id").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in f} == {6} and learn.folds(train, "label", "id").orderBy("id").collect() == learn.folds(train.repartition(3), "label", "id").orderBy("id").collect()
    best, means = learn.select_penalty(train, ["a", "b"], "label", "id", (0.1, 100.0), 2)
    assert best == 0.1 and means[0.1] > 0.9
    z, _ = learn.standardised(train, test, ["a", "b"])
    model = learn.fit_multinomial(z, ["a", "b"], "label", 1.0)
    # the gradient of the penalised likelihood is 0 at the solution
    x, y = np.array([[r.a, r.b] for r in z.collect()]), np.array([r.label for r in z.collect()])
    w, b0 = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    e = np.exp(x @ w.T + b0)
    grad = (e / e.sum(1, keepdims=True) - np.eye(3)[y]).T @ x / len(x) + w / len(x)
    assert np.abs(grad).max() < 1e-5
    c = learn.contrasts(model, ["a", "b"], [1, 2], 0)
    assert c[0][0] == "a" and c[0][1] == pytest.approx(w[1:, 0].mean() - w[0, 0])
    assert {r.label for r in learn.collapsed(train, "label", [1, 2]).select("label").distinct().collect()} == {0, 1}


def test_stores(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    scans = spark.createDataFrame([("r", "c1", "f", 1), ("r", "c1", "g", 1), ("r", "c2", "f", 2)], "repo_name string, commit_hash string, file_path string, loc long")
    wanted = spark.createDataFrame([("r", "c1"), ("r", "c2"), ("r", "c3")], "repo_name string, commit_hash string")
    first = {r.commit_hash: r.status for r in events.add_scans(wanted.where("commit_hash <> 'c2'"), scans, path("panel"), path("reg")).collect()}
    again = {r.commit_hash: r.status for r in events.add_scans(wanted, scans, path("panel"), path("reg")).collect()}
    assert first == {"c1": "added", "c3": "missing"} and again == {"c1": "skipped", "c2": "added", "c3": "missing"}
    assert spark.read.parquet(path("panel")).count() == 3 and spark.read.parquet(path("reg")).count() == 2
    calls = []

    def square(keys):
        calls.append(keys.count())
        return keys.withColumn("x", F.col("k") * F.col("k"))

    keys = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    assert sorted(r.x for r in events.cached(keys, square, path("cache"), ["k"]).collect()) == [1, 4]
    assert sorted(r.x for r in events.cached(spark.createDataFrame([(2,), (3,)], "k long"), square, path("cache"), ["k"]).collect()) == [4, 9] and calls == [0, 2, 0, 1]
    tables = {"file_data": spark.createDataFrame([(1, "c1", "f"), (2, "c2", "g")], "id long, commit_hash string, path string"), "repo_data": spark.createDataFrame([("c1", "d"), ("c2", "d")], "commit_hash string, date string"), "function_data": spark.createDataFrame([(1, "n"), (2, "m"), (2, "o")], "file_id long, name string")}
    n = events.subset(tables, spark.createDataFrame([("c2",)], "commit_hash string"), path("sub"))
    assert n == {"file_data": 1, "repo_data": 1, "function_data": 2} and spark.read.parquet(path("sub/file_data")).columns == ["id", "commit_hash", "path"]
    grain = spark.createDataFrame([("r", "e")], "repo string, id string")
    m = events.export_dataset({"event": grain, "file_sample": grain.withColumn("file_path", F.lit("p")), "function_sample": grain}, path("out"), spark.createDataFrame([("no parent",), ("no parent",)], "reason string"))
    assert m["grains"]["event"]["rows"] == 1 and m["skipped"] == {"no parent": 2} and json.loads(spark.read.text(path("out/manifest")).first()[0]) == m
    assert {(r.kind, r.rows, r.bad_json, r.missing) for r in events.schema_check(spark, path("out")).collect()} == {("event", 1, 0, 0), ("file_sample", 1, 0, 0), ("function_sample", 1, 0, 1)}


def test_listings(spark, tmp_path):
    lines = spark.createDataFrame([(1, "M\ta b.c"), (1, "A\tn.c"), (1, "D\td.c"), (1, "R087\told.c\tnew.c"), (1, ""), (1, "R1\tx")], "ev int, t string")
    got = [tuple(r)[1:] for r in events.read_name_status(lines, ["ev"], "t").collect()]
    assert got == [("a b.c", "a b.c", "touched", False), (None, "n.c", "added", False), ("d.c", None, "deleted", False), ("old.c", "new.c", "touched", True)]
    n = spark.createDataFrame([("3\t1\ta.c",), ("-\t-\tb.png",), ("x",)], "t string")
    assert [tuple(r) for r in events.read_numstat(n, [], "t").collect()] == [("a.c", 3, 1), ("b.png", None, None)]
    log = ["p0", "@@|s1|86400|An Author|x", "", "a.c", " b.c", "@@|s2|0|B", "c.c"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(log)], "file string, line int, t string")
    assert {(r.sha, r.author, r.path) for r in events.read_log(df, "t").collect()} == {("s1", "An Author|x", "a.c"), ("s1", "An Author|x", "b.c"), ("s2", "B", "c.c")}
    walk = {"repo": "r", "mode": "tags", "revisions": [{"ref": "v1", "sha": "s", "date": "2020-01-02T03:04:05", "status": "ok"}, {"ref": "v2", "sha": "t", "date": "2021-01-02", "status": "ok"}]}
    (tmp_path / "w.json").write_text(json.dumps(walk))
    assert [(r.idx, r.sha, str(r.date)) for r in events.read_walk(spark, str(tmp_path / "w.json")).collect()] == [(0, "s", "2020-01-02"), (1, "t", "2021-01-02")]
    entry = lambda i: {"id": i, "summary": None, "affected": []}
    (tmp_path / "1.json").write_text(json.dumps({"vulns": [entry("a"), entry("b")], "next_page_token": "2"}))
    with pytest.raises(ValueError):
        events.read_feed(spark, [str(tmp_path / "1.json")])
    (tmp_path / "2.json").write_text(json.dumps({"vulns": [entry("b"), entry("c")]}))
    assert sorted(r.id for r in events.read_feed(spark, [str(tmp_path / f"{i}.json") for i in (1, 2)]).collect()) == ["a", "b", "c"]
