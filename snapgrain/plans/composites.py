"""Composite analyses: from the panel or the labelled texts to a table that ends in a verdict.

Bindings are those of ``panel``; labelled texts stand for pooled observations: good ones are positive, the number of
characters is the size that a measure must beat, and the source is the cluster that is drawn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as tails
from ..functions.lineage import cut
from ..operators import boot, delta, entropy, history, match, rank, signature, snapshot, stats, verdict
from ..operators import panel as windows
from .catalog import AUC, LONG_RUNS, MONTHS, RENAMED, SCORED, _hcm_sql, _sides, _touches, months, query, rounded, scored, table, trajectories
from .panel import CHANGE, DELTA, PANEL, PROCESS, RISKS, SIGNALS, change, deltas, event_stats, flagged, panel, parents, touches

DRAWS, SEED, SOURCES = 5000, 2982, 20
MEASURES = ["n_words", "n_stops"]


def banded(spark, d) -> DataFrame:
    return rank.rank_quartile_of_all(scored(spark, d), "n_chars", "doc_id")


BANDED = SCORED + ", s AS (SELECT *, CAST(least(3, (4 * row_number() OVER (ORDER BY n_chars, doc_id) - 1) // count(*) OVER ()) AS INTEGER) AS band FROM scored), k AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM s))"


def weights_sql(bands: int, joint: bool, draws: int = DRAWS) -> str:
    """The seeded draws of the sources as a table w (band, iter, digits): a digit for each source in order."""
    rows = []
    for b in range(bands):
        w = boot.drawn(SOURCES, draws, SEED + (0 if joint else b))
        assert w.max() < 10
        rows += [f"({b},{i},'{''.join(map(str, x))}')" for i, x in enumerate(w.tolist())]
    return f"w AS (SELECT * FROM (VALUES {','.join(rows)}) v(band, iter, digits))"


def draws_sql(band: str, measures=MEASURES, base: str = "n_chars") -> str:
    """Tables after s, k and w: l (band, measure, iter, auc, base_auc, lift) of each draw, o of the sample itself."""
    long = " UNION ALL ".join(f"SELECT {band} AS band, source, good, '{m}' AS measure, {m} AS score FROM s" for m in [*measures, base])
    return f"""g AS ({long}), x AS (SELECT band, measure, iter, score, sum(w) FILTER (good) AS p, sum(w) FILTER (NOT good) AS n FROM (SELECT g.band, measure, iter, score, good, CAST(substr(digits, CAST(k AS INTEGER), 1) AS INTEGER) AS w FROM g JOIN k USING (source) JOIN w ON w.band = g.band) GROUP BY 1, 2, 3, 4),
    y AS (SELECT band, measure, iter, coalesce(p, 0) AS p, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY band, measure, iter ORDER BY score) - coalesce(n, 0) AS below FROM x),
    a AS (SELECT band, measure, iter, CAST(sum(p * (2 * below + n)) AS DOUBLE) / (2.0 * sum(p) * sum(n)) AS auc FROM y GROUP BY 1, 2, 3 HAVING sum(p) > 0 AND sum(n) > 0),
    l AS (SELECT band, a.measure, iter, a.auc, b.auc AS base_auc, a.auc - b.auc AS lift FROM a JOIN a b USING (band, iter) WHERE a.measure <> '{base}' AND b.measure = '{base}'),
    h AS (SELECT band, measure, score, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS n FROM g GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER (PARTITION BY band, measure ORDER BY score) - n AS below FROM h),
    q AS (SELECT band, measure, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS auc FROM c GROUP BY 1, 2),
    o AS (SELECT band, q.measure, q.n_pos, q.n_neg, q.auc, b.auc AS base_auc, q.auc - b.auc AS lift FROM q JOIN q b USING (band) WHERE q.measure <> '{base}' AND b.measure = '{base}')"""


def verdict_sql(cells: int) -> str:
    """Table r (o with low, n_valid, level and verdict).  The level depends on the powered cells, and a quantile takes a constant: one case for each number of them."""
    quantile = "CASE any_value(powered) " + " ".join(f"WHEN {i} THEN quantile_cont(lift, {0.05 / i!r})" for i in range(1, cells + 1)) + " END"
    return f"""z AS (SELECT greatest(count(*) FILTER (n_pos >= 20), 1) AS powered FROM o), lows AS (SELECT band, measure, {quantile} AS low, count(*) AS n_valid FROM l, z GROUP BY 1, 2),
    r AS (SELECT o.*, low, coalesce(n_valid, 0) AS n_valid, 0.05 / powered AS level, CASE WHEN n_pos < 20 THEN 'UNDERPOWERED' WHEN auc > 0.5 AND lift > 0 AND low > 0 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict FROM o CROSS JOIN z LEFT JOIN lows USING (band, measure))"""


ROUNDED = "round(auc, 6) AS auc, round(base_auc, 6) AS base_auc, round(lift, 6) AS lift, round(low, 6) AS low, n_valid, round(level, 8) AS level, verdict"


def lifts(rows: DataFrame, bands: list[str], joint: bool = False, cluster: str = "source", measures=MEASURES, base: str = "n_chars", positive: str = "good") -> DataFrame:
    d = boot.lift_draws(rows, cluster, positive, base, list(measures), bands, DRAWS, SEED, joint)
    t = boot.lift_table(rows, cluster, positive, base, list(measures), bands, d)
    return rounded(rounded(t, "auc", "base_auc", "lift", "low"), "level", digits=8).persist()  # a row a cell


@query(f"WITH {BANDED}, {weights_sql(4, False)}, {draws_sql('band')}, {verdict_sql(8)} SELECT band, measure, n_pos, n_neg, {ROUNDED} FROM r")
def boot_lift(spark, d):
    """Lift of each measure over size within each band of equal count: 5000 seeded draws of the sources, a seed a band."""
    return lifts(cut(banded(spark, d)), ["band"])


@query(f"WITH {BANDED}, {weights_sql(1, True)}, {draws_sql('0')}, {verdict_sql(2)} SELECT measure, n_pos, n_neg, {ROUNDED} FROM r")
def boot_paired_lift(spark, d):
    """The pooled lift: measure and size on the same 5000 draws."""
    return lifts(scored(spark, d), [])


MONOTONE = "i AS (SELECT measure, iter, lift, lift >= lag(lift) OVER (PARTITION BY measure, iter ORDER BY band) AS up FROM l), m AS (SELECT measure, iter, count(*) FILTER (up) AS ups FROM i GROUP BY 1, 2 HAVING count(*) = 4), v AS (SELECT measure, count(iter) AS n_valid, avg(CAST(ups = 0 AS INTEGER)) AS share FROM (SELECT DISTINCT measure FROM o) LEFT JOIN m USING (measure) GROUP BY 1)"


def monotone(rows, measure):
    draws = boot.lift_draws(rows, "source", "good", "n_chars", [measure], ["band"], DRAWS, SEED, True)
    return verdict.monotone_share(draws, "iter", "band", "lift").withColumn("measure", F.lit(measure))


@query(f"WITH {BANDED}, {weights_sql(4, True)}, {draws_sql('band')}, {MONOTONE} SELECT measure, n_valid, round(share, 6) AS share, coalesce(share >= 0.99, false) AS supported FROM v")
def boot_joint_lift(spark, d):
    """Whether lifts fall from band to band, on draws that all bands share."""
    rows = cut(banded(spark, d))
    return rounded(reduce(DataFrame.unionByName, [monotone(rows, m) for m in MEASURES]), "share")


@query(f"""WITH {SCORED}, t AS (SELECT *, doc_id % 3 AS part FROM scored), long AS (SELECT part || ':' || m AS feature, CASE m WHEN 'n_chars' THEN n_chars WHEN 'n_words' THEN n_words ELSE n_stops END AS score, good FROM t, (VALUES ('n_chars'), ('n_words'), ('n_stops')) v(m)), {AUC}, a AS (SELECT split_part(feature, ':', 1) AS part, split_part(feature, ':', 2) AS m, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1, 2)
    SELECT CAST(a.part AS BIGINT) AS part, a.m AS measure, round(a.auc, 6) AS auc, round(a.auc - b.auc, 6) AS lift FROM a JOIN a b ON a.part = b.part AND b.m = 'n_chars'""")
def defect_lift(spark, d):
    """AUC of each measure minus that of size, in three parts of the texts."""
    t = scored(spark, d).withColumn("part", F.col("doc_id") % 3)
    a = stats.auc(t.unpivot(["part", "good"], ["n_chars", "n_words", "n_stops"], "measure", "score"), "score", "good", ["part", "measure"])
    base = a.where("measure = 'n_chars'").select("part", F.col("auc").alias("_b"))
    return a.join(base, "part").select("part", "measure", F.round("auc", 6).alias("auc"), F.round(F.col("auc") - F.col("_b"), 6).alias("lift"))


FAMILIES = ("n_chars", "n_words", "n_stops")
FAMILY_SQL = " UNION ALL ".join(f"SELECT '{f}:{m}' AS feature, {m} AS score, doc_id % 3 = {i} AS good FROM scored WHERE NOT good OR doc_id % 3 = {i}" for i, f in enumerate(FAMILIES) for m in FAMILIES)


@query(f"""WITH {SCORED}, long AS ({FAMILY_SQL}), {AUC}, a AS (SELECT split_part(feature, ':', 1) AS family, split_part(feature, ':', 2) AS signals, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY auc DESC NULLS LAST, signals) AS rn FROM a)
    SELECT family, signals, round(auc, 6) AS auc, rn = 1 AS best, family = signals AND rn = 1 AS diagonal FROM b""")
def discriminant_square(spark, d):
    """Each family of positives against the controls by each family's signals, and whether a family's own signals tell it best."""
    s = scored(spark, d)
    sets = [s.where(~F.col("good") | (F.col("doc_id") % 3 == i)).withColumn("family", F.lit(f)).withColumn("hit", F.col("doc_id") % 3 == i) for i, f in enumerate(FAMILIES)]
    long = reduce(DataFrame.unionByName, sets).unpivot(["family", "hit"], list(FAMILIES), "signals", "score")
    a = stats.auc(long, "score", "hit", ["family", "signals"]).select("family", "signals", "auc")
    best = signature.argmax(a, ["family"], "signals", "auc").select("family", F.col("signals").alias("_best"))
    top = F.col("signals") == F.col("_best")
    return a.join(best, "family").select("family", "signals", F.round("auc", 6).alias("auc"), top.alias("best"), (top & (F.col("family") == F.col("signals"))).alias("diagonal"))


# --- Q3: which order of reading finds the touched files within a budget ------------------------------------------------

REVIEW = CHANGE + """, t AS (SELECT DISTINCT sha AS event, old_path AS path FROM change WHERE status = 'touched'),
    o0 AS (SELECT q.sha AS event, p.path, p.loc, coalesce(p.risk_debt, 0) + coalesce(p.risk_safety, 0) AS exposure, t.path IS NOT NULL AS hit FROM parents q JOIN panel p ON p.sha = q.parent LEFT JOIN t ON t.event = q.sha AND t.path = p.path),
    o AS (SELECT *, coalesce(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY path ORDER BY event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, dense_rank() OVER (ORDER BY event) - 1 AS idx FROM o0),
    u AS (SELECT event, idx, path, loc, hit, 'exposure' AS score, exposure AS v FROM o UNION ALL SELECT event, idx, path, loc, hit, 'loc', loc FROM o UNION ALL SELECT event, idx, path, loc, hit, 'prior', prior FROM o),
    b AS (SELECT *, coalesce(sum(loc) OVER (PARTITION BY event, score ORDER BY v DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(loc) OVER (PARTITION BY event, score) AS taken FROM u),
    r AS (SELECT event, idx, score, count(*) FILTER (taken AND hit) / count(*) FILTER (hit) AS recall FROM b GROUP BY 1, 2, 3 HAVING count(*) FILTER (hit) > 0),
    h AS (SELECT score, v, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM u SEMI JOIN r USING (event) GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY score ORDER BY v) - n AS below FROM h),
    a AS (SELECT score, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1), m AS (SELECT score, count(*) AS n_events, median(recall) AS recall FROM r GROUP BY 1),
    k AS (SELECT x.score, count(*) FILTER (x.recall > y.recall) AS wins, count(*) FILTER (x.recall < y.recall) AS losses FROM r x JOIN r y ON x.event = y.event AND y.score = 'loc' WHERE x.score <> 'prior' OR x.idx >= 5 GROUP BY 1)"""


def review(spark, d) -> DataFrame:
    """(event, idx, path, loc, exposure, prior, hit): the files of each event's parent; prior counts the earlier events that touched a file, which are known only after their evaluation."""
    p, up = panel(spark, d), parents(spark, d)
    own = p.select("sha", "path", "loc", snapshot.total(RISKS).alias("exposure"))
    before = own.join(F.broadcast(up.where("parent is not null").select(F.col("parent").alias("sha"), F.col("sha").alias("event"))), "sha").drop("sha")
    hit = change(p, up).where("status = 'touched'").select(F.col("sha").alias("event"), F.col("old_path").alias("path"), F.lit(True).alias("hit")).distinct()
    o = before.join(hit, ["event", "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    earlier = Window.partitionBy("path").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    events = o.select("event").distinct().withColumn("idx", F.row_number().over(Window.orderBy("event")) - 1)  # a row an event
    return o.withColumn("prior", F.coalesce(F.sum(F.col("hit").cast("long")).over(earlier), F.lit(0))).join(F.broadcast(events), "event")


@query(f"WITH {REVIEW} SELECT score, n_events, round(recall, 6) AS recall, round(auc, 6) AS auc, wins, losses, CASE WHEN wins + losses = 0 THEN 'UNDEFINED' WHEN wins > losses THEN 'AHEAD OF SIZE' ELSE 'NOT AHEAD' END AS verdict FROM m JOIN a USING (score) JOIN k USING (score)")
def q3_review_budget(spark, d):
    """Exposure, size and prior events as orders of review: median recall within a fifth of the lines, pooled AUC, and wins against size, for prior events once five events have passed."""
    u = review(spark, d).unpivot(["event", "idx", "path", "loc", "hit"], ["exposure", "loc", "prior"], "score", "v")
    r = stats.budget_recall(u, ["event", "idx", "score"], "v", "path", "loc", "hit").where("n_pos > 0").select("event", "idx", "score", "recall")
    a = stats.auc(u.join(r.select("event").distinct(), "event", "left_semi"), "v", "hit", ["score"]).select("score", "auc")
    m = r.groupBy("score").agg(F.count(F.lit(1)).alias("n_events"), F.median("recall").alias("recall"))
    size = r.where("score = 'loc'").select("event", F.col("recall").alias("_size"))
    k = r.where("score <> 'prior' or idx >= 5").join(size, "event").groupBy("score").agg(F.count_if(F.col("recall") > F.col("_size")).alias("wins"), F.count_if(F.col("recall") < F.col("_size")).alias("losses"))
    t = m.join(a, "score").join(k, "score")
    said = F.when(F.col("wins") + F.col("losses") == 0, "UNDEFINED").when(F.col("wins") > F.col("losses"), "AHEAD OF SIZE").otherwise("NOT AHEAD")
    return rounded(t.withColumn("verdict", said), "recall", "auc")


# --- Q5: which variant of change entropy beats size --------------------------------------------------------------------

SWEEP = _hcm_sql() + """, pos AS (SELECT DISTINCT anchor, l_partkey AS path FROM lineitem, (SELECT DISTINCT anchor FROM t0) WHERE l_quantity > 45 AND date_diff('day', anchor, CAST(l_shipdate AS DATE)) BETWEEN 31 AND 120),
    size AS (SELECT anchor, path, count(*) AS loc FROM t0 GROUP BY 1, 2), ob AS (SELECT h.variant || '_' || h.length AS feature, round(h.value, 9) AS score, pos.path IS NOT NULL AS good FROM hcm h LEFT JOIN pos USING (anchor, path) UNION ALL SELECT 'loc', loc, pos.path IS NOT NULL FROM size LEFT JOIN pos USING (anchor, path)), long AS (SELECT * FROM ob)"""
VARIANTS = [f"{a}_{w}_{n}" for n in entropy.LENGTHS for a in entropy.ATTRIBUTION for w in entropy.DECAY]


def observations(spark, d) -> DataFrame:
    """(anchor, path, loc, good, the 36 variants): files with changes before each anchor; good ones get a large line in the months after."""
    t = _touches(spark, d)
    v = entropy.change_entropy_variants(t.select("anchor", "path", "age")).withColumn("name", F.concat_ws("_", "variant", F.col("length").cast("string")))
    wide = v.groupBy("anchor", "path").agg(*[F.max(F.when(F.col("name") == n, F.round("value", 9))).alias(n) for n in VARIANTS])
    size = t.groupBy("anchor", "path").agg(F.count(F.lit(1)).alias("loc"))
    days = t.select("anchor").distinct()
    late = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("path"), F.to_date("l_shipdate").alias("day")).distinct()
    late = late.withColumn("_y", F.explode(F.sequence(F.year("day") - 1, F.year("day")))).join(F.broadcast(days.withColumn("_y", F.year("anchor"))), "_y")
    good = late.where(F.datediff("day", "anchor").between(31, 120)).select("anchor", "path", F.lit(True).alias("good")).distinct()
    return wide.join(size, ["anchor", "path"]).join(good, ["anchor", "path"], "left").withColumn("good", F.coalesce("good", F.lit(False)))


def sweep(o: DataFrame) -> DataFrame:
    """(variant, n_pos, n_neg, auc, lift, place) of the 36 variants against size, the largest lift first; undefined ones come last."""
    long = o.select("good", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("score")) for c in [*VARIANTS, "loc"]])))
    a = stats.auc(long, "score", "good", ["feature"])
    base = a.where("feature = 'loc'").select(F.col("auc").alias("_b"), F.lit(1).alias("_one"))
    r = a.where("feature <> 'loc'").withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").withColumn("lift", F.round(F.col("auc") - F.col("_b"), 6))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.col("lift").desc_nulls_last(), "feature"))).select(F.col("feature").alias("variant"), "n_pos", "n_neg", F.round("auc", 6).alias("auc"), "lift", "place")  # 36 rows


@query(f"""WITH {SWEEP}, {AUC}, a AS (SELECT feature, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1), r AS (SELECT a.feature AS variant, a.n_pos, a.n_neg, round(a.auc, 6) AS auc, round(a.auc - b.auc, 6) AS lift FROM a JOIN a b ON b.feature = 'loc' WHERE a.feature <> 'loc')
    SELECT *, row_number() OVER (ORDER BY lift DESC, variant) AS place FROM r""")
def entropy_sweep(spark, d):
    return sweep(observations(spark, d))


@query()
def q5_entropy_sweep(spark, d):
    """The five best variants and a named one, tested within bands of size by 5000 draws of the anchors; a variant clears with three bands of four."""
    o = cut(rank.rank_quartile_of_all(cut(observations(spark, d)), "loc", "path", "anchor"))
    ranked = cut(sweep(o))  # 36 rows
    best = [r["variant"] for r in ranked.where("place <= 5").orderBy("place").collect()]
    names = list(dict.fromkeys([*best, "weighted_none_90"]))
    t = cut(lifts(o, ["band"], cluster="anchor", measures=names, base="loc"))
    head = verdict.band_headline(t.withColumn("yes", F.col("verdict") == "SUPPORTED"), ["measure"], "yes")
    return t.join(head, "measure").join(ranked.select(F.col("variant").alias("measure"), "place"), "measure").withColumn("conclusion", F.when(F.col("clears"), "SUPPORTED").otherwise("NOT SUPPORTED"))


# --- Q6: measures within bands of size, by two schemes -----------------------------------------------------------------

EDGES = (200, 600, 1500)
SCHEMES = BANDED.replace(", k AS (", f", s2 AS (SELECT * REPLACE (CAST(CASE WHEN n_chars <= {EDGES[0]} THEN 4 WHEN n_chars <= {EDGES[1]} THEN 5 WHEN n_chars <= {EDGES[2]} THEN 6 ELSE 7 END AS INTEGER) AS band) FROM s), k AS (")


@query(f"WITH {SCHEMES.replace(', s AS (', ', s1 AS (', 1).replace('FROM s), k', 'FROM s1), s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), k')}, {weights_sql(8, False)}, {draws_sql('band')}, {verdict_sql(16)} SELECT CASE WHEN band < 4 THEN 'rank' ELSE 'absolute' END AS scheme, CAST(band % 4 AS INTEGER) AS band, measure, n_pos, n_neg, {ROUNDED}, count(*) FILTER (verdict = 'SUPPORTED') OVER (PARTITION BY band >= 4, measure) >= 3 AS clears FROM r")
def q6_centrality_bands(spark, d):
    """Two schemes of four bands, each measure in each band: sample AUC, lift, its bound at the level of the whole family, verdict, and whether a measure clears three bands of a scheme."""
    ranked = banded(spark, d)
    fixed = scored(spark, d).withColumn("band", (rank.absolute_band(F.col("n_chars"), EDGES) + 4).cast("int"))
    t = lifts(cut(ranked.unionByName(fixed)), ["band"]).withColumn("scheme", F.when(F.col("band") < 4, "rank").otherwise("absolute")).withColumn("band", (F.col("band") % 4).cast("int"))
    head = verdict.band_headline(t.withColumn("yes", F.col("verdict") == "SUPPORTED"), ["scheme", "measure"], "yes").select("scheme", "measure", "clears")
    return t.join(head, ["scheme", "measure"])


# --- Q7: three hypotheses about the labels -----------------------------------------------------------------------------


@query(f"""WITH {BANDED}, {weights_sql(4, True)}, {draws_sql('band')}, {verdict_sql(8)}, {MONOTONE}
    SELECT 'bands' AS hypothesis, measure, CAST(count(*) FILTER (verdict = 'SUPPORTED') AS DOUBLE) AS evidence, CASE WHEN count(*) FILTER (verdict = 'SUPPORTED') >= 3 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict FROM r GROUP BY 1, 2
    UNION ALL SELECT 'monotone', measure, round(share, 6), CASE WHEN share >= 0.99 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END FROM v
    UNION ALL SELECT 'direction', measure, CAST(count(*) FILTER (auc > 0.5) AS DOUBLE), CASE WHEN count(*) FILTER (auc > 0.5) = count(*) THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END FROM r GROUP BY 1, 2""")
def q7_label_evaluation(spark, d):
    """Bands: a measure beats size in three bands of four.  Monotone: its lifts fall from band to band in 99 % of joint draws.  Direction: its AUC is above a half in each band."""
    rows = cut(banded(spark, d))
    t = lifts(rows, ["band"], joint=True)
    yes = lambda c: F.when(c, "SUPPORTED").otherwise("NOT SUPPORTED").alias("verdict")
    n = F.col("n_supported")
    first = verdict.band_headline(t.withColumn("yes", F.col("verdict") == "SUPPORTED"), ["measure"], "yes").select(F.lit("bands").alias("hypothesis"), "measure", n.cast("double").alias("evidence"), yes(F.col("clears")))
    draws = boot.lift_draws(rows, "source", "good", "n_chars", MEASURES, ["band"], DRAWS, SEED, True)
    shares = [verdict.monotone_share(draws.where(F.col("measure") == m), "iter", "band", "lift").select(F.lit("monotone").alias("hypothesis"), F.lit(m).alias("measure"), F.round("share", 6).alias("evidence"), yes(F.col("supported"))) for m in MEASURES]
    third = verdict.band_headline(t.withColumn("yes", F.col("auc") > 0.5), ["measure"], "yes").select(F.lit("direction").alias("hypothesis"), "measure", n.cast("double").alias("evidence"), yes(F.col("all_bands")))
    return reduce(DataFrame.unionByName, [first, *shares, third])


# --- Q1: what changes do to exposure -----------------------------------------------------------------------------------

EXPOSURE = DELTA + """, ev AS (SELECT sha, CASE sha % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'introduced' ELSE 'control' END AS class, avg(structural) AS mean, avg(loc) AS mean_loc FROM d WHERE touched GROUP BY 1),
    rk AS (SELECT *, rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0 AS mr, count(*) OVER (PARTITION BY mean) AS t FROM ev WHERE class <> 'introduced'),
    mw AS (SELECT CAST(count(*) FILTER (class = 'fix') AS DOUBLE) AS n1, CAST(count(*) FILTER (class = 'control') AS DOUBLE) AS n2, CAST(sum(mr) FILTER (class = 'fix') AS DOUBLE) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM rk),
    z AS (SELECT (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 + 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM mw),
    pc AS (SELECT q.sha, p.path, 100 * percent_rank() OVER (PARTITION BY q.sha ORDER BY coalesce(p.risk_debt, 0) + coalesce(p.risk_safety, 0)) AS pct FROM parents q JOIN panel p ON p.sha = q.parent),
    tg AS (SELECT class, avg(pct) AS pct FROM pc JOIN (SELECT DISTINCT sha, old_path AS path FROM change WHERE status = 'touched') USING (sha, path) JOIN ev USING (sha) GROUP BY 1)"""


def classes(column):
    return F.when(column % 3 == 0, "fix").when(column % 3 == 1, "introduced").otherwise("control")


@query(f"""WITH {EXPOSURE}, c AS (SELECT class, count(*) AS n, median(mean) AS mid, median(mean_loc) AS mid_loc, count(*) FILTER (mean < 0) AS down, count(*) FILTER (mean > 0) AS up FROM ev GROUP BY 1)
    SELECT class, n, round(mid, 6) AS median, round(mid_loc, 6) AS median_loc, down, up, round(pct, 6) AS target_pct, CASE WHEN class = 'fix' THEN round(z, 6) END AS z, CASE WHEN class <> 'fix' THEN 'REFERENCE' WHEN z < -1.6448536269514722 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict FROM c JOIN tg USING (class) CROSS JOIN z""")
def q1_exposure_report(spark, d):
    """Events by class: median of their mean change of exposure and of size, signs, how exposed the touched files were before, and whether fixes lower exposure more than controls do (one-sided rank test at 5 %)."""
    x = deltas(spark, d).where("touched")
    ev = x.groupBy("sha").agg(F.avg("structural").alias("mean"), F.avg("loc").alias("mean_loc")).withColumn("class", classes(F.col("sha"))).persist()
    c = ev.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.median("mean").alias("median"), F.median("mean_loc").alias("median_loc"), F.count_if(F.col("mean") < 0).alias("down"), F.count_if(F.col("mean") > 0).alias("up"))
    z = stats.mann_whitney(ev.where("class <> 'introduced'").withColumn("first", F.col("class") == "fix"), "mean", "first").select(F.lit("fix").alias("class"), "z")
    p, up = panel(spark, d), parents(spark, d)
    before = p.select("sha", "path", snapshot.total(RISKS).alias("exposure")).join(F.broadcast(up.where("parent is not null").select(F.col("parent").alias("sha"), F.col("sha").alias("event"))), "sha").drop("sha")
    hit = change(p, up).where("status = 'touched'").select(F.col("sha").alias("event"), F.col("old_path").alias("path")).distinct()
    target = rank.percentile_within(before, ["event"], "exposure").join(hit, ["event", "path"]).join(ev.select(F.col("sha").alias("event"), "class"), "event").groupBy("class").agg(F.avg("pct").alias("target_pct"))
    t = c.join(target, "class").join(z, "class", "left")
    said = F.when(F.col("class") != "fix", "REFERENCE").when(F.col("z") < -1.6448536269514722, "SUPPORTED").otherwise("NOT SUPPORTED")
    return rounded(t.withColumn("verdict", said), "median", "median_loc", "target_pct", "z")


# --- Q2: what signals move in fixes ------------------------------------------------------------------------------------

ANATOMY = DELTA + ", e AS (SELECT sha, sha % 3 = 0 AS fix, " + ", ".join(f"avg({s}) AS mean_{s}, CAST(sum({s}) AS BIGINT) AS sum_{s}" for s in SIGNALS) + " FROM d WHERE touched AND sha % 3 <> 1 GROUP BY 1), long AS (" + " UNION ALL ".join(f"SELECT '{s}' AS feature, round(mean_{s}, 9) AS score, fix AS good FROM e" for s in SIGNALS) + f"), {AUC}"


@query(f"""WITH {ANATOMY}, a AS (SELECT feature, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1), m AS (SELECT feature, avg(CAST(score <> 0 AS INTEGER)) FILTER (good) AS moved_fix, avg(CAST(score <> 0 AS INTEGER)) FILTER (NOT good) AS moved_control FROM long GROUP BY 1)
    SELECT feature AS signal, n_pos, n_neg, round(auc, 6) AS auc, round(moved_fix, 6) AS moved_fix, round(moved_control, 6) AS moved_control, row_number() OVER (ORDER BY round(abs(auc - 0.5), 6) DESC, feature) AS place, CASE WHEN abs(auc - 0.5) >= 0.1 THEN 'TELLS' ELSE 'DOES NOT TELL' END AS verdict FROM a JOIN m USING (feature)""")
def q2_signal_anatomy(spark, d):
    """Each signal's event mean in fixes against controls: AUC, how often it moves on either side, and its place by distance from a half."""
    e = event_stats(spark, d).where("sha % 3 <> 1").withColumn("fix", F.col("sha") % 3 == 0)
    long = e.select("fix", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.round(F.col(f"mean_{s}"), 9).alias("v")) for s in SIGNALS])))
    moved = lambda c: F.avg(F.when(c, (F.col("v") != 0).cast("double")))
    t = stats.auc(long, "v", "fix", ["signal"]).join(long.groupBy("signal").agg(moved(F.col("fix")).alias("moved_fix"), moved(~F.col("fix")).alias("moved_control")), "signal")
    far = F.abs(F.col("auc") - 0.5)
    t = t.withColumn("place", F.row_number().over(Window.orderBy(F.round(far, 6).desc(), "signal"))).withColumn("verdict", F.when(far >= 0.1, "TELLS").otherwise("DOES NOT TELL"))  # a row a signal
    return rounded(t, "auc", "moved_fix", "moved_control")


# --- Q9: does what told the families apart still do so later -----------------------------------------------------------

HELD = SCORED + """, t AS (SELECT *, CASE WHEN doc_id < (SELECT list_sort(list(doc_id))[count(*) // 2 + 1] FROM scored) THEN 'derivation' ELSE 'holdout' END AS part FROM scored), long AS (SELECT part || ':' || m AS feature, CASE m WHEN 'n_chars' THEN n_chars WHEN 'n_words' THEN n_words ELSE n_stops END AS score, good FROM t, (VALUES ('n_chars'), ('n_words'), ('n_stops')) v(m)), """ + AUC


@query(f"""WITH {HELD}, a AS (SELECT split_part(feature, ':', 1) AS part, split_part(feature, ':', 2) AS measure, CAST(sum(p) AS BIGINT) AS n_pos, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1, 2)
    SELECT x.measure, x.n_pos AS n_derivation, y.n_pos AS n_holdout, round(x.auc, 6) AS auc_derivation, round(y.auc, 6) AS auc_holdout, round(y.auc - b.auc, 6) AS lift_holdout, CASE WHEN y.n_pos < 20 THEN 'UNDERPOWERED' WHEN (x.auc > 0.5) = (y.auc > 0.5) THEN 'HOLDS' ELSE 'DOES NOT HOLD' END AS verdict
    FROM a x JOIN a y USING (measure) JOIN a b ON b.part = 'holdout' AND b.measure = 'n_chars' WHERE x.part = 'derivation' AND y.part = 'holdout'""")
def q9_heldout_specificity(spark, d):
    """Measures on the earlier and the later half of the texts, cut at the index median of the ids, and whether their direction holds."""
    s = scored(spark, d)
    n = s.count()
    cut = stats.running(s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")), [], "doc_id", {"upto": "c"}).where(F.col("upto") >= n // 2 + 1).agg(F.min("doc_id")).first()[0]
    t = s.withColumn("part", F.when(F.col("doc_id") < cut, "derivation").otherwise("holdout"))
    a = stats.auc(t.unpivot(["part", "good"], ["n_chars", "n_words", "n_stops"], "measure", "score"), "score", "good", ["part", "measure"])
    w = a.groupBy("measure").pivot("part", ["derivation", "holdout"]).agg(F.first("n_pos").alias("n"), F.first("auc").alias("auc"))
    base = w.where("measure = 'n_chars'").select(F.col("holdout_auc").alias("_b"), F.lit(1).alias("_one"))
    w = w.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    said = F.when(F.col("holdout_n") < 20, "UNDERPOWERED").when((F.col("derivation_auc") > 0.5) == (F.col("holdout_auc") > 0.5), "HOLDS").otherwise("DOES NOT HOLD")
    return w.select("measure", F.col("derivation_n").alias("n_derivation"), F.col("holdout_n").alias("n_holdout"), F.round("derivation_auc", 6).alias("auc_derivation"), F.round("holdout_auc", 6).alias("auc_holdout"), F.round(F.col("holdout_auc") - F.col("_b"), 6).alias("lift_holdout"), said.alias("verdict"))


# --- Q14: does the grammar of changes widen or collapse at the grain of a file -----------------------------------------

GRAMMAR = """SELECT grain, n, round(share_loose, 6) AS share_loose, round(share_strict, 6) AS share_strict, round(share_fix_shaped, 6) AS share_fix_shaped"""


@query(f"""WITH {DELTA}, e AS (SELECT 'event' AS grain, sum(struct_branch) AS b, sum(state_pointers) AS p, sum(state_alloc) AS a, sum(def_cast) AS c FROM d WHERE touched GROUP BY sha UNION ALL SELECT 'file', struct_branch, state_pointers, state_alloc, def_cast FROM d WHERE touched),
    f AS (SELECT grain, b > 0 OR p > 0 AS loose, b > 0 AND p > 0 AS strict, (b > 0 OR p > 0) AND a <= 0 AND c <= 0 AS fix_shaped FROM e),
    s AS (SELECT grain, count(*) AS n, avg(CAST(loose AS INTEGER)) AS share_loose, avg(CAST(strict AS INTEGER)) AS share_strict, avg(CAST(fix_shaped AS INTEGER)) AS share_fix_shaped FROM f GROUP BY 1)
    {GRAMMAR}, CASE WHEN share_loose > (SELECT share_loose FROM s WHERE grain = 'event') THEN 'WIDENS' WHEN grain = 'event' THEN 'REFERENCE' ELSE 'COLLAPSES' END AS verdict FROM s""")
def q14_patch_grammar(spark, d):
    """The three signatures at the grain of an event and of a file, and which way the loose one goes."""
    x = deltas(spark, d).where("touched")
    files = x.select(F.lit("file").alias("grain"), *SIGNALS)
    both = x.groupBy("sha").agg(*[F.sum(s).alias(s) for s in SIGNALS]).select(F.lit("event").alias("grain"), *SIGNALS).unionByName(files)
    f = signature.prevalence(signature.flags(both, *[F.col(s) for s in SIGNALS]), ["grain"], ["loose", "strict", "fix_shaped"])
    base = f.where("grain = 'event'").select(F.col("share_loose").alias("_b"), F.lit(1).alias("_one"))
    f = f.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    said = F.when(F.col("share_loose") > F.col("_b"), "WIDENS").when(F.col("grain") == "event", "REFERENCE").otherwise("COLLAPSES")
    return rounded(f.select("grain", "n", "share_loose", "share_strict", "share_fix_shaped", said.alias("verdict")), "share_loose", "share_strict", "share_fix_shaped")


# --- Q4: do process features tell more than size -----------------------------------------------------------------------

FEATURES = ["churn", "ownership", "scatter", "change_entropy"]
PROCESS_ROWS = PROCESS + """, f0 AS (SELECT anchor, path, churn, ownership, coalesce(scatter, 0) AS scatter, coalesce(change_entropy, 0) AS change_entropy FROM churn JOIN own USING (anchor, path) LEFT JOIN co USING (anchor, path)),
    lo AS (SELECT make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS anchor, l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS loc FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2), nx AS (SELECT DISTINCT make_date(CAST(year(o_orderdate) AS INTEGER) - 1, 1, 1) AS anchor, l_partkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45),
    ob AS (SELECT lo.anchor, lo.path, lo.loc, churn, ownership, scatter, change_entropy, nx.path IS NOT NULL AS good FROM lo LEFT JOIN f0 USING (anchor, path) LEFT JOIN nx USING (anchor, path)), long AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS score, good FROM ob" for f in [*FEATURES, "loc"]) + f"), {AUC}"


@query(f"""WITH {PROCESS_ROWS}, a AS (SELECT feature, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1)
    SELECT a.feature, a.n_pos, a.n_neg, round(a.auc, 5) AS auc, round(a.auc - b.auc, 5) AS lift, CASE WHEN a.n_pos < 20 THEN 'UNDERPOWERED' WHEN a.auc > 0.5 AND a.auc > b.auc THEN 'ABOVE SIZE' ELSE 'NOT ABOVE SIZE' END AS verdict FROM a JOIN a b ON b.feature = 'loc' WHERE a.feature <> 'loc'""")
def q4_process_features(spark, d):
    """Churn, ownership, scatter and change entropy of a year's files against size, for files with a large line in the year after; only the year itself feeds the features."""
    t = touches(spark, d)
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    year = F.year("o_orderdate")
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1)).alias("anchor")
    size = lines.groupBy(day(year), F.col("l_partkey").alias("path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("loc"))
    later = lines.where("l_quantity > 45").select(day(year - 1), F.col("l_partkey").alias("path")).distinct().withColumn("good", F.lit(True))
    rows = history.with_features(size, history.process_features(t), ["anchor", "path"], FEATURES).join(later, ["anchor", "path"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    long = rows.select("good", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("score")) for c in [*FEATURES, "loc"]])))
    a = stats.auc(long, "score", "good", ["feature"])
    base = a.where("feature = 'loc'").select(F.col("auc").alias("_b"), F.lit(1).alias("_one"))
    r = a.where("feature <> 'loc'").withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")
    said = F.when(F.col("n_pos") < 20, "UNDERPOWERED").when((F.col("auc") > 0.5) & (F.col("auc") > F.col("_b")), "ABOVE SIZE").otherwise("NOT ABOVE SIZE")
    return r.select("feature", "n_pos", "n_neg", F.round("auc", 5).alias("auc"), F.round(F.col("auc") - F.col("_b"), 5).alias("lift"), said.alias("verdict"))


# --- Q8: what the past of an entity says about the releases ahead ------------------------------------------------------

AHEAD = LONG_RUNS + """, l AS (SELECT *, qty - lag(qty) OVER (PARTITION BY path, run_start ORDER BY idx) AS dq FROM runs), w AS (SELECT path, idx, run_start, regr_slope(qty, idx) OVER v AS slope, stddev_pop(dq) OVER (PARTITION BY path, run_start ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS wobble, CAST(qty AS DOUBLE) AS level FROM l WINDOW v AS (PARTITION BY path, run_start ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    ev AS (SELECT path, idx FROM months WHERE lines >= 14), r AS (SELECT w.*, EXISTS (SELECT 1 FROM ev WHERE ev.path = w.path AND ev.idx > w.idx AND ev.idx <= w.idx + 4) AS good FROM w WHERE idx - run_start >= 7),
    long AS (SELECT 'slope' AS feature, round(slope, 9) AS score, good FROM r UNION ALL SELECT 'wobble', round(wobble, 9), good FROM r UNION ALL SELECT 'level', level, good FROM r), """ + AUC


@query(f"""WITH {AHEAD}, a AS (SELECT feature, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS auc FROM c GROUP BY 1)
    SELECT feature, n_pos, n_neg, round(auc, 6) AS auc, CASE WHEN n_pos < 20 THEN 'UNDERPOWERED' WHEN abs(auc - 0.5) >= 0.1 THEN 'TELLS' ELSE 'DOES NOT TELL' END AS verdict FROM a""")
def q8_trajectories(spark, d):
    """Slope, wobble and level over eight releases of an unbroken run against whether a large release follows within four."""
    t = trajectories(spark, d)
    r = windows.lookback(windows.with_runs(t, ["path"], "idx"), ["path"], "idx", "qty", 8)
    r = windows.outcome_ahead(r, t.where("lines >= 14").select("path", "idx"), ["path"], "idx", 4)
    long = r.select("outcome", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("score")) for n, c in (("slope", "slope"), ("wobble", "sd_moves"), ("level", "qty"))])))
    a = stats.auc(long, "score", "outcome", ["feature"])
    said = F.when(F.col("n_pos") < 20, "UNDERPOWERED").when(F.abs(F.col("auc") - 0.5) >= 0.1, "TELLS").otherwise("DOES NOT TELL")
    return rounded(a.withColumn("verdict", said), "auc")


# --- Q10: density against count in pairs of like size ------------------------------------------------------------------


@query(f"""WITH {PANEL}, a AS (SELECT sha, path, loc, struct_branch + state_pointers AS cnt, (struct_branch + state_pointers) / loc AS den FROM panel WHERE loc > 0), j AS (SELECT a.sha, a.path, a.cnt, a.den, b.cnt AS ccnt, b.den AS cden, row_number() OVER (PARTITION BY a.sha, a.path ORDER BY abs(b.loc - a.loc), b.loc < a.loc, CASE WHEN b.loc < a.loc THEN -b.path ELSE b.path END) AS rn FROM a JOIN a b ON a.sha = b.sha AND b.loc >= 0.66 * a.loc AND b.loc <= 1.5 * a.loc WHERE a.path % 9 = 0 AND b.path % 9 > 4),
    w AS (SELECT 'count' AS measure, CASE WHEN cnt > ccnt THEN 1.0 WHEN cnt = ccnt THEN 0.5 ELSE 0.0 END AS win FROM j WHERE rn = 1 UNION ALL SELECT 'density', CASE WHEN den > cden THEN 1.0 WHEN den = cden THEN 0.5 ELSE 0.0 END FROM j WHERE rn = 1)
    SELECT measure, count(*) AS n, round(avg(win), 6) AS win_rate, CASE WHEN abs(avg(win) - 0.5) >= 0.1 THEN 'SPECIFIC' ELSE 'NOT SPECIFIC' END AS verdict FROM w GROUP BY 1""")
def q10_density_specificity(spark, d):
    """Files of one kind against the file of another kind nearest in size in the same snapshot: how often they carry more signals, and more for each line."""
    a = panel(spark, d).where("loc > 0").select("sha", "path", "loc", snapshot.total(["struct_branch", "state_pointers"]).alias("count")).withColumn("density", F.col("count") / F.col("loc"))
    pool = a.where("path % 9 > 4").withColumnsRenamed({"count": "c_count", "density": "c_density"})
    j = match.sorted_neighbours(a.where("path % 9 = 0"), pool, ["sha"], "loc", "path", keep=["count", "density"], carry=["c_count", "c_density"])
    win = lambda c: F.when(F.col(c) > F.col(f"c_{c}"), 1.0).when(F.col(c) == F.col(f"c_{c}"), 0.5).otherwise(0.0)
    long = j.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), win(c).alias("win")) for c in ("count", "density")])))
    g = long.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.avg("win").alias("win_rate"))
    return rounded(g.withColumn("verdict", F.when(F.abs(F.col("win_rate") - 0.5) >= 0.1, "SPECIFIC").otherwise("NOT SPECIFIC")), "win_rate")


# --- Q16 and Q18 -------------------------------------------------------------------------------------------------------


@query()
def q16_signal_classes(spark, d):
    """Kinds of customers from signals of their orders: undated ones left out, still signals dropped, penalty by folds, classes of the later part: precision, recall and F1 of each."""
    from .catalog import multinomial_signals

    return rounded(stats.confusion(multinomial_signals(spark, d), "truth", "guess"), "precision", "recall", "f1")


@query(f"""WITH {MONTHS}, {RENAMED}, k AS (SELECT coalesce(p.event, c.event) AS event, CASE WHEN c.path IS NULL THEN 'only_left' WHEN p.path IS NULL THEN 'only_right' WHEN p.qty IS DISTINCT FROM c.qty OR p.lines IS DISTINCT FROM c.lines THEN 'differs' ELSE 'same' END AS side FROM p FULL OUTER JOIN c ON p.event = c.event AND p.path = c.path)
    SELECT event, count(*) FILTER (side = 'only_left') AS only_left, count(*) FILTER (side = 'only_right') AS only_right, count(*) FILTER (side = 'differs') AS differs, CASE WHEN count(*) FILTER (side <> 'same') = 0 THEN 'PARITY' ELSE 'NO PARITY' END AS verdict FROM k GROUP BY 1""")
def q18_parity_check(spark, d):
    """Each month against the one before: rows on one side only, rows that differ, and whether there is none."""
    left, right = _sides(months(spark, d))
    x = delta.parity(left, right, ["event", "path"], ["qty", "lines"])
    g = x.groupBy("event").agg(*[F.count_if(F.col("side") == s).alias(n) for s, n in (("only_left", "only_left"), ("only_right", "only_right"), ("both", "differs"))])
    every = right.select("event").distinct().join(g, "event", "left").fillna(0)
    return every.withColumn("verdict", F.when(F.col("only_left") + F.col("only_right") + F.col("differs") == 0, "PARITY").otherwise("NO PARITY"))


# --- Q11, Q12, Q13 and Q15 ---------------------------------------------------------------------------------------------

FLOORS = (0, 5, 10, 20)


@query(f"""WITH {DELTA}, f AS (SELECT floor, sha, sha % 3 = 0 AS fix, sum(struct_branch) > 0 OR sum(state_pointers) > 0 AS loose FROM d, (VALUES (0), (5), (10), (20)) v(floor) WHERE touched AND sha % 3 <> 1 AND abs(loc) >= floor GROUP BY 1, 2),
    g AS (SELECT floor, count(*) FILTER (fix) AS n_fix, count(*) FILTER (NOT fix) AS n_control, avg(CAST(loose AS INTEGER)) FILTER (fix) AS fixes, avg(CAST(loose AS INTEGER)) FILTER (NOT fix) AS controls FROM f GROUP BY 1)
    SELECT floor, n_fix, n_control, round(fixes, 6) AS share_fix, round(controls, 6) AS share_control, CASE WHEN least(n_fix, n_control) < 5 THEN 'TOO FEW' WHEN fixes > controls THEN 'HOLDS' ELSE 'DOES NOT HOLD' END AS verdict FROM g""")
def q11_churn_floors(spark, d):
    """The loose signature of fixes against controls, counting only files that changed by at least 0, 5, 10 or 20 lines; five events a side at least."""
    x = deltas(spark, d).where("touched and sha % 3 <> 1").withColumn("floor", F.explode(F.array(*[F.lit(f) for f in FLOORS]))).where(F.abs(F.col("loc")) >= F.col("floor"))
    e = signature.flags(x.groupBy("floor", "sha").agg(*[F.sum(s).alias(s) for s in SIGNALS]), *[F.col(s) for s in SIGNALS]).withColumn("fix", F.col("sha") % 3 == 0)
    share = lambda c: F.avg(F.when(c, F.col("loose").cast("double")))
    g = e.groupBy("floor").agg(F.count_if("fix").alias("n_fix"), F.count_if(~F.col("fix")).alias("n_control"), share(F.col("fix")).alias("share_fix"), share(~F.col("fix")).alias("share_control"))
    said = F.when(F.least("n_fix", "n_control") < 5, "TOO FEW").when(F.col("share_fix") > F.col("share_control"), "HOLDS").otherwise("DOES NOT HOLD")
    return rounded(g.withColumn("verdict", said), "share_fix", "share_control")


@query()
def q12_follow_up_events(spark, d):
    """Reverts and follow-ups against other events: how many are fix-shaped, with the exact lower and upper tails of the two by two table."""
    f = flagged(spark, d).withColumn("class", F.when(F.col("sha") % 4 == 0, "revert").when(F.col("sha") % 4 == 1, "follow-up").otherwise("other"))
    n = {r["class"]: (r["yes"], r["no"]) for r in f.groupBy("class").agg(F.count_if("fix_shaped").alias("yes"), F.count_if(~F.col("fix_shaped")).alias("no")).collect()}  # a row a class
    rows = []
    for c in ("revert", "follow-up"):
        (a, b), (x, y) = n.get(c, (0, 0)), n.get("other", (0, 0))
        low, high = tails.hypergeometric_tails([[a, b], [x, y]])
        rows.append((c, a, a + b, x, x + y, round(low, 6), round(high, 6), "FEWER" if low < 0.05 else "MORE" if high < 0.05 else "ALIKE"))
    return spark.createDataFrame(rows, "class string, n_yes long, n long, other_yes long, other_n long, p_lower double, p_upper double, verdict string")


POOLS = " UNION ALL ".join(f"SELECT class, '{s}' AS signal, {s} AS v FROM x" for s in SIGNALS)


@query(f"""WITH {DELTA}, x AS (SELECT sha, CASE sha % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'introduced' ELSE 'control' END AS class, {", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in SIGNALS)} FROM d WHERE touched GROUP BY 1, 2), l AS ({POOLS}), g AS (SELECT class, signal, count(*) AS n, avg(v) AS mean, avg(CAST(v > 0 AS INTEGER)) AS rises FROM l GROUP BY 1, 2), b AS (SELECT signal, avg(CAST(v > 0 AS INTEGER)) AS base FROM l GROUP BY 1)
    SELECT class, signal, n, round(mean, 6) AS mean, round(rises, 6) AS rises, round(rises / nullif(base, 0), 6) AS lift FROM g JOIN b USING (signal)""")
def q13_keyword_pools(spark, d):
    """For each class of events and each signal: the mean of its sums, how often it rises, and that against all events."""
    x = deltas(spark, d).where("touched").groupBy("sha").agg(*[F.sum(s).alias(s) for s in SIGNALS]).withColumn("class", classes(F.col("sha")))
    long = x.unpivot(["class"], SIGNALS, "signal", "v")
    up = F.avg((F.col("v") > 0).cast("double"))
    g = long.groupBy("class", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), up.alias("rises"))
    base = long.groupBy("signal").agg(up.alias("_b"))
    return rounded(g.join(F.broadcast(base), "signal").withColumn("lift", F.try_divide("rises", "_b")).drop("_b"), "mean", "rises", "lift")


FIRST = CHANGE + """, t AS (SELECT DISTINCT sha, parent, old_path AS path FROM change WHERE status = 'touched'), first AS (SELECT path, min(sha) AS sha FROM t GROUP BY 1), po AS (SELECT p.sha AS snap, p.path, p.loc, coalesce(risk_debt, 0) + coalesce(risk_safety, 0) AS exposure FROM first JOIN t USING (path, sha) JOIN panel p ON p.sha = t.parent AND p.path = t.path),
    ne AS (SELECT p.sha AS snap, p.path, p.loc, coalesce(risk_debt, 0) + coalesce(risk_safety, 0) AS exposure FROM panel p WHERE p.sha IN (SELECT snap FROM po) AND NOT EXISTS (SELECT 1 FROM first WHERE first.path = p.path)),
    j AS (SELECT po.snap AS s, po.path AS p, po.exposure AS e, ne.exposure AS c, po.snap <> ne.snap AS far, row_number() OVER (PARTITION BY po.snap, po.path ORDER BY po.snap <> ne.snap, abs(po.snap - ne.snap), abs(ne.loc - po.loc), ne.path * 100000 + ne.snap) AS rn FROM po JOIN ne ON ne.loc >= 0.66 * po.loc AND ne.loc <= 1.5 * po.loc)"""


@query(f"""WITH {FIRST} SELECT count(*) AS n, count(*) FILTER (NOT far) AS same_snapshot, round(median(e), 6) AS median_first, round(median(c), 6) AS median_control, round(avg(CASE WHEN e > c THEN 1.0 WHEN e = c THEN 0.5 ELSE 0.0 END), 6) AS win_rate, CASE WHEN abs(avg(CASE WHEN e > c THEN 1.0 WHEN e = c THEN 0.5 ELSE 0.0 END) - 0.5) <= 0.1 THEN 'EQUIVALENT' ELSE 'DIFFERENT' END AS verdict FROM j WHERE rn = 1""")
def q15_first_event_profile(spark, d):
    """Files just before their first event against files that never have one, of like size in the same snapshot, else in the nearest: is exposure the same within a tenth."""
    p, up = panel(spark, d), parents(spark, d)
    t = change(p, up).where("status = 'touched'").select("sha", "parent", F.col("old_path").alias("path"))
    # a row a file at most, too many for the driver: its first event's parent
    first = cut(t.groupBy("path").agg(F.min(F.struct("sha", "parent")).alias("_f")).select("path", F.col("_f.parent").alias("_before")))
    own = p.select(F.col("sha").alias("parent"), "path", "loc", snapshot.total(RISKS).alias("exposure")).join(F.broadcast(first.select(F.col("_before").alias("parent")).distinct()), "parent", "left_semi")
    own = own.join(first.hint("merge"), "path", "left").where("_before is null or _before = parent").withColumn("id", F.col("path") * 100000 + F.col("parent"))
    # one pass over the panel for both sides; of the others' files of a size in a snapshot, that with the smallest id is the one to be matched
    own = own.groupBy("parent", "loc", F.when(F.col("_before").isNotNull(), F.col("id")).alias("_case")).agg(F.min(F.struct(F.col("id").isNull().alias("_none"), "id", "exposure")).alias("_m"))
    own = cut(own.select("parent", "loc", "_case", "_m.id", "_m.exposure", F.date_add(F.lit("1970-01-01").cast("date"), F.col("parent")).alias("day")))
    cases = own.where("_case is not null")
    pool = own.where("_case is null").join(F.broadcast(cases.select("parent").distinct()), "parent", "left_semi").withColumnRenamed("exposure", "c")
    m = match.date_nearest(cases, pool, "parent", "day", "loc", "id", carry=["c"])
    j = m.join(cases.select(F.col("id").alias("case"), F.col("exposure").alias("e")).hint("merge"), "case")
    win = F.avg(F.when(F.col("e") > F.col("c"), 1.0).when(F.col("e") == F.col("c"), 0.5).otherwise(0.0)).alias("win_rate")
    g = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == 0).alias("same_snapshot"), F.median("e").alias("median_first"), F.median("c").alias("median_control"), win)
    return rounded(g.withColumn("verdict", F.when(F.abs(F.col("win_rate") - 0.5) <= 0.1, "EQUIVALENT").otherwise("DIFFERENT")), "median_first", "median_control", "win_rate")
