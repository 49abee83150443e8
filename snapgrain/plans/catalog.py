"""Every registered query by name, with the SQL that states the same result.

The test tables hold no code snapshots, so each operator is bound to a structural analogue: a file is a part, a snapshot a
calendar month of shipping, a commit an order, an author a customer, an event cluster a document source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, stats as tails
from ..operators import boot, delta, entropy, learn, match, panel, rank, signature, stats

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- bindings, in DataFrame form and in SQL -------------------------------------------------------------------------


def months(spark: SparkSession, d: str) -> DataFrame:
    """Panel: part, month number, quantity and lines; all integers."""
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path"), m.cast("int").alias("idx")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count(F.lit(1)).alias("lines"))


MONTHS = "months AS (SELECT l_partkey AS path, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS lines FROM lineitem GROUP BY 1, 2)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", " ")).cast("long").alias("n_words"), F.regexp_count("text", F.lit("[.]")).cast("long").alias("n_stops"))
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)


SCORED = "scored AS (SELECT doc_id, source, n_chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words, CAST(length(text) - length(replace(text, '.', '')) AS BIGINT) AS n_stops, quality = 1 AS good, toxic FROM documents JOIN labels USING (doc_id))"


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).distinct()


AUC = """
    h AS (SELECT feature, score, count(*) FILTER (good) AS p, count(*) FILTER (NOT good) AS n FROM long GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY score) - n AS below FROM h)
"""


@query(f"""WITH {SCORED}, long AS (SELECT 'n_chars' AS feature, n_chars AS score, good FROM scored), {AUC}
    SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def auc_pooled(spark, d):
    return rounded(stats.auc(scored(spark, d), "n_chars", "good"), "auc")


@query(f"""WITH {SCORED}, long AS (SELECT 'n_chars' AS feature, n_chars AS score, good FROM scored UNION ALL SELECT 'n_words', n_words, good FROM scored UNION ALL SELECT 'n_stops', n_stops, good FROM scored), {AUC}
    SELECT feature, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY 1""")
def auc_by_feature(spark, d):
    long = scored(spark, d).unpivot(["good"], ["n_chars", "n_words", "n_stops"], "feature", "score")
    return rounded(stats.auc(long, "score", "good", ["feature"]), "auc")


@query(f"""WITH {SCORED}, r AS (SELECT good, rank() OVER (ORDER BY n_words) + (count(*) OVER (PARTITION BY n_words) - 1) / 2.0 AS mr, count(*) OVER (PARTITION BY n_words) AS t FROM scored),
    s AS (SELECT CAST(count(*) FILTER (good) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT good) AS DOUBLE) AS n2, CAST(sum(mr) FILTER (good) AS DOUBLE) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r)
    SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 + 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s""")
def mann_whitney_u(spark, d):
    return rounded(stats.mann_whitney(scored(spark, d), "n_words", "good"), "u", "z")


@query(f"""WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY n_words) + (count(*) OVER (PARTITION BY n_words) - 1) / 2.0 AS a, rank() OVER (ORDER BY n_stops) + (count(*) OVER (PARTITION BY n_stops) - 1) / 2.0 AS b FROM scored)
    SELECT count(*) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS rho FROM r""")
def spearman_rho(spark, d):
    return rounded(stats.spearman(scored(spark, d), "n_words", "n_stops"), "rho")


# every month with the month before it, if that has rows
RENAMED = """
    ev AS (SELECT idx AS event FROM (SELECT DISTINCT idx FROM months) m WHERE EXISTS (SELECT 1 FROM months p WHERE p.idx = m.idx - 1)), c AS (SELECT idx AS event, path, qty, lines FROM months SEMI JOIN ev ON event = idx), p AS (SELECT idx + 1 AS event, path, qty, lines FROM months SEMI JOIN ev ON event = idx + 1),
    j AS (SELECT coalesce(c.event, p.event) AS event, coalesce(c.path, p.path) AS path, p.path AS old, CASE WHEN c.path IS NULL THEN 'deleted' WHEN p.path IS NULL THEN 'added' WHEN c.path % 3 = 0 THEN 'touched' ELSE 'untouched' END AS status,
          coalesce(c.qty, 0) - coalesce(p.qty, 0) AS delta_qty, coalesce(c.lines, 0) - coalesce(p.lines, 0) AS delta_lines
          FROM c FULL OUTER JOIN p ON p.event = c.event AND p.path = CASE WHEN c.path % 10 = 0 THEN c.path + 1 ELSE c.path END AND c.path % 10 <> 1)
"""


def _sides(m):
    """(parent, child) rows of all pairs of neighbouring months, keyed by the later one as event."""
    months_ = m.select("idx").distinct()
    pairs = F.broadcast(months_.join(months_.select((F.col("idx") + 1).alias("idx")), "idx", "left_semi").select(F.col("idx").alias("event")))
    child = m.withColumnRenamed("idx", "event").join(pairs, "event", "left_semi")
    parent = m.withColumn("event", F.col("idx") + 1).drop("idx").join(pairs, "event", "left_semi")
    return parent, child


def _delta(spark, d):
    parent, child = _sides(months(spark, d))
    # renames: part 10k was 10k + 1 before; the part 10k + 1 of the later month is new
    ten = F.col("path") % 10
    change = child.where((F.col("path") % 3 == 0) | ten.isin(0, 1)).select("event", F.when(ten == 1, None).when(ten == 0, F.col("path") + 1).otherwise(F.col("path")).alias("old_path"), F.col("path").alias("new_path"), F.when(ten == 1, "added").when(F.col("path") % 3 == 0, "touched").otherwise("untouched").alias("status"))
    return delta.snapshot_delta(parent, child, change, ["event"], ["qty", "lines"])


@query(f"WITH {MONTHS}, {RENAMED} SELECT event, path, old, status, delta_qty, delta_lines FROM j")
def snapshot_delta(spark, d):
    return _delta(spark, d).select("event", "path", "old", "status", "delta_qty", "delta_lines")


@query(f"WITH {MONTHS}, {RENAMED} SELECT event, status, count(*) AS n, CAST(sum(delta_qty) AS BIGINT) AS total FROM j GROUP BY 1, 2")
def snapshot_status(spark, d):
    return _delta(spark, d).groupBy("event", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("delta_qty").alias("total"))


@query(f"WITH {MONTHS}, l AS (SELECT path, idx, qty - lag(qty) OVER (PARTITION BY path ORDER BY idx) AS dq FROM months) SELECT idx, round(avg(dq), 6) AS mean_delta, count(*) FILTER (dq < 0) AS n_neg, count(*) FILTER (dq > 0) AS n_pos, count(*) FILTER (dq = 0) AS n_zero FROM l GROUP BY 1")
def event_mean_delta(spark, d):
    l = months(spark, d).withColumn("dq", F.col("qty") - F.lag("qty").over(Window.partitionBy("path").orderBy("idx")))
    return rounded(delta.event_means(l, ["idx"], "dq"), "mean_delta")


@query(f"WITH {MONTHS} SELECT path, idx, round(100 * percent_rank() OVER (PARTITION BY idx ORDER BY qty), 6) AS pct FROM months")
def pre_percentile(spark, d):
    return rounded(rank.percentile_within(months(spark, d), ["idx"], "qty").select("path", "idx", "pct"), "pct")


@query(f"WITH {MONTHS}, u AS (SELECT path, idx, 'qty' AS metric, qty AS value FROM months UNION ALL SELECT path, idx, 'lines', lines FROM months) SELECT path, idx, metric, round(100 * percent_rank() OVER (PARTITION BY idx, metric ORDER BY value), 6) AS pct FROM u")
def pre_percentile_by_metric(spark, d):
    u = rank.unpivoted(months(spark, d), ["path", "idx"], ["qty", "lines"])
    return rounded(rank.percentile_within(u, ["idx", "metric"], "value").drop("value"), "pct")


@query(f"WITH {MONTHS} SELECT path, idx, CAST(least(3, (4 * row_number() OVER (PARTITION BY idx ORDER BY qty, path) - 1) // count(*) OVER (PARTITION BY idx)) AS INTEGER) AS band FROM months")
def quartile_bands_rank(spark, d):
    return rank.rank_quartile(months(spark, d), ["idx"], "qty", "path").select("path", "idx", "band")


@query(f"WITH {MONTHS} SELECT CAST(CASE WHEN qty <= 22 THEN 0 WHEN qty <= 48 THEN 1 WHEN qty <= 108 THEN 2 ELSE 3 END AS INTEGER) AS band, count(*) AS n, CAST(sum(qty) AS BIGINT) AS total FROM months GROUP BY 1")
def absolute_bands(spark, d):
    return months(spark, d).groupBy(rank.absolute_band(F.col("qty")).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("total"))


@query("SELECT c_mktsegment, round(list_sort(list(c_acctbal))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INTEGER) + 1], 6) AS q90 FROM customer GROUP BY 1")
def quantile_nearest(spark, d):
    return rounded(rank.quantile_nearest(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", 0.9, "q90"), "q90")


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 4) AS q90, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY 1")
def quantile_linear(spark, d):
    return rounded(table(spark, d, "customer").groupBy("c_mktsegment").agg(rank.quantile_linear("c_acctbal", 0.9).alias("q90"), F.median("c_acctbal").alias("mid")), "q90", "mid", digits=4)


@query(f"""WITH {MONTHS}, x AS (SELECT *, path % 7 = 0 AS hit, coalesce(sum(lines) OVER (PARTITION BY idx ORDER BY qty DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(lines) OVER (PARTITION BY idx) AS taken FROM months)
    SELECT idx, count(*) FILTER (taken) AS n_read, count(*) FILTER (hit) AS n_pos, round(count(*) FILTER (taken AND hit) / nullif(count(*) FILTER (hit), 0), 6) AS recall FROM x GROUP BY 1""")
def budget_recall(spark, d):
    m = months(spark, d).withColumn("hit", F.col("path") % 7 == 0)
    return rounded(stats.budget_recall(m, ["idx"], "qty", "path", "lines", "hit"), "recall")


ERRORS = "SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error'"


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events")
def prior_count(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    return panel.prior_count(e, ["user_id"], "at").select("event_id", "user_id", "prior")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem), n AS (SELECT sha FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), f AS (SELECT c.* FROM c JOIN n USING (sha)),
    p AS (SELECT a.path, b.path AS partner, count(*) AS c FROM f a JOIN f b ON a.sha = b.sha AND a.path <> b.path GROUP BY 1, 2),
    t AS (SELECT *, sum(c) OVER (PARTITION BY path) AS total FROM p)
    SELECT path, count(*) AS partners, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(-sum(c / total * log2(c / total)), 6) END AS change_entropy FROM t GROUP BY 1""")
def cochange_features(spark, d):
    return entropy.cochange(commits(spark, d))


@query("""WITH c AS (SELECT l_partkey AS path, o_custkey AS author, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY path) AS total FROM c)
    SELECT path, CAST(max(total) AS BIGINT) AS total, count(*) AS n_kinds, round(-sum(c / total * log2(c / total)) + 0.0, 4) AS entropy FROM t GROUP BY 1""")
def ownership_entropy(spark, d):
    own = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("path"), F.col("o_custkey").alias("author")).agg(F.count(F.lit(1)).alias("c"))
    e = entropy.entropy_bits(own, ["path"], "c")
    return e.select("path", "total", "n_kinds", (F.round(F.abs("entropy"), 4)).alias("entropy"))


def _touches(spark, d):
    """Each New Year as anchor, the 400 days before it and 30 after: every line is in a window, some in two, so both clips are at work."""
    anchors = spark.range(8).select(F.make_date(F.lit(1995) + F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("anchor"))
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("sha"), F.to_date("l_shipdate").alias("day"))
    near = l.withColumn("_y", F.explode(F.sequence(F.year(F.date_sub("day", 30)), F.year("day") + 2)))
    j = near.join(F.broadcast(anchors.withColumn("_y", F.year("anchor"))), "_y").withColumn("age", F.datediff("anchor", "day")).drop("_y")
    return j.where("age >= -30 AND age < 400").select("anchor", "path", "sha", "age")


TOUCHES = "t0 AS (SELECT anchor, l_partkey AS path, l_orderkey AS sha, date_diff('day', CAST(l_shipdate AS DATE), anchor) AS age FROM lineitem, (SELECT make_date(1995 + CAST(i AS INTEGER), 1, 1) AS anchor FROM range(8) r(i)) WHERE date_diff('day', CAST(l_shipdate AS DATE), anchor) >= -30 AND date_diff('day', CAST(l_shipdate AS DATE), anchor) < 400)"


def _hcm_ctes(name: str, source: str, lengths: tuple[int, ...]) -> str:
    """The common tables t, e0, e, j of the variants, under a prefix."""
    values = ", ".join(f"({x})" for x in lengths)
    return f"""{name}t AS (SELECT anchor, path, length, least(greatest(age, 0) // length, CAST(ceil(365 / length) AS BIGINT) - 1) AS k, count(*) AS c FROM {source}, (VALUES {values}) v(length) GROUP BY ALL),
    {name}e0 AS (SELECT *, sum(c) OVER (PARTITION BY anchor, length, k) AS total, count(*) OVER (PARTITION BY anchor, length, k) AS files FROM {name}t),
    {name}e AS (SELECT anchor, length, k, max(total) AS total, max(files) AS files, CASE WHEN max(files) < 2 THEN 0 ELSE -sum(c / total * log2(c / total)) / log2(max(files)) END AS h FROM {name}e0 GROUP BY 1, 2, 3),
    {name}j AS (SELECT t.*, e.total, e.files, e.h, t.k * t.length + t.length / 2.0 AS mid FROM {name}t t JOIN {name}e e USING (anchor, length, k))"""


def _hcm_sql() -> str:
    share = {"weighted": "CAST(c AS DOUBLE) / total * h", "shared": "h / files", "full": "h"}
    decay = {"none": "1.0", "exp": "exp(-mid / 180)", "linear": "greatest(0.0, 1 - mid / 365)", "log": "1 / log2(2 + mid / 30)"}
    body = " UNION ALL ".join(f"SELECT anchor, path, length, '{a}_{w}' AS variant, sum(({share[a]}) * ({decay[w]})) AS value FROM j GROUP BY 1, 2, 3" for a in share for w in decay)
    return f"{TOUCHES}, {_hcm_ctes('', 't0', (30, 90, 180))}, hcm AS ({body})"


@query(f"WITH {_hcm_sql()} SELECT anchor, path, length, variant, round(value, 4) AS value FROM hcm")
def hcm_36(spark, d):
    v = entropy.change_entropy_variants(_touches(spark, d).select("anchor", "path", "age"))
    return rounded(v.select("anchor", "path", "length", "variant", "value"), "value", digits=4)


@query(f"""WITH {TOUCHES}, n AS (SELECT anchor, sha FROM t0 GROUP BY 1, 2 HAVING count(DISTINCT path) <= 5), t1 AS (SELECT t0.* FROM t0 JOIN n USING (anchor, sha)), {_hcm_ctes('', 't1', (90,))}
    SELECT anchor, path, round(sum(CAST(c AS DOUBLE) / total * h * exp(-mid / 180)), 4) AS value FROM j GROUP BY 1, 2""")
def hcm_flavour(spark, d):
    """One variant without commits of over 5 files (orders are that narrow)."""
    return rounded(entropy.flavour(_touches(spark, d), most=5), "value", digits=4)


def trajectories(spark, d):
    """Panel of suppliers by month, whose runs are long: entity, month number, quantity and lines."""
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("path"), m.cast("int").alias("idx")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count(F.lit(1)).alias("lines"))


LONG_RUNS = MONTHS.replace("l_partkey", "l_suppkey") + ", i AS (SELECT *, idx - row_number() OVER (PARTITION BY path ORDER BY idx) AS island FROM months), runs AS (SELECT *, min(idx) OVER (PARTITION BY path, island) AS run_start, max(idx) OVER (PARTITION BY path, island) AS run_end FROM i)"
RUNS = MONTHS + ", i AS (SELECT *, idx - row_number() OVER (PARTITION BY path ORDER BY idx) AS island FROM months), runs AS (SELECT *, min(idx) OVER (PARTITION BY path, island) AS run_start, max(idx) OVER (PARTITION BY path, island) AS run_end FROM i)"


@query(f"WITH {RUNS} SELECT path, run_start, run_end, count(*) AS n FROM runs GROUP BY 1, 2, 3")
def islands(spark, d):
    return panel.with_runs(months(spark, d), ["path"], "idx").groupBy("path", "run_start", "run_end").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LONG_RUNS}, l AS (SELECT *, qty - lag(qty) OVER (PARTITION BY path, run_start ORDER BY idx) AS dq FROM runs),
    w AS (SELECT path, idx, run_start, regr_slope(qty, idx) OVER (PARTITION BY path, run_start ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS slope, sum(CASE WHEN dq <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path, run_start ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n_moves, stddev_pop(dq) OVER (PARTITION BY path, run_start ORDER BY idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sd_moves FROM l)
    SELECT path, idx, round(slope, 4) AS slope, CAST(n_moves AS BIGINT) AS n_moves, round(sd_moves, 4) AS sd_moves FROM w WHERE idx - run_start >= 7""")
def lookback_slope(spark, d):
    r = panel.lookback(panel.with_runs(trajectories(spark, d), ["path"], "idx"), ["path"], "idx", "qty", 8)
    return rounded(r.select("path", "idx", "slope", F.col("n_moves").cast("long"), "sd_moves"), "slope", "sd_moves", digits=4)


@query(f"""WITH {LONG_RUNS}, l AS (SELECT *, coalesce(greatest(qty - lag(qty) OVER w, 0), 0) AS a, coalesce(greatest(lines - lag(lines) OVER w, 0), 0) AS b FROM runs WINDOW w AS (PARTITION BY path, run_start ORDER BY idx)),
    g AS (SELECT path, idx, run_start, sum(a) OVER w AS ga, sum(b) OVER w AS gb FROM l WINDOW w AS (PARTITION BY path, run_start ORDER BY idx ROWS UNBOUNDED PRECEDING)), r AS (SELECT *, ga / greatest(gb, 1) AS ratio FROM g)
    SELECT path, idx, round(ratio, 6) AS ratio, round(ratio - lag(ratio, 8) OVER (PARTITION BY path, run_start ORDER BY idx), 6) AS drift FROM r""")
def pairing_ratio(spark, d):
    r = panel.growth_ratio(panel.with_runs(trajectories(spark, d), ["path"], "idx"), ["path"], "idx", "qty", "lines", 8)
    return rounded(r.select("path", "idx", "ratio", "drift"), "ratio", "drift")


@query(f"WITH {LONG_RUNS} SELECT path, idx, CASE WHEN run_end >= idx + 8 THEN lead(qty, 8) OVER (PARTITION BY path, run_start ORDER BY idx) END AS ahead FROM runs")
def value_ahead(spark, d):
    return panel.value_ahead(panel.with_runs(trajectories(spark, d), ["path"], "idx"), ["path"], "idx", "qty", 8).select("path", "idx", "ahead")


@query(f"WITH e AS (SELECT *, sec // 3600 AS h FROM ({ERRORS})) SELECT event_id, user_id, lead(h) OVER (PARTITION BY user_id ORDER BY h, event_id) - h AS gap, count(*) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING) > 0 AS again FROM e")
def next_gap(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    return panel.next_gap(e, ["user_id"], "h", "event_id").select("event_id", "user_id", "gap", "again")


@query("""WITH r AS (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) + 7 * CAST(k AS INTEGER) AS day FROM events, range(5) t(k)), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS idx FROM r)
    SELECT event_id, (SELECT min(idx) FROM n WHERE n.day >= CAST(e.ts AS DATE)) AS idx FROM events e""")
def asof_forward(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    starts = table(spark, d, "events").select(F.to_date(F.date_trunc("month", "ts")).alias("m")).distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.date_add("m", 7 * k))).alias("at")).distinct()
    releases = starts.withColumn("idx", (F.row_number().over(Window.orderBy("at")) - 1).cast("long"))
    return panel.asof_forward(e, releases, "day", "at", "idx").select("event_id", "idx")


@query(f"WITH {MONTHS}, ev AS (SELECT path, idx FROM months WHERE qty > 60) SELECT path, idx, EXISTS (SELECT 1 FROM ev WHERE ev.path = m.path AND ev.idx > m.idx AND ev.idx <= m.idx + 4) AS outcome FROM months m")
def forward_outcome(spark, d):
    m = months(spark, d)
    return panel.outcome_ahead(m, m.where("qty > 60").select("path", "idx"), ["path"], "idx", 4).select("path", "idx", "outcome")


SPANS = f"""s0 AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), s1 AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) > 1800 THEN 1 ELSE 0 END AS new FROM s0),
    s2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec) AS s FROM s1), spans AS (SELECT user_id, min(sec) AS start, max(sec) - min(sec) AS length FROM s2 GROUP BY user_id, s), x AS ({ERRORS})"""


@query(f"WITH {SPANS} SELECT user_id, start, length, EXISTS (SELECT 1 FROM x WHERE x.user_id = spans.user_id AND x.sec < start + greatest(length, 1) AND x.sec + 60 >= start) AS touched FROM spans")
def span_overlap(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("at"), "event_type")
    w = Window.partitionBy("user_id").orderBy("at")
    s = e.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(w) > 1800).cast("int"), F.lit(0))).withColumn("s", F.sum("new").over(w))
    spans = s.groupBy("user_id", "s").agg(F.min("at").alias("start"), (F.max("at") - F.min("at")).alias("length")).drop("s")
    hunks = e.where("event_type = 'error'").select("user_id", F.col("at").alias("lo"), (F.col("at") + 60).alias("hi"))
    return match.touched_spans(spans, hunks, ["user_id"]).select("user_id", "start", "length", "touched")


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS id, CAST(abs(round(c_acctbal)) AS BIGINT) AS s FROM customer),
    j AS (SELECT a.k, a.id AS "case", b.id AS match, abs(b.s - a.s) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.s - a.s), b.id) AS rn FROM a JOIN a b ON a.k = b.k AND a.id <> b.id AND b.s >= 0.66 * a.s AND b.s <= 1.5 * a.s WHERE a.id % 5 = 0 AND b.id % 5 <> 0)
    SELECT k, "case", match, gap FROM j WHERE rn = 1""")
def length_matched_pairs(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.abs(F.round("c_acctbal")).cast("long").alias("s"))
    return match.nearest_sibling(a.where("id % 5 = 0"), a.where("id % 5 <> 0"), ["k"], "s", "id")


@query("""WITH a AS (SELECT DISTINCT md5(CAST(user_id AS VARCHAR)) AS h FROM events), b AS (SELECT o_orderkey, substr(md5(CAST(o_custkey AS VARCHAR)), 1, 7 + CAST(o_orderkey % 4 AS INTEGER)) AS g FROM orders)
    SELECT h, o_orderkey FROM a JOIN b ON starts_with(h, g) OR starts_with(g, h)""")
def prefix_join(spark, d):
    a = table(spark, d, "events").select(F.md5(F.col("user_id").cast("string")).alias("h")).distinct()
    b = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("m")).selectExpr("o_orderkey", "substring(m, 1, 7 + o_orderkey % 4) AS g")
    return match.prefix_join(a, b, "h", "g").select("h", "o_orderkey")


@query("""WITH a AS (SELECT user_id, arg_max(epoch(ts), event_id) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), b AS (SELECT user_id, arg_max(epoch(ts), event_id) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, round((b.t - a.t) / 86400, 4) AS days FROM a JOIN b USING (user_id)""")
def dwell(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    g = match.dwell(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), ["user_id"], "at", "event_id")
    return g.select("user_id", F.round(F.col("gap") / 86400, 4).alias("days"))


@query(f"""WITH {SCORED}, w AS (SELECT i AS iter, c, (hash_c * (i + 3) + i * 17) % 3 AS w FROM (SELECT DISTINCT source AS c, CAST(substr(source, 4) AS BIGINT) AS hash_c FROM scored), range(50) t(i)),
    x AS (SELECT iter, n_chars AS s, sum(CASE WHEN good THEN w ELSE 0 END) AS p, sum(CASE WHEN good THEN 0 ELSE w END) AS n FROM scored JOIN w ON source = c GROUP BY 1, 2),
    y AS (SELECT *, sum(n) OVER (PARTITION BY iter ORDER BY s) - n AS below FROM x)
    SELECT iter, round(CAST(sum(p * (2 * below + n)) AS DOUBLE) / (2.0 * sum(p) * sum(n)), 6) AS auc FROM y GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0""")
def boot_auc(spark, d):
    s = scored(spark, d)
    c = s.select(F.col("source").alias("c")).distinct().withColumn("h", F.substring("c", 4, 9).cast("long"))
    w = c.crossJoin(spark.range(50).withColumnRenamed("id", "iter")).select("iter", "c", ((F.col("h") * (F.col("iter") + 3) + F.col("iter") * 17) % 3).alias("w"))
    return rounded(boot.resampled_auc(boot.pair_matrix(s, "source", "n_chars", "good"), boot.counts(s, "source", "good"), w), "auc")


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '\\b(if|check|assert|valid)\\b')) AS BIGINT) AS k_guard, CAST(len(regexp_extract_all(text, '\\b(new|alloc|create)\\b')) AS BIGINT) AS k_alloc,
    CAST(len(regexp_extract_all(text, '(?i)\\blicensed?\\b')) AS BIGINT) AS k_license, CAST(len(regexp_extract_all(text, '[*#$%&|]{2,}|!!')) AS BIGINT) AS k_markup FROM documents""")
def keyword_counts(spark, d):
    k = rules.keyword_counts(table(spark, d, "documents"), "text")
    return k.select("doc_id", *[F.col(f"k_{r}").cast("long").alias(f"k_{r}") for r in rules.KEYWORDS])


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN contains(text, '!!') THEN 1.0 ELSE 0.0 END), 6) AS loud, round(avg(CASE WHEN contains(text, ' | ') THEN 1.0 ELSE 0.0 END), 6) AS tabular, round(avg(CASE WHEN contains(text, '!!') AND contains(text, ' | ') THEN 1.0 ELSE 0.0 END), 6) AS both FROM documents GROUP BY 1")
def signature_rates(spark, d):
    loud, tabular = F.contains("text", F.lit("!!")), F.contains("text", F.lit(" | "))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate(loud).alias("loud"), rate(tabular).alias("tabular"), rate(loud & tabular).alias("both"))


@query("""WITH a AS (SELECT p_brand, p_type, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT l_returnflag, count(*) / sum(count(*)) OVER () AS base FROM a GROUP BY 1),
    g AS (SELECT p_brand, l_returnflag, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS share FROM a GROUP BY 1, 2) SELECT p_brand, l_returnflag, n, round(share / base, 6) AS lift FROM g JOIN b USING (l_returnflag) WHERE share >= 0.25""")
def co_added(spark, d):
    a = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rounded(signature.composition(a, "p_brand", "l_returnflag", 0.25).drop("share"), "lift")


@query("""WITH x AS (SELECT CASE WHEN l_quantity > 45 THEN 'hit' ELSE 'miss' END AS t, CASE WHEN l_extendedprice > 60000 THEN 'hit' ELSE 'miss' END AS g FROM lineitem), k AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT g FROM x),
    c AS (SELECT class, (SELECT count(*) FROM x WHERE t = class) AS actual, (SELECT count(*) FROM x WHERE g = class) AS guessed, (SELECT count(*) FROM x WHERE t = class AND g = class) AS hit FROM k)
    SELECT class, actual, guessed, round(coalesce(hit / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hit / nullif(actual, 0), 0), 6) AS recall, round(coalesce(2.0 * hit / nullif(actual + guessed, 0), 0), 6) AS f1 FROM c""")
def confusion_matrix(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 45, "hit").otherwise("miss").alias("t"), F.when(F.col("l_extendedprice") > 60000, "hit").otherwise("miss").alias("g"))
    return rounded(stats.confusion(x, "t", "g"), "precision", "recall", "f1")


@query(f"""WITH {MONTHS}, {RENAMED}, k AS (SELECT coalesce(p.event, c.event) AS event, coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'only_left' WHEN p.path IS NULL THEN 'only_right' ELSE 'both' END AS side,
    CASE WHEN p.path IS NULL OR c.path IS NULL THEN '' ELSE concat_ws(',', CASE WHEN p.qty IS DISTINCT FROM c.qty THEN 'qty' END, CASE WHEN p.lines IS DISTINCT FROM c.lines THEN 'lines' END) END AS columns FROM p FULL OUTER JOIN c ON p.event = c.event AND p.path = c.path) SELECT * FROM k WHERE side <> 'both' OR columns <> ''""")
def parity_diff(spark, d):
    return delta.parity(*_sides(months(spark, d)), ["event", "path"], ["qty", "lines"])


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def exemplars(spark, d):
    return rank.first_per(table(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 3).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query(f"WITH {MONTHS}, l AS (SELECT path, sum(qty) AS q FROM months WHERE idx >= 1998 * 12 GROUP BY 1), r AS (SELECT path, sum(qty) AS q FROM months WHERE idx < 1998 * 12 GROUP BY 1), j AS (SELECT path, CAST(coalesce(l.q, 0) - coalesce(r.q, 0) AS BIGINT) AS delta FROM l FULL JOIN r USING (path)), t AS (SELECT *, row_number() OVER (ORDER BY delta DESC, path) AS up, row_number() OVER (ORDER BY delta, path) AS down FROM j) SELECT path, delta FROM t WHERE up <= 5 OR down <= 5")
def movers(spark, d):
    m = months(spark, d).groupBy("path").agg(F.sum(F.when(F.col("idx") >= 1998 * 12, F.col("qty")).otherwise(-F.col("qty"))).alias("delta"))
    return m.orderBy(F.desc("delta"), "path").limit(5).unionByName(m.orderBy("delta", "path").limit(5)).distinct()


@query("SELECT CAST(floor(year(o_orderdate) / 5) * 5 AS INTEGER) AS era, count(*) AS n, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY 1")
def era_medians(spark, d):
    return table(spark, d, "orders").groupBy(rules.era(F.year("o_orderdate")).cast("int").alias("era")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("o_totalprice"), 4).alias("mid"))


@query("WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS q2, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1) SELECT p_brand, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, min(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(p_retailprice) FILTER (p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (p_retailprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM part JOIN q USING (p_brand) GROUP BY ALL")
def box_feed(spark, d):
    return rounded(rank.box_statistics(table(spark, d, "part"), ["p_brand"], "p_retailprice"), "q1", "q2", "q3", digits=4)


@query("""WITH x AS (SELECT doc_id, CASE WHEN l.quality IS NULL THEN 'unlabelled' WHEN d.n_chars < 100 THEN 'too_short' ELSE 'used' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT reason, count(*) AS n FROM x GROUP BY 1""")
def skip_reasons(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy(F.when(F.col("quality").isNull(), "unlabelled").when(F.col("n_chars") < 100, "too_short").otherwise("used").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT list_sort(list(o_orderdate))[count(*) // 2 + 1] AS cut FROM orders) SELECT CASE WHEN o_orderdate < cut THEN 'derivation' ELSE 'holdout' END AS part, count(*) AS n FROM orders, s GROUP BY 1")
def temporal_split(spark, d):
    o = table(spark, d, "orders")
    return stats.index_split(o, "o_orderdate").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCORED}, long AS (SELECT f || ':' || k AS feature, CASE f WHEN 'n_chars' THEN n_chars WHEN 'n_words' THEN n_words ELSE n_stops END AS score, CASE k WHEN 'quality' THEN good ELSE toxic = 0 END AS good FROM scored, (VALUES ('n_chars'), ('n_words'), ('n_stops')) a(f), (VALUES ('quality'), ('clean')) b(k)), {AUC}
    SELECT feature, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM c GROUP BY 1""")
def discriminant_matrix(spark, d):
    s = scored(spark, d).withColumn("clean", F.col("toxic") == 0)
    long = s.unpivot(["good", "clean"], ["n_chars", "n_words", "n_stops"], "f", "score")
    both = long.select(F.concat("f", F.lit(":quality")).alias("feature"), "score", "good").unionByName(long.select(F.concat("f", F.lit(":clean")).alias("feature"), "score", F.col("clean").alias("good")))
    return rounded(stats.auc(both, "score", "good", ["feature"]).select("feature", "auc"), "auc")


# --- results that SQL has no function for; rows only ------------------------------------------------------------------


@query()
def sign_and_fisher(spark, d):
    """Exact tails on counts: of months where quantity rises against falls, and of labels by kind."""
    e = event_mean_delta(spark, d).agg(F.count_if(F.col("mean_delta") > 0).alias("w"), F.count_if(F.col("mean_delta") < 0).alias("l")).first()
    t = scored(spark, d).agg(*[F.count_if((F.col("good") == g) & (F.col("toxic") == x)).alias(f"c{int(g)}{x}") for g in (True, False) for x in (0, 1)]).first()
    u = mann_whitney_u(spark, d).first()
    both = tails.hypergeometric_tails([[t["c10"], t["c11"]], [t["c00"], t["c01"]]])
    rows = [("sign_test", tails.sign_tail(e["w"], e["l"])), ("fisher_lower", both[0]), ("fisher_upper", both[1]), ("mann_whitney_less", tails.normal_cdf(u["z"]))]
    return spark.createDataFrame(rows, "test string, p double")


@query()
def control_matching(spark, d):
    """One in ten orders of a priority with the cheapest of the 399 orders before it, each taken once."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("churn"))
    o = table(spark, d, "orders").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderpriority", "o_orderdate", F.col("o_orderkey").alias("ident"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("churn", F.lit(0)).alias("churn"))
    return match.greedy_controls(o.withColumn("hit", F.col("ident") % 10 == 0), ["o_orderpriority"], ["o_orderdate", "ident"], "hit")


@query()
def multinomial_signals(spark, d):
    """Region of a customer's orders from their measures: temporal split, penalty by folds, held-out classes."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("price"), F.min("o_orderdate").alias("since"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).withColumn("label", F.when(F.col("c_acctbal") < 1000, 0).when(F.col("c_acctbal") < 5000, 1).otherwise(2))
    x = c.select("c_custkey", "label", "n", "price", F.col("c_acctbal").alias("balance"), (F.col("since") >= "1996-01-01").alias("late"))
    return learn.select_and_fit(x.where("not late"), x.where("late"), ["n", "price", "balance"], "label", "c_custkey")
