"""Queries over the snapshot panel: resolution of events, signatures, functions, commit windows, matching and lists.

Bindings: a revision is a month of shipping, its parent the month before it; a file is a part, its signals counts of the
month's lines; a function of a file is a line with its supplier as name; a commit is an order, its author the customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import delta, history, match, rank, signature, snapshot
from .catalog import query, rounded, table

SIGNALS = ["struct_branch", "state_pointers", "state_alloc", "def_cast"]
RISKS = ["risk_debt", "risk_safety"]
PANEL = """panel AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS sha, l_partkey AS path, CAST(sum(l_quantity) AS BIGINT) AS loc, CAST(sum(round(100 * l_discount)) AS BIGINT) AS risk_debt,
    CAST(sum(CASE WHEN l_linenumber > 1 THEN round(100 * l_tax) END) AS BIGINT) AS risk_safety, count(*) FILTER (l_returnflag = 'A') AS struct_branch, count(*) FILTER (l_returnflag = 'R') AS state_pointers,
    count(*) FILTER (l_linestatus = 'O') AS state_alloc, count(*) FILTER (l_quantity > 40) AS def_cast FROM lineitem GROUP BY 1, 2)"""
# each month's parent; renamed are parts 10k, which were 10k + 1, new the parts 10k + 1, touched every third part
CHANGE = PANEL + """, parents AS (SELECT sha, lag(sha) OVER (ORDER BY sha) AS parent FROM (SELECT DISTINCT sha FROM panel)),
    change AS (SELECT parent, sha, CASE WHEN path % 10 = 1 THEN NULL WHEN path % 10 = 0 THEN path + 1 ELSE path END AS old_path, path AS new_path, CASE WHEN path % 10 = 1 THEN 'added' WHEN path % 3 = 0 THEN 'touched' ELSE 'untouched' END AS status
        FROM panel JOIN parents USING (sha) WHERE parent IS NOT NULL)"""
DELTA = CHANGE + """, d AS (SELECT c.sha, c.path, c.loc - p.loc AS loc, coalesce(c.risk_debt, 0) + coalesce(c.risk_safety, 0) - coalesce(p.risk_debt, 0) - coalesce(p.risk_safety, 0) AS structural, c.struct_branch - p.struct_branch AS struct_branch, c.state_pointers - p.state_pointers AS state_pointers,
    c.state_alloc - p.state_alloc AS state_alloc, c.def_cast - p.def_cast AS def_cast, h.status = 'touched' AS touched FROM change h JOIN panel c ON c.sha = h.sha AND c.path = h.new_path JOIN panel p ON p.sha = h.parent AND p.path = h.old_path)"""


def panel(spark, d):
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("sha")
    cents = lambda c: F.round(100 * F.col(c)).cast("long")
    return table(spark, d, "lineitem").groupBy(month, F.col("l_partkey").alias("path")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("loc"), F.sum(cents("l_discount")).alias("risk_debt"), F.sum(F.when(F.col("l_linenumber") > 1, cents("l_tax"))).alias("risk_safety"),
        F.count_if(F.col("l_returnflag") == "A").alias("struct_branch"), F.count_if(F.col("l_returnflag") == "R").alias("state_pointers"), F.count_if(F.col("l_linestatus") == "O").alias("state_alloc"), F.count_if(F.col("l_quantity") > 40).alias("def_cast"),
    )


def months_of(spark, d):
    return table(spark, d, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("sha")).distinct()


def parents(spark, d):
    """(sha, parent, ord): the month before, by an equi-join of the few months with themselves."""
    m = months_of(spark, d)
    before = m.select(F.col("sha").alias("parent"), F.explode(F.sequence(F.col("sha") + 1, F.col("sha") + 24)).alias("sha"))
    return m.join(before, "sha", "left").groupBy("sha").agg(F.max("parent").alias("parent")).withColumn("ord", F.lit(0))


def change(p, up):
    ten = F.col("path") % 10
    old = F.when(ten == 1, None).when(ten == 0, F.col("path") + 1).otherwise(F.col("path"))
    status = F.when(ten == 1, "added").when(F.col("path") % 3 == 0, "touched").otherwise("untouched")
    return p.join(F.broadcast(up.where("parent is not null")), "sha").select("parent", "sha", old.alias("old_path"), F.col("path").alias("new_path"), status.alias("status"))


def deltas(spark, d):
    """(sha, path, touched, loc, structural, signals): the deltas of files with both sides."""
    p, up = panel(spark, d), parents(spark, d)
    own = p.withColumn("structural", snapshot.total(RISKS)).select("sha", "path", "loc", "structural", *SIGNALS)
    values = ["loc", "structural", *SIGNALS]
    before = own.join(F.broadcast(up.select(F.col("parent").alias("sha"), F.col("sha").alias("child"))), "sha").drop("sha").withColumnRenamed("child", "sha")
    moved = change(p, up).select("sha", "old_path", "new_path", "status")
    first = up.where("parent is null").select("sha")
    after = own.join(F.broadcast(first), "sha", "left_anti")
    j = delta.snapshot_delta(before, after, moved, ["sha"], values).where("status in ('touched', 'untouched')")
    return j.select("sha", "path", (F.col("status") == "touched").alias("touched"), *[F.col(f"delta_{v}").alias(v) for v in values])


@query(f"""WITH {PANEL}, w AS (SELECT sha, row_number() OVER (ORDER BY sha) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT sha FROM panel)), k AS (SELECT sha, row_number() OVER (ORDER BY sha) - 1 AS idx FROM w WHERE rn % 9 = 0 OR rn = n - 1)
    SELECT idx, path, struct_branch, state_pointers, state_alloc, def_cast FROM panel JOIN k USING (sha) WHERE path % 4 = 1""")
def release_signals(spark, d):
    """Every ninth month and the last as releases; the files of one language with the signals that the panel is found to have."""
    walk = snapshot.every_nth(months_of(spark, d), "sha", 9)
    p = panel(spark, d)
    return snapshot.release_panel(p.withColumn("language", F.when(F.col("path") % 4 == 1, "c").otherwise("h")), walk, "c", sorted(snapshot.signal_columns(p), key=SIGNALS.index))


@query(f"""WITH {PANEL} SELECT sha, path, coalesce(risk_debt, 0) + coalesce(risk_safety, 0) AS structural, loc, coalesce(risk_safety, 0) AS risk_safety FROM panel WHERE sha % 6 = 0""")
def structural_snapshots(spark, d):
    """Rows of the snapshots of every June and December with their exposure, and a measure with null as 0."""
    p = panel(spark, d)
    some = snapshot.rows_at(p, months_of(spark, d).where("sha % 6 = 0"), ["loc", *RISKS])
    zero = snapshot.measures_or_zero(some, ["risk_safety"])
    return snapshot.structural(some, RISKS).join(zero, ["sha", "path"]).select("sha", "path", "structural", "loc", "risk_safety")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS sha FROM orders), r AS (SELECT c_custkey AS sha, make_date(1990 + CAST(c_nationkey AS INTEGER), 1, 1) AS date FROM customer WHERE c_acctbal > 0), g AS (SELECT o_custkey AS sha, CAST(min(o_orderdate) AS DATE) AS date FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
    SELECT sha, coalesce(r.date, g.date) AS date FROM m LEFT JOIN r USING (sha) LEFT JOIN g USING (sha)""")
def revision_dates(spark, d):
    """Dates of customers' revisions from the registry, else from the log, else none."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "sha")
    r = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sha"), F.make_date(F.lit(1990) + F.col("c_nationkey"), F.lit(1), F.lit(1)).alias("date"))
    g = o.where(F.col("o_orderpriority").startswith("1")).groupBy("sha").agg(F.to_date(F.min("o_orderdate")).alias("date"))
    return snapshot.dated(o.select("sha").distinct(), r, g)


@query(f"""WITH {CHANGE} SELECT h.sha, count(*) AS n_changed, count(*) FILTER (p.path IS NOT NULL) AS n_positive, count(*) FILTER (p.path IS NOT NULL AND c.path IS NOT NULL) AS n_touched
    FROM change h LEFT JOIN panel p ON p.sha = h.parent AND p.path = h.old_path LEFT JOIN panel c ON c.sha = h.sha AND c.path = h.new_path WHERE h.status = 'touched' GROUP BY 1""")
def touched_files(spark, d):
    """Events with a parent: touched files, those that the parent has, and those that both have."""
    p, up = panel(spark, d), parents(spark, d)
    events = snapshot.resolved(months_of(spark, d), up)
    t = snapshot.touched(change(p, events), p)
    return t.groupBy("sha").agg(F.count(F.lit(1)).alias("n_changed"), F.count_if("in_parent").alias("n_positive"), F.count_if(F.col("in_parent") & F.col("in_child")).alias("n_touched"))


@query(f"""WITH {CHANGE}, known AS (SELECT DISTINCT path FROM panel WHERE path % 7 < 3), s AS (SELECT sha, 0 AS side, new_path AS path FROM change WHERE status = 'touched' UNION ALL SELECT sha, 1, old_path FROM change WHERE status = 'touched')
    SELECT sha, arg_min(path, side * 10000000 + path) AS path FROM s JOIN known USING (path) GROUP BY 1""")
def first_touched_path(spark, d):
    p, up = panel(spark, d), parents(spark, d)
    return snapshot.first_present(change(p, up), p.where("path % 7 < 3"))


@query(f"""WITH {DELTA} SELECT sha, touched, count(*) AS n, round(avg(structural), 6) AS mean_structural, round(avg(loc), 6) AS mean_loc FROM d GROUP BY 1, 2""")
def event_split_means(spark, d):
    x = deltas(spark, d).withColumn("status", F.when(F.col("touched"), "touched").otherwise("untouched")).drop("touched")
    return rounded(delta.split_means(x, ["sha"], ["structural", "loc"]), "mean_structural", "mean_loc")


STATS = DELTA + ", e AS (SELECT sha, " + ", ".join(f"avg({s}) AS mean_{s}, CAST(sum({s}) AS BIGINT) AS sum_{s}" for s in SIGNALS) + " FROM d WHERE touched GROUP BY 1)"


def event_stats(spark, d):
    return signature.signal_stats(deltas(spark, d).where("touched"), ["sha"], SIGNALS)


@query(f"WITH {STATS} SELECT sha, " + ", ".join(f"round(mean_{s}, 6) AS mean_{s}, sum_{s}" for s in SIGNALS) + " FROM e")
def signal_event_stats(spark, d):
    return rounded(event_stats(spark, d), *[f"mean_{s}" for s in SIGNALS])


FLAGGED = STATS + """, f AS (SELECT *, sum_struct_branch > 0 OR sum_state_pointers > 0 AS loose, sum_struct_branch > 0 AND sum_state_pointers > 0 AS strict, (sum_struct_branch > 0 OR sum_state_pointers > 0) AND sum_state_alloc <= 0 AND sum_def_cast <= 0 AS fix_shaped FROM e)"""


def flagged(spark, d):
    s = {x: F.col(f"sum_{x}") for x in SIGNALS}
    return signature.flags(event_stats(spark, d), s["struct_branch"], s["state_pointers"], s["state_alloc"], s["def_cast"])


@query(f"WITH {FLAGGED} SELECT sha, loose, strict, fix_shaped FROM f")
def signature_flags(spark, d):
    return flagged(spark, d).select("sha", "loose", "strict", "fix_shaped")


@query(f"WITH {FLAGGED} SELECT CAST(sha % 12 AS INTEGER) AS season, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}, round(avg(CAST({c} AS INTEGER)), 6) AS share_{c}" for c in ("loose", "strict", "fix_shaped")) + " FROM f GROUP BY 1")
def signature_prevalence(spark, d):
    p = signature.prevalence(flagged(spark, d).withColumn("season", (F.col("sha") % 12).cast("int")), ["season"], ["loose", "strict", "fix_shaped"])
    return rounded(p, "share_loose", "share_strict", "share_fix_shaped")


@query("""WITH l AS (SELECT l_orderkey AS sha, count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'N') AS net_branch, count(*) FILTER (l_linestatus = 'O') - count(*) FILTER (l_linestatus = 'F') AS net_pointer, count(*) FILTER (l_quantity > 48) AS added_alloc, count(*) FILTER (l_discount > 0.09) AS added_cast FROM lineitem GROUP BY 1)
    SELECT sha, net_branch > 0 OR net_pointer > 0 AS loose, net_branch > 0 AND net_pointer > 0 AS strict, (net_branch > 0 OR net_pointer > 0) AND NOT (added_alloc > 0 OR added_cast > 0) AS fix_shaped FROM l""")
def patch_flags(spark, d):
    """Orders as patches: lines of one kind are added, of another removed; the veto looks at what is added."""
    n = lambda c: F.count_if(F.expr(c))
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha")).agg((n("l_returnflag = 'A'") - n("l_returnflag = 'N'")).alias("b"), (n("l_linestatus = 'O'") - n("l_linestatus = 'F'")).alias("p"), n("l_quantity > 48").alias("x"), n("l_discount > 0.09").alias("y"))
    return signature.patch_flags(g, *map(F.col, "bpxy")).select("sha", "loose", "strict", "fix_shaped")


FUNCTIONS = """f AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) * 1000000 + l_partkey AS file_id, l_orderkey * 10 + l_linenumber AS rowid, l_suppkey % 5 AS name, CAST(l_returnflag = 'A' AS INTEGER) + CAST(l_quantity > 25 AS INTEGER) AS guards, CAST(l_linestatus = 'O' AS INTEGER) + CAST(l_linenumber > 3 AS INTEGER) AS risks FROM lineitem)"""


@query(f"""WITH {PANEL}, {FUNCTIONS}, j AS (SELECT sha, path, rowid, name, guards / (risks + 1) AS rate FROM f JOIN panel ON file_id = CAST(sha AS BIGINT) * 1000000 + path), c AS (SELECT sha - 1 AS sha, path, name, arg_max(rate, rowid) AS after_rate FROM j GROUP BY 1, 2, 3)
    SELECT sha, count(*) AS n, count(after_rate) AS n_after, round(avg(rate), 6) AS before_rate, round(avg(after_rate), 6) AS after_rate FROM j LEFT JOIN c USING (sha, path, name) GROUP BY 1""")
def guard_rates(spark, d):
    """Functions joined to their files, and to the functions of the same name in the next month's file; the last of a repeated name counts."""
    l = table(spark, d, "lineitem")
    one = lambda c: F.expr(f"CAST({c} AS INT)")
    f = l.select(((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long") * 1000000 + F.col("l_partkey")).alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rowid"), (F.col("l_suppkey") % 5).alias("name"), one("l_returnflag = 'A'").alias("g1"), one("l_quantity > 25").alias("g2"), one("l_linestatus = 'O'").alias("r1"), one("l_linenumber > 3").alias("r2"))
    files = panel(spark, d).select((F.col("sha").cast("long") * 1000000 + F.col("path")).alias("id"), "sha", "path")
    j = snapshot.functions_of(f, files).withColumn("rate", signature.guard_rate(["g1", "g2"], ["r1", "r2"]))
    child = j.withColumn("sha", F.col("sha") - 1)
    p = snapshot.function_pairs(j, child, ["sha", "path"], ["rate"], "rowid")
    return rounded(p.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.count("after_rate").alias("n_after"), F.avg("rate").alias("before_rate"), F.avg("after_rate").alias("after_rate")), "before_rate", "after_rate")


@query(f"""WITH {PANEL}, x AS (SELECT *, loc - 40 AS lines FROM panel) SELECT sha, count(*) FILTER (lines > 0) AS n, round(avg(CASE WHEN lines > 0 THEN (struct_branch + state_pointers) / lines END), 6) AS dense, round(avg((struct_branch + state_pointers) / greatest(lines, 1)), 6) AS dense_all, CAST(sum(state_alloc + def_cast) AS BIGINT) AS family FROM x GROUP BY 1""")
def densities(spark, d):
    """Signals for each line, files without lines left out or counted as one line, and a family's sum."""
    x = panel(spark, d).withColumn("lines", F.col("loc") - 40)
    two = ["struct_branch", "state_pointers"]
    g = x.groupBy("sha").agg(F.count_if(F.col("lines") > 0).alias("n"), F.avg(signature.density(two, "lines")).alias("dense"), F.avg(signature.density(two, "lines", False)).alias("dense_all"), F.sum(snapshot.total(["state_alloc", "def_cast"])).alias("family"))
    return rounded(g, "dense", "dense_all")


@query(f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{s}' AS \"column\", count(*) AS n, round(avg(CAST(coalesce({s}, 0) <> 0 AS INTEGER)), 6) AS share FROM panel" for s in [*SIGNALS, "risk_safety"]))
def signal_coverage(spark, d):
    return rounded(signature.coverage(panel(spark, d), [*SIGNALS, "risk_safety"]), "share")


@query("SELECT count(*) AS n, count(*) FILTER (abs(p_retailprice - 1000 * (p_size / 10)) > 250) AS n_apart FROM part")
def redundancy_check(spark, d):
    p = table(spark, d, "part").withColumn("tenth", F.col("p_size") / 10)
    return signature.redundancy(p, "p_retailprice", "tenth", 1000.0, 250.0)


PATHS = """p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'docs/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'lib/net/' WHEN 3 THEN 'tests/unit/' ELSE '' END || lower(replace(p_brand, '#', '_')) || CASE p_size % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.h' ELSE '.txt' END AS path FROM part)"""


def paths(spark, d):
    size = F.col("p_size")
    folder = F.when(size % 5 == 0, "docs/").when(size % 5 == 1, "lib/").when(size % 5 == 2, "lib/net/").when(size % 5 == 3, "tests/unit/").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(folder, F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.when(size % 3 == 0, ".c").when(size % 3 == 1, ".h").otherwise(".txt")).alias("path"))


@query(f"""WITH {PATHS}, c AS (SELECT CASE WHEN path SIMILAR TO '(docs|tests|\\.github|scripts|packages|plan)/.*' THEN 'excluded_prefix' WHEN NOT path SIMILAR TO '.*\\.(c|h|py|rs|go|java|js)' THEN 'excluded_extension' ELSE 'kept' END AS class, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || CASE WHEN contains(split_part(path, '/', 2), '.') THEN '' ELSE '/' END ELSE path END AS area, path LIKE 'tests/%' AS test FROM p)
    SELECT class, area, test, count(*) AS n FROM c GROUP BY ALL""")
def path_classes(spark, d):
    p, path = paths(spark, d), F.col("path")
    return p.groupBy(rules.path_class(path).alias("class"), history.area(path).alias("area"), history.is_test(path).alias("test")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PATHS}, n AS (SELECT l_orderkey AS sha, path, l_linenumber AS added, CASE WHEN l_quantity < 49 THEN CAST(l_quantity AS BIGINT) END AS removed FROM lineitem JOIN p ON p_partkey = l_partkey)
    SELECT sha, count(*) AS files, CAST(sum(added + removed) AS BIGINT) AS churn FROM n WHERE removed IS NOT NULL AND (path LIKE '%.c' OR path LIKE '%.h') AND NOT path SIMILAR TO '(docs|tests|\\.github|scripts|packages|plan)/.*' GROUP BY 1""")
def commit_numstat(spark, d):
    """Code files and churn of an order; files without counts are binary."""
    l = table(spark, d, "lineitem").join(paths(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    n = l.select(F.col("l_orderkey").alias("sha"), "path", F.col("l_linenumber").cast("long").alias("added"), F.when(F.col("l_quantity") < 49, F.col("l_quantity").cast("long")).alias("removed"))
    return history.numstat(n.withColumn("removed", F.col("removed")).where("removed is not null"))


@query("""WITH a AS (SELECT make_date(1996 + CAST(i AS INTEGER), 1, 1) AS anchor FROM range(7) t(i)), j AS (SELECT anchor, o_orderkey AS sha, o_custkey AS author, date_diff('day', CAST(o_orderdate AS DATE), anchor) AS age, row_number() OVER (PARTITION BY anchor ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders, a WHERE date_diff('day', CAST(o_orderdate AS DATE), anchor) BETWEEN 1 AND 365)
    SELECT anchor, count(*) AS n, count(DISTINCT author) AS authors, CAST(max(age) AS INTEGER) AS oldest FROM j WHERE rn <= 1500 GROUP BY 1""")
def commit_windows(spark, d):
    """The year before each New Year, the newest 1500 commits of it; the cap is the feature."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    w = history.window_before(c, anchors(spark), 365, 1500)
    return w.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("authors"), F.max("age").alias("oldest"))


def anchors(spark):
    return spark.range(7).select(F.make_date(F.lit(1996) + F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("anchor"))


PROCESS = """t AS (SELECT DISTINCT make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS anchor, o_orderkey AS sha, o_custkey AS author, l_partkey AS path FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    churn AS (SELECT anchor, path, count(DISTINCT sha) AS churn FROM t GROUP BY 1, 2), o1 AS (SELECT anchor, path, author, count(DISTINCT sha) AS c FROM t GROUP BY 1, 2, 3), o2 AS (SELECT *, sum(c) OVER (PARTITION BY anchor, path) AS n FROM o1), own AS (SELECT anchor, path, round(abs(-sum(c / n * log2(c / n))), 6) AS ownership FROM o2 GROUP BY 1, 2),
    b AS (SELECT anchor, sha FROM t GROUP BY 1, 2 HAVING count(DISTINCT path) BETWEEN 2 AND 50), k AS (SELECT DISTINCT anchor, sha, path FROM t JOIN b USING (anchor, sha)), c1 AS (SELECT x.anchor, x.path, y.path AS partner, count(*) AS c FROM k x JOIN k y ON x.anchor = y.anchor AND x.sha = y.sha AND x.path <> y.path GROUP BY 1, 2, 3),
    c2 AS (SELECT *, sum(c) OVER (PARTITION BY anchor, path) AS n FROM c1), co AS (SELECT anchor, path, count(*) AS scatter, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(-sum(c / n * log2(c / n)), 6) END AS change_entropy FROM c2 GROUP BY 1, 2)"""


@query(f"WITH {PROCESS} SELECT anchor, path, churn, ownership, coalesce(scatter, 0) AS scatter, coalesce(change_entropy, 0) AS change_entropy FROM churn JOIN own USING (anchor, path) LEFT JOIN co USING (anchor, path)")
def process_features(spark, d):
    return history.process_features(touches(spark, d))


def touches(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("anchor"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("l_partkey").alias("path"))


@query("""WITH f AS (SELECT l_partkey AS path, count(*) AS churn FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey AS path, p_size, coalesce(churn, 0) AS churn FROM part LEFT JOIN f ON path = p_partkey""")
def feature_join(spark, d):
    f = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("path")).agg(F.count(F.lit(1)).alias("churn"))
    return history.with_features(table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size"), f, ["path"], ["churn"])


@query("SELECT o_orderkey, order_idx FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS order_idx FROM orders) WHERE o_orderstatus = 'F'")
def order_index(spark, d):
    return history.chronological(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").select("o_orderkey", F.col("order_idx").cast("long"))


@query(f"""WITH {CHANGE}, k AS (SELECT sha, count(*) AS n_files, count(*) FILTER (new_path % 50 <> 7 OR sha % 4 > 0) AS n_left_out FROM change GROUP BY 1)
    SELECT sha, CASE WHEN parent IS NULL THEN 'no_parent' WHEN coalesce(n_files, 0) > coalesce(n_left_out, 0) THEN 'usable' ELSE 'bystander_only' END AS status, coalesce(n_files, 0) AS n_files, coalesce(n_left_out, 0) AS n_left_out FROM parents LEFT JOIN k USING (sha)""")
def event_partition(spark, d):
    """Events by whether a file of theirs counts, with the files that are left out."""
    p, up = panel(spark, d), parents(spark, d)
    return snapshot.event_status(months_of(spark, d), change(p, up), up, (F.col("new_path") % 50 == 7) & (F.col("sha") % 4 == 0))


@query(f"""WITH {DELTA} SELECT CAST(sha % 12 AS INTEGER) AS season, count(*) AS n, round(median(structural), 6) AS median, round(avg(CAST(structural > 0 AS INTEGER)), 6) AS share_up FROM d WHERE touched GROUP BY 1""")
def season_summary(spark, d):
    x = deltas(spark, d).where("touched").withColumn("season", (F.col("sha") % 12).cast("int"))
    return rounded(signature.group_summary(x, ["season"], "structural"), "median", "share_up")


GAPS = " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER (first) AS n_first, count(*) FILTER (NOT first) AS n_other, avg({s}) FILTER (first) - avg({s}) FILTER (NOT first) AS gap FROM x" for s in SIGNALS)


@query(f"WITH {DELTA}, x AS (SELECT *, path % 6 = 0 AS first FROM d WHERE touched), g AS ({GAPS}) SELECT signal, n_first, n_other, round(gap, 6) AS gap FROM g WHERE n_first >= 20 AND n_other >= 20 ORDER BY round(abs(gap), 6) DESC, signal LIMIT 3")
def top_signal_gaps(spark, d):
    """The signals whose means differ most between two kinds of files; the three largest are the feature."""
    x = deltas(spark, d).where("touched").withColumn("first", F.col("path") % 6 == 0)
    g = rounded(signature.signal_gaps(x, SIGNALS, "first"), "gap")
    return signature.top(g, [F.desc(F.abs("gap")), "signal"], 3)


@query(f"WITH {DELTA}, s AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, avg(CAST({s} <> 0 AS INTEGER)) AS share FROM d WHERE touched" for s in SIGNALS) + ") SELECT signal, round(share, 6) AS share FROM s WHERE share >= 0.03 ORDER BY share DESC, signal LIMIT 25")
def active_signals(spark, d):
    return rounded(signature.moving(deltas(spark, d).where("touched"), SIGNALS), "share")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def hotspots(spark, d):
    c = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return signature.top(c, [F.desc("n"), "l_suppkey"], 10)


@query("""WITH v AS (SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) > 8 THEN avg(c_acctbal) END AS value FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY value DESC NULLS LAST, c_mktsegment) AS rn FROM v) WHERE rn = 1""")
def best_segment(spark, d):
    """The strongest segment of each nation; an undefined mean comes last."""
    v = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.when(F.count(F.lit(1)) > 8, F.avg("c_acctbal")).alias("value"))
    return rounded(signature.argmax(v, ["c_nationkey"], "c_mktsegment", "value"), "value", digits=4)


@query(f"""WITH {CHANGE}, r AS (SELECT sha, new_path, old_path, loc, row_number() OVER (PARTITION BY sha ORDER BY loc, new_path) AS rn FROM change JOIN panel ON panel.sha = change.sha AND path = new_path WHERE status = 'touched' AND old_path <> new_path) SELECT sha, new_path, old_path, loc FROM r WHERE rn <= 2""".replace("SELECT sha, new_path, old_path, loc, row_number() OVER (PARTITION BY sha ORDER", "SELECT change.sha AS sha, new_path, old_path, loc, row_number() OVER (PARTITION BY change.sha ORDER"))
def renamed_pairs(spark, d):
    """Touched files that were renamed, the two smallest of each event."""
    p, up = panel(spark, d), parents(spark, d)
    c = change(p, up).where("status = 'touched' and old_path <> new_path").join(p.select("sha", F.col("path").alias("new_path"), "loc"), ["sha", "new_path"])
    return rank.first_per(c, ["sha"], ["loc", "new_path"], 2).select("sha", "new_path", "old_path", "loc")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END AS sign, word FROM l)
    SELECT doc_id, CAST(sum(sign) AS BIGINT) AS net_loc, CAST(sum(sign * len(regexp_extract_all(word, '[.,]'))) AS BIGINT) AS net_stop, CAST(sum(sign * len(regexp_extract_all(word, '!!'))) AS BIGINT) AS net_loud FROM s GROUP BY 1""")
def net_markers(spark, d):
    """Words of a text as lines of a diff, in turn added and removed, and the marks in them."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    lines = t.select("doc_id", F.when(F.col("i") % 2 == 0, 1).otherwise(-1).alias("sign"), "word")
    return signature.net_markers(lines, "doc_id", "sign", "word", {"stop": "[.,]", "loud": "!!"}).withColumns({"net_loc": F.col("net_loc").cast("long")})


@query("""WITH f AS (SELECT l_partkey AS id FROM lineitem WHERE l_quantity = 50), i AS (SELECT l_partkey AS id FROM lineitem WHERE l_quantity = 1), u AS (SELECT id, 'fix' AS class FROM f UNION ALL SELECT id, 'introduced' FROM i)
    SELECT id, count(*) AS n, count(*) FILTER (class = 'fix') AS n_fix, id IN (SELECT id FROM f INTERSECT SELECT id FROM i) AS paired FROM u GROUP BY 1""")
def paired_ids(spark, d):
    """The union of two event lists, and which ids are in both."""
    l = table(spark, d, "lineitem")
    f, i = (l.where(F.col("l_quantity") == q).select(F.col("l_partkey").alias("id")) for q in (50, 1))
    u = f.withColumn("class", F.lit("fix")).unionByName(i.withColumn("class", F.lit("introduced")))
    both = f.intersect(i).withColumn("paired", F.lit(True))
    g = u.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "fix").alias("n_fix"))
    return g.join(both, "id", "left").withColumn("paired", F.coalesce("paired", F.lit(False)))


SIZES = "a AS (SELECT c_custkey AS id, c_nationkey AS snap, CAST(make_date(1995, 1, 1) + CAST(c_nationkey * 37 % 300 AS INTEGER) AS DATE) AS day, CAST(abs(round(c_acctbal)) AS BIGINT) + 1 AS s FROM customer)"


def sized(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("snap"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_nationkey") * 37 % 300).cast("int")).alias("day"), (F.abs(F.round("c_acctbal")).cast("long") + 1).alias("s"))


@query(f"""WITH {SIZES}, j AS (SELECT a.id AS "case", b.id AS match, CASE WHEN a.snap = b.snap THEN 0 ELSE 1 END AS tier, abs(date_diff('day', a.day, b.day)) AS days, abs(b.s - a.s) AS gap FROM a JOIN a b ON b.s >= 0.66 * a.s AND b.s <= 1.5 * a.s WHERE a.id % 7 = 0 AND b.id % 7 > 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY tier, CASE WHEN tier = 0 THEN 0 ELSE days END, gap, match) AS rn FROM j)
    SELECT "case", match, tier, CAST(CASE WHEN tier = 0 THEN 0 ELSE days END AS INTEGER) AS day_gap, gap FROM r WHERE rn = 1""")
def date_nearest_pairs(spark, d):
    a = sized(spark, d)
    return match.date_nearest(a.where("id % 7 = 0"), a.where("id % 7 > 4"), "snap", "day", "s", "id")


@query(f"""WITH {SIZES}, j AS (SELECT a.snap, a.id AS "case", b.id AS match, abs(b.s - a.s) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.s - a.s), b.s < a.s, CASE WHEN b.s < a.s THEN -b.id ELSE b.id END) AS rn FROM a JOIN a b ON a.snap = b.snap AND b.s >= 0.66 * a.s AND b.s <= 1.5 * a.s WHERE a.id % 7 = 0 AND b.id % 7 > 4)
    SELECT snap, "case", match, gap FROM j WHERE rn = 1""")
def nearest_by_size(spark, d):
    a = sized(spark, d)
    return match.sorted_neighbours(a.where("id % 7 = 0"), a.where("id % 7 > 4"), ["snap"], "s", "id")


@query("""WITH p AS (SELECT c_nationkey AS k, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), q AS (SELECT c_nationkey AS k, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS v, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1)
    SELECT k, '{"before":{"v":' || p.v || ',"n":' || p.n || '},"after":{"v":' || q.v || ',"n":' || q.n || '},"delta":{"v":' || (q.v - p.v) || ',"n":' || (q.n - p.n) || '}}' AS record FROM p JOIN q USING (k)""")
def delta_records(spark, d):
    """Before, after and delta of a key as one JSON object."""
    c = table(spark, d, "customer").withColumn("v", F.round("c_acctbal").cast("long"))
    a, b = (c.where(F.col("c_custkey") % 2 == i).groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")) for i in (0, 1))
    return delta.pair_record(a, b, ["k"], ["v", "n"]).where("record like '%\"before\"%\"after\"%'")
