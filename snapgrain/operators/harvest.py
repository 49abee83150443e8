"""Labelled events from vulnerability entries and commit messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VULNERABILITY = (
    "id string, summary string, database_specific struct<severity:string, CWE:struct<id:string, desc:string>>, "
    "affected array<struct<database_specific:struct<severity:string>, ecosystem_specific:struct<severity:string>, "
    "ranges:array<struct<type:string, repo:string, events:array<struct<introduced:string, fixed:string>>>>>>"
)

# Message rules of the three label classes and of follow-ups.
MESSAGE_RULES = {"bugfix-fixes": r"Fixes #\d+", "bugfix-bug": r"(?m)^Bug: \S+", "regression": r"(?i)regression"}
FOLLOW_UP = r"[Ff]ollow-?up to ([0-9a-f]{7,40})"


def vulnerability_commits(entries: DataFrame, commits: DataFrame, repo: str | None = None) -> DataFrame:
    """(id, class, sha, severity, cwe, cwe_desc, summary, known): the last fix and the last introduction of each git range.

    Hashes under 40 characters are left out; known tells whether the hash is in commits (sha).  The entry's own severity
    comes before that of the affected part.
    """
    a = entries.select("id", "summary", F.col("database_specific").alias("own"), F.explode("affected").alias("a"))
    r = a.select("id", "summary", "own", "a", F.explode("a.ranges").alias("r")).where("r.type = 'GIT'")
    if repo:
        r = r.where(F.coalesce(F.lower("r.repo"), F.lit("")).contains(repo.lower()))

    def last(kind: str) -> Column:
        return F.try_element_at(F.filter(F.transform("r.events", lambda e: e[kind]), lambda x: x.isNotNull()), F.lit(-1))

    both = F.array(F.struct(F.lit("security-fix").alias("class"), last("fixed").alias("sha")), F.struct(F.lit("introduced").alias("class"), last("introduced").alias("sha")))
    severity = F.coalesce("own.severity", "a.ecosystem_specific.severity", "a.database_specific.severity")
    flat = r.select("id", severity.alias("severity"), F.col("own.CWE.id").alias("cwe"), F.col("own.CWE.desc").alias("cwe_desc"), "summary", F.explode(both).alias("e"))
    flat = flat.select("id", "e.class", "e.sha", "severity", "cwe", "cwe_desc", "summary").where(F.length("sha") >= 40)
    there = commits.select("sha").distinct().withColumn("known", F.lit(True))
    return flat.join(there, "sha", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def reverts(commits: DataFrame) -> DataFrame:
    """(sha, class) of commits (sha, subject) whose subject starts with Revert."""
    return commits.where(F.col("subject").startswith("Revert")).select("sha", F.lit("revert").alias("class")).distinct()


def follow_ups(commits: DataFrame, fixes: DataFrame, pattern: str = FOLLOW_UP) -> DataFrame:
    """(sha, follows_fix): the first reference in a commit's body that is a prefix of a fix's hash; of several such fixes the smallest hash."""
    refs = commits.select("sha", F.posexplode(F.regexp_extract_all("body", F.lit(pattern))).alias("pos", "ref"))
    f = fixes.select(F.col("sha").alias("fix")).distinct()
    hit = refs.join(f, F.substring("ref", 1, 7) == F.substring("fix", 1, 7)).where(F.col("fix").startswith(F.col("ref")))
    return hit.groupBy("sha").agg(F.min(F.struct("pos", "fix")).alias("b")).select("sha", F.col("b.fix").alias("follows_fix"))


def message_labels(commits: DataFrame, body: str, rules: dict[str, str] = MESSAGE_RULES) -> DataFrame:
    """commits with the array of labels whose rule matches; rows without any are left out."""
    found = F.array_compact(F.array(*[F.when(F.col(body).rlike(p), k) for k, p in rules.items()]))
    return commits.withColumn("labels", found).where(F.size("labels") > 0)


def seeded_draw(df: DataFrame, by: list[str], ident: str, k: int, seed: int) -> DataFrame:
    """k rows of each group without replacement: those with the smallest digest of seed and ident, so any executor draws alike.

    Not the stream of a sequential generator; the same seed gives the same rows whatever the partitions.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    w = Window.partitionBy(*by).orderBy(order, ident)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def label_draw(labelled: DataFrame, excluded: DataFrame, ident: str, plan: list[tuple[str, int | None]], seed: int) -> DataFrame:
    """(ident, class, labels): for each (label, k) of the plan in turn, k rows (None: all) with the label that no earlier turn took."""
    left, out = labelled.join(excluded.select(ident).distinct(), ident, "left_anti"), None
    for label, k in plan:
        pool = left.where(F.array_contains("labels", label))
        if out is not None:
            pool = pool.join(out, ident, "left_anti")
        pool = pool.select(ident, F.lit(label).alias("class"), "labels")
        taken = pool if k is None else seeded_draw(pool, ["class"], ident, k, seed)
        out = taken if out is None else out.unionByName(taken)
    return out
