"""Event files, logs, listings and diffs as tables; the dataset export, subsets, and stores that take up where they broke off."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.match import first_of

EVENT = "id string, class string, sha string, severity string, cwe string, summary string, matched_to string, follows_fix string, labels array<string>"
ENVELOPE = f"repo string, source string, pool_head string, counts map<string,int>, events array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in EVENT.split(', '))}>>"
VERSION = "1.0.0"
GRAINS = {"event": ("schema_version", "repo", "kind"), "file_sample": ("schema_version", "repo", "kind", "file_path"), "function_sample": ("schema_version", "repo", "kind", "file_path", "snapshot")}


def read_events(spark: SparkSession, paths: list[str], dedup: bool = False) -> DataFrame:
    """All events of one or more files with their place; with dedup a sha keeps its first class."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).json(paths)
    e = raw.select("repo", F.col("_metadata.file_path").alias("file"), F.posexplode("events").alias("pos", "e")).select("repo", "file", "pos", "e.*")
    return first_of(e, ["repo", "sha"], ["file", "pos"]) if dedup else e


def read_walk(spark: SparkSession, path: str) -> DataFrame:
    """Releases in their order with idx from 0."""
    raw = spark.read.schema("repo string, mode string, revisions array<struct<ref:string,sha:string,date:string,status:string>>").option("multiLine", True).json(path)
    return raw.select("repo", F.posexplode("revisions").alias("idx", "r")).select("repo", "idx", "r.*").withColumn("date", F.to_date(F.substring("date", 1, 10)))


def parse_diffs(diffs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, path, lo, hi, added, removed) of each hunk of unified diffs without context.

    Hunk headers say how many lines follow, so a removed line that begins with "-- " is not taken for a file header.
    """
    from collections.abc import Iterator

    import pandas as pd

    def hunks(body: str) -> Iterator[tuple]:
        path, lines, i = None, body.split("\n"), 0
        while i < len(lines):
            line = lines[i]
            i += 1
            if line.startswith("--- "):
                path = line[4:].removeprefix("a/")
            elif line.startswith("+++ ") and path == "/dev/null":
                path = line[4:].removeprefix("b/")
            elif line.startswith("@@ "):
                old, new = line.split(" ")[1:3]
                start, _, n_old = old[1:].partition(",")
                n_old, n_new = int(n_old or 1), int(new.partition(",")[2] or 1)
                gone, come, left = [], [], n_old + n_new
                while i < len(lines) and left > 0:
                    x = lines[i]
                    i += 1
                    if x.startswith("\\"):
                        continue
                    left -= 1
                    (gone if x.startswith("-") else come).append(x[1:])
                yield path, int(start), int(start) + max(n_old, 1) - 1, come, gone

    def run(batches):
        for pdf in batches:
            rows = [(i, *h) for i, body in zip(pdf[ident], pdf[text], strict=True) if body for h in hunks(body)]
            yield pd.DataFrame(rows, columns=[ident, "path", "lo", "hi", "added", "removed"])

    return diffs.select(ident, text).mapInPandas(run, f"{ident} {diffs.schema[ident].dataType.simpleString()}, path string, lo long, hi long, added array<string>, removed array<string>")


def export_dataset(frames: dict[str, DataFrame], path: str, skipped: DataFrame | None = None) -> dict:
    """Each grain as gzipped JSON lines under its own folder, and a manifest beside them; returns the manifest.

    Rows are counted in what was written, not in what was to be.  skipped (reason) is counted by reason.
    """
    spark = next(iter(frames.values())).sparkSession
    manifest: dict = {"schema_version": VERSION, "grains": {}, "skipped": {}}
    for kind, df in frames.items():
        df.withColumn("schema_version", F.lit(VERSION)).withColumn("kind", F.lit(kind)).write.mode("errorifexists").option("compression", "gzip").json(f"{path}/{kind}")
        manifest["grains"][kind] = {"rows": spark.read.text(f"{path}/{kind}").count(), "columns": df.columns}
    if skipped is not None:
        manifest["skipped"] = {r["reason"]: r["count"] for r in skipped.groupBy("reason").count().collect()}  # a row a reason
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def nested_sample(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, before, after, delta): maps from name to value for files on both sides; a null counts as 0 in the delta."""
    side = lambda t: F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(f"{t}_{v}").cast("double") for v in values]))
    a = before.select(*key, *[F.col(v).alias(f"b_{v}") for v in values])
    j = a.join(after.select(*key, *[F.col(v).alias(f"a_{v}") for v in values]), key)
    d = F.map_zip_with("before", "after", lambda _, x, y: F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0)))
    return j.select(*key, side("b").alias("before"), side("a").alias("after")).withColumn("delta", d)


def subset(tables: dict[str, DataFrame], shas: DataFrame, path: str) -> dict[str, int]:
    """A closed copy of the panel for some revisions: their files, the functions, folders and classes of these files, and their registry rows, with the schema of the whole.  Returns the rows of each table.

    tables: file_data (id, commit_hash), repo_data (commit_hash), and others with a file_id.
    """
    spark, out = shas.sparkSession, {}
    some = F.broadcast(shas.select("commit_hash").distinct())
    files = tables["file_data"].join(some, "commit_hash", "left_semi")
    ids = files.select(F.col("id").alias("file_id"))
    for name, df in tables.items():
        kept = files if name == "file_data" else df.join(some, "commit_hash", "left_semi") if "commit_hash" in df.columns else df.join(ids, "file_id", "left_semi")
        kept.select(*df.columns).write.mode("errorifexists").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}").count()
    return out


def schema_check(spark: SparkSession, path: str) -> DataFrame:
    """(kind, rows, bad_json, missing) of an export: rows that are no JSON object, and rows without a required key."""
    out = None
    for kind, required in GRAINS.items():
        text = spark.read.text(f"{path}/{kind}")
        keys = F.json_object_keys("value")
        lacking = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) > 0
        row = text.agg(F.count(F.lit(1)).alias("rows"), F.count_if(keys.isNull()).alias("bad_json"), F.count_if(keys.isNotNull() & lacking).alias("missing")).select(F.lit(kind).alias("kind"), "rows", "bad_json", "missing")
        out = row if out is None else out.unionByName(row)
    return out


def wanted_scans(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Snapshots that are not registered yet."""
    return wanted.join(registry.select("repo_name", "commit_hash").distinct(), ["repo_name", "commit_hash"], "left_anti")


def add_scans(wanted: DataFrame, scanned: DataFrame, panel: str, registry: str) -> DataFrame:
    """Appends the rows of those wanted snapshots that the registry lacks, reads the panel again, and registers only what is found there.

    Returns (repo_name, commit_hash, status): skipped, added, or missing where the scan gave no rows.  A run that broke off
    before it registered is repeated without doubling rows: what the panel has already is not appended.
    """
    spark, key = wanted.sparkSession, ["repo_name", "commit_hash"]
    known = _read(spark, registry, wanted.select(*key))
    todo = wanted_scans(wanted.select(*key).distinct(), known)
    there = _read(spark, panel, scanned).select(*key).distinct()
    fresh = scanned.join(todo, key, "left_semi").join(there, key, "left_anti")
    fresh.write.mode("append").parquet(panel)
    found = _read(spark, panel, scanned).select(*key).distinct().withColumn("_found", F.lit(True))
    status = F.when(F.col("_known"), "skipped").when(F.col("_found"), "added").otherwise("missing")
    # each table's files are those of when it was read, so the status stays what it is after the registry has grown
    rows = wanted.select(*key).distinct().join(known.withColumn("_known", F.lit(True)), key, "left").join(found, key, "left").select(*key, status.alias("status"))
    rows.where("status = 'added'").select(*key).write.mode("append").parquet(registry)
    return rows


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, empty with the columns of like where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def cached(keys: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, columns: list[str]) -> DataFrame:
    """compute(keys) with results kept under path: only keys that the store lacks are computed, and appended in one commit; returns the rows of all keys."""
    spark = keys.sparkSession
    shape = compute(keys.limit(0))
    have = _read(spark, path, shape)
    missing = keys.select(*columns).distinct().join(have.select(*columns).distinct(), columns, "left_anti").persist()
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    missing.unpersist()
    return _read(spark, path, shape).join(keys.select(*columns).distinct(), columns, "left_semi")


FEED = "vulns array<struct<id:string,summary:string,database_specific:struct<severity:string,CWE:struct<id:string,desc:string>>,affected:array<struct<database_specific:struct<severity:string>,ecosystem_specific:struct<severity:string>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string>>>>>>>>, next_page_token string"


def read_feed(spark: SparkSession, pages: list[str]) -> DataFrame:
    """Entries of the pages of a vulnerability feed that were fetched into files, an entry of an id once: the one of the first page.  A page that names a next one which is not among the files is an error."""
    raw = spark.read.schema(FEED).option("multiLine", True).json(pages).select(F.col("_metadata.file_path").alias("file"), "vulns", "next_page_token")
    heads = raw.select("file", "next_page_token").collect()  # a row a page
    if sum(r["next_page_token"] is not None for r in heads) >= max(len(heads), 1):
        raise ValueError("the feed goes on after its last page")
    e = raw.select("file", F.posexplode("vulns").alias("pos", "v")).select("file", "pos", "v.*")
    return first_of(e, ["id"], ["file", "pos"]).drop("file", "pos")


def read_name_status(lines: DataFrame, ident: list[str], text: str) -> DataFrame:
    """(ident, old_path, new_path, status, renamed) from the lines of a name-status listing: added and deleted files have one path, renamed and copied ones two, all others are touched."""
    f = F.split(F.col(text), "\t")
    kind = F.substring(F.get(f, F.lit(0)), 1, 1)
    two = kind.isin("R", "C")
    first, second = F.get(f, F.lit(1)), F.get(f, F.lit(2))
    d = lines.where(F.size(f) >= F.when(two, 3).otherwise(2))
    old = F.when(kind != "A", first)
    new = F.when(two, second).when(kind != "D", first)
    status = F.when(kind == "A", "added").when(kind == "D", "deleted").otherwise("touched")
    return d.select(*ident, old.alias("old_path"), new.alias("new_path"), status.alias("status"), (kind == "R").alias("renamed"))


def read_numstat(lines: DataFrame, ident: list[str], text: str) -> DataFrame:
    """(ident, path, added, removed) from the lines of a numstat listing; a binary file has null counts."""
    f = F.split(F.col(text), "\t", 3)
    count = lambda i: F.get(f, F.lit(i)).try_cast("long")
    return lines.where(F.size(f) == 3).select(*ident, F.get(f, F.lit(2)).alias("path"), count(0).alias("added"), count(1).alias("removed"))


def read_log(lines: DataFrame, text: str) -> DataFrame:
    """(sha, at, author, path) from lines of a log (file, line, text): a head "@@|sha|epoch|author" is followed by the paths of the commit.  Lines belong to the last head before them in their file."""
    w = Window.partitionBy("file").orderBy("line")
    t = F.col(text)
    head = F.when(t.startswith("@@|"), F.split(t, "\\|", 4))
    d = lines.withColumn("_head", F.last(head, True).over(w)).where(~t.startswith("@@|") & (F.trim(t) != "") & F.col("_head").isNotNull())
    return d.select(F.get("_head", F.lit(1)).alias("sha"), F.timestamp_seconds(F.get("_head", F.lit(2)).cast("long")).alias("at"), F.get("_head", F.lit(3)).alias("author"), F.trim(t).alias("path"))
