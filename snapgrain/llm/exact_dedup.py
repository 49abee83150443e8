"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition sorts its rows by digest and reduces them to a run with one entry per distinct text: digest, size of
the group, and the identifier that stays.  In each binomial round the runs r with the same r // fan_in meet; an entry's
digest is part of the exchange key, so every round spreads over all tasks, even the last, and a group of copies costs one
row a run.  A task gets its share of fan_in sorted runs, merges them by sorting what it reads, and streams through equal
neighbours.  The planner makes this of a grouped minimum of a struct, for which it has no hash table: sort, reduce, exchange,
sort (the merge) and reduce again, in memory that does not grow with the number of texts, and with spill.

Entries are keyed by SHA-256, byte length and a second 64-bit hash: an entry whose three values do not all agree is
another text, at each level.

Null counts as the empty text.  Rows of one doc_id are separate rows; a row without one can stay only where no row with
an id has its text.  An empty table gives an empty result.  Other columns of the input are kept by ``deduplicate`` and
ignored by ``exact_groups``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir

KEY = ["_sha", "_len", "_xx"]


def digests(docs: DataFrame, text: str = "text") -> list:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.unhex(F.sha2(body, 256)).alias("_sha"), F.octet_length(body).alias("_len"), F.xxhash64(body).alias("_xx")]


def merged_runs(docs: DataFrame, id_col: str, text: str, keep: str = "max", fan_in: int = 8) -> DataFrame:
    """(_sha, _len, _xx, _keep, _size): the last run, one entry per distinct text; _keep is null only where no row of the text has an id."""
    leaves = (docs.select(F.spark_partition_id().alias("_p")).agg(F.max("_p")).first()[0] or 0) + 1
    best = F.max if keep == "max" else F.min
    own = F.col(f"`{id_col}`")
    held = F.struct((own.isNotNull() if keep == "max" else own.isNull()).alias("rank"), own.alias("id"))  # rows with an id come first
    run = docs.select(held.alias("_held"), *digests(docs, text), F.lit(1).cast("long").alias("_size"), F.spark_partition_id().alias("_run"))
    rounds = max(1, math.ceil(math.log(leaves, fan_in)))
    for i in range(rounds):
        met = F.floor(F.col("_run") / fan_in).cast("int") if i + 1 < rounds else F.lit(0)
        run = run.groupBy(met.alias("_run"), *KEY).agg(best("_held").alias("_held"), F.sum("_size").alias("_size"))
    return run.select(*KEY, F.col("_held.id").alias("_keep"), "_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """Per row: id, keep_id (of the row that stays: the largest, or with keep="min" the smallest id; null where no row of the text has one), group_size, kept, text_sha256."""
    shared_dir(docs.sparkSession)
    final = merged_runs(docs, id_col, text, keep, fan_in).checkpoint()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *digests(docs, text))
    return rows.join(final, KEY, "left").select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """One row of docs for each distinct text, with all its columns: the row with the largest (keep="min": smallest) id.

    A row without an id stays only where no row with an id has its text.  Of rows with one id and one text, or without ids
    and with one text, one stays: the one whose other columns (but maps) have the least hash.  An id that repeats with
    another text is judged for each text alone.
    """
    shared_dir(docs.sparkSession)
    same = F.xxhash64("_keep").alias("_same")  # an exchange by text and id spreads a large group of copies
    final = merged_runs(docs, id_col, text, keep).select(*KEY, "_keep", same)
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text) and "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{id_col}`")).alias("_same"), F.xxhash64(*rest, F.lit(0)).alias("_rest"), *digests(docs, text))
    matched = rows.join(final, [*KEY, "_same"]).where(F.col("_id").eqNullSafe(F.col("_keep")))
    first = F.row_number().over(Window.partitionBy(*KEY, "_same").orderBy("_rest"))
    return matched.withColumn("_first", first).where("_first = 1").select("_row.*")
