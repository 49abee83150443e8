"""Snapshots as they land: each micro-batch adds new rows only and recomputes the pairs that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["repo_name", "commit_hash", "file_path"]


def watch_panel(spark: SparkSession, landing: str, schema: str, panel: str, checkpoint: str, recompute: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Append rows that landing gains to the panel table, a row for each key once; recompute gets the (repo, commit) pairs of each batch.

    No state is kept between batches: what the panel holds already is found by an anti-join with the commits of the batch.
    A batch is a partition of the panel by its number, which a retry overwrites, so no row is written twice.
    """
    fields = spark.createDataFrame([], schema).schema

    def held(number: int) -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(panel)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], fields)
        return spark.read.schema(f"{schema}, batch long").parquet(panel).where(F.col("batch") < number).select(*fields.names)

    def each(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(KEY)
        commits = own.select("repo_name", "commit_hash").distinct()
        old = held(number).join(commits, ["repo_name", "commit_hash"], "left_semi").select(*KEY)
        own.join(old, KEY, "left_anti").write.mode("overwrite").parquet(f"{panel}/batch={number}")
        if recompute is not None:
            recompute(commits)

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
