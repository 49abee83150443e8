"""Cutting a long plan where a result is used again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: what follows plans from it alone, and a lost executor costs nothing before it.

    The folder is spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster must name a shared one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="snapgrain-"))
    return df.checkpoint()
