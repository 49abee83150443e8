"""Session helpers: the shared folder, stored intermediate tables, Arrow batch access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python; keeps a batch of long texts small.
BATCH_ROWS = "1000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a temporary one of the single machine that a local master has; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(sc, "_snapgrain_shared", None)
        if found is None:
            found = sc._snapgrain_shared = "file://" + tempfile.mkdtemp(prefix="snapgrain-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_scratch: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at its end: what is read from them must have been written elsewhere by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            remove_path(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends here and no executor's loss can undo it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a light table that one partition holds at least, so that small tables are not spread over many tiny files.
LIGHT_ROWS = 100_000


def settled(df: DataFrame, rows: int) -> DataFrame:
    """df, a light table of at most about that many rows, checkpointed in as few partitions as suit them."""
    return df.coalesce(max(1, -(-rows // LIGHT_ROWS))).checkpoint()


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores in front as long as a name of names (in any case) is like it."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying each text; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def released() -> None:
    """Gives free memory back to the system: a worker that Spark keeps for later tasks would else hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]
