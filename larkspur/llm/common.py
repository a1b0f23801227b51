"""Helpers that the corpus operators share: scratch tables, Arrow text views, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: space and the controls 09 to 0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Python workers return large arrays to the system when they are freed, and share one heap.
MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound what one Arrow batch holds, and give freed memory back.

    Only settings of Python workers and of Arrow transfer change; both hold for this session.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session or its context; a temporary one only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "LARKSPUR_SCRATCH" not in os.environ:  # a folder of the user's choice, on a local master
        os.environ["LARKSPUR_SCRATCH"] = tempfile.mkdtemp(prefix="larkspur-")
    return os.environ["LARKSPUR_SCRATCH"]


class Scratch:
    """Tables in the shared checkpoint folder, which cut lineage and outlive lost executors.

    The folder is ``shared_folder``'s.
    """

    def __init__(self, spark: SparkSession):
        self.spark = prepared(spark)
        self.base = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; the path is kept in the result's ``scratch_path``."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder with its partitioning kept."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def text_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying its text; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_bytes(column: pa.Array) -> list[bytes]:
    raw, at = text_view(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def groups_of(at: np.ndarray, limit: int):
    """Ranges (first, last) of texts whose bytes add up to about limit; a longer text stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def slices(batch: pa.RecordBatch, text: int, rows: int = 64, size: int = 1 << 19):
    """Slices of at most ``rows`` rows and about ``size`` bytes in the column text; a longer text is alone."""
    at = text_view(batch.column(text))[1]
    for a, b in groups_of(at, size):
        for i in range(a, b, rows):
            yield batch.slice(i, min(rows, b - i))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of an undirected graph given as long columns (a, b).

    Alternating large-star and small-star steps: every step is a grouped minimum and a join, so
    no component meets in one task.  component is the smallest node that can be reached; nodes
    without an edge do not appear.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == size or size[0] == 0:
            break
        seen = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        scratch.drop(now, large)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
