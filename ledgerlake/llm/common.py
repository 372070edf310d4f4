"""Shared plumbing: folders that all executors see, package shipping, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch on its way to a Python worker, at most (a longer row is a batch of its own).
BATCH = 8 << 20


#: How Python workers get memory: blocks of 8 MB and more go back to the system when they are freed, so a worker that waits for
#: its next task doesn't hold what the last one needed. Smaller ones are used again, which costs less time.
LARGE = 8 << 20
MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(LARGE), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package where its folder exists, and bound what they get at once and keep."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    _bound_own_memory()


def _bound_own_memory() -> None:
    """The same for this process, the driver, which has started already."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not glibc
        pass


def give_back() -> None:
    """Return memory that nothing uses any more to the system, where the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and the session is on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "ledgerlake-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; its owner cleans the folder
        pass


def save(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def prefix_sums(df: DataFrame, key: str, value: str, out: str, within: list[str] | None = None, span: int = 1024) -> DataFrame:
    """Sum of `value` over smaller `key`s, in two levels: inside groups of `span` keys, then over groups.

    `key` is a dense integer (a partition number), one row for each key and `within` group. The window over
    groups has one row for every `span` keys.
    """
    by = list(within or [])
    x = df.withColumn("_g", F.floor(F.col(key) / span))
    tops = x.groupBy(*by, "_g").agg(F.sum(value).alias("_t"))
    up = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.coalesce(F.sum("_t").over(up), F.lit(0))).drop("_t")
    low = Window.partitionBy(*by, "_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum(value).over(low), F.lit(0)))
    return x.join(tops, [*by, "_g"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_g", "_before", "_in")


class HashIndex:
    """Positions of 64-bit keys: direct addressing by the leading bits, then a short scan."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(0))
        n = len(keys)
        self.bits = max(1, min(22, int(n).bit_length() + 1))
        top = (self.keys[:n] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if n else 0
        self.n = n

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index into the original keys, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not self.n or not len(h):
            return out
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        live = None
        for _ in range(self.longest):
            if live is None:
                hit = self.keys[at] == h
                out[hit] = self.order[at[hit]]
                live = np.flatnonzero(~hit & (self.keys[at] < h) & (at + 1 < self.n))
            else:
                k = at[live]
                hit = self.keys[k] == h[live]
                out[live[hit]] = self.order[k[hit]]
                live = live[~hit & (self.keys[k] < h[live]) & (k + 1 < self.n)]
            if not len(live):
                break
            at[live] += 1
        return out
