"""Reading, writing and replacing tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import name_scope


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_tree(spark: SparkSession, folder: str, pattern: str = "*.txt", limit: int | None = None) -> DataFrame:
    """One row for each file of folder/<entity>/<year>/<stem>/: file, entity, year, stem, name_scope, text and the sha256 of its bytes.

    Bytes that aren't UTF-8 become replacement characters; an empty file gives no row. `limit` keeps the first files in the order of their paths.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    parts = F.split(F.col("path"), "/")
    x = raw.select(
        F.col("path").alias("file"),
        F.element_at(parts, -4).alias("entity"),
        F.element_at(parts, -3).try_cast("int").alias("year"),
        F.element_at(parts, -2).alias("stem"),
        name_scope(F.element_at(parts, -2)).alias("name_scope"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.sha2("content", 256).alias("sha256"),
    )
    return x if limit is None else x.orderBy("file").limit(limit)


def latest_csv(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Rows of the file whose name sorts last; no rows if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    last = files.agg(F.max("path")).first()[0]
    return spark.read.csv(last, schema=schema, header=True) if last else spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line; fields that a line lacks are null, and a line that isn't JSON is a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The object of a file of any layout."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    return spark.sql(sql, args=parameters)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_partitions(new: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that new holds rows of."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rebuilt(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Every table written anew to folder/<name>, NaN as null, and how many rows each has (counted while they are written)."""
    counts = {}
    for name, df in tables.items():
        clean = df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])
        seen = Observation(name)
        clean.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = seen.get["n"]
    return counts


def built(selected: DataFrame, reports: DataFrame, facts: DataFrame, wide: DataFrame, panel: DataFrame, folder: str) -> None:
    """The four tables of a build: all reports, lines of the selected ones, wide rows and the panel, each by year."""
    used = facts.join(selected.select("file", "year"), "file")
    for name, df in (("reports", reports), ("facts", used), ("fundamentals", wide), ("panel", panel)):
        df.write.mode("overwrite").partitionBy("year").parquet(f"{folder}/{name}")


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_markdown(reports: DataFrame, path: str) -> None:
    """reports(report, markdown) as text files, one folder for each report."""
    reports.select("report", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("report").text(path)


_stored: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a session on this machine alone may do without that setting, a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlake-")
        atexit.register(shutil.rmtree, folder, True)
    return f"{folder.rstrip('/')}/ledgerlake-{uuid.uuid4().hex}"


#: Bytes of a method from which on the JVM (HotSpot) never compiles it and interprets it for every row.
COMPILED = 8000
_METHODS = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within it Spark makes several small methods of a stage of many expressions where one would be too large for the JVM to compile."""
    before = spark.conf.get(_METHODS)
    spark.conf.set(_METHODS, min(int(before), COMPILED))
    try:
        yield
    finally:
        spark.conf.set(_METHODS, before)


def saved(df: DataFrame) -> DataFrame:
    """Written once and read back: later steps depend neither on lost executors nor on computing it again."""
    path = scratch(df.sparkSession)
    with small_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` gives for a source, written once in a session and read back from then on.

    A source that changes under the same path needs a new session.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _stored:
        path = f"{scratch(spark)}/{name}"
        df = build()
        with small_methods(spark):
            df.write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
