"""What the operators ask of the session: a shared folder to cut lineage in, and its partition counts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local session makes one; on a cluster that is an error, since executors could not read it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that these operators wrote, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one call of an operator, in the shared folder: lineage ends in each, so a lost executor costs nothing before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back."""
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Removes a table of this scratch that nothing reads any more."""
        removed(self.spark, table.scratch_path)

    def close(self) -> None:
        """Removes all tables; only once what was made of them is written elsewhere."""
        removed(self.spark, self.root)
        settled(self.spark)


def settled(spark: SparkSession) -> None:
    """Has the JVMs collect what finished plans left.

    Only then do shuffle files and generated classes go on the driver. Executors otherwise let their heaps grow over garbage
    up to the limit, and keep native buffers whose owners are garbage; a full collection gives both back to the system.
    """
    context = spark.sparkContext
    context._jvm.System.gc()
    if context.master.partition("[")[0] != "local":
        n = context.defaultParallelism  # a task a core, so that each executor has one
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def small_plans(spark: SparkSession) -> Iterator[None]:
    """For many short jobs in a row: plans without whole-stage code, whose classes would fill the driver's memory before they repay."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; the table stays, since results are read from it lazily."""
    return Scratch(df.sparkSession, name).write(df, name)


def arrow_rows(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows, since texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def handed_back() -> None:
    """Has a Python worker return what it freed to the system: workers wait for their next task with the most that they ever held, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another libc than glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work: Callable) -> Callable:
    """``work`` of a Python worker, batches to batches or tables to a table, that hands memory back when it is over."""

    @functools.wraps(work)
    def table(*args):
        try:
            return work(*args)
        finally:
            handed_back()

    @functools.wraps(work)
    def batches(*args):
        try:
            yield from work(*args)
        finally:
            handed_back()

    made = batches if inspect.isgeneratorfunction(work) else table
    made.__signature__ = inspect.signature(work)  # Spark counts arguments
    return made
