"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_scope: ContextVar[str] = ContextVar("scope", default="")
_instead: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; without one there is an error, whatever the master is."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or _instead.get(spark.sparkContext.applicationId)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return folder.rstrip("/")


def use_warehouse_where_unset(spark: SparkSession) -> None:
    """From now on a folder in the warehouse, which executors share, serves a session that names no shared folder."""
    if not spark.conf.get(CHECKPOINT_KEY, None):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _instead[spark.sparkContext.applicationId] = f"{warehouse}/_intermediate"


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """What is written within goes to a folder of its own, which is deleted in the end.

    A result that reads intermediates has to be read or written before the scope closes.
    """
    folder = f"{shared_folder(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scope.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Several branches then read the result, each only its columns, without repeating the work before it, and
    a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written in buckets of ``key`` and read back as a table whose layout Spark knows.

    Groups, windows and joins that have the key among theirs then need no shuffle. Rows should be reduced before, so that
    one value of the key has a bounded number.
    """
    spark = df.sparkSession
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(number, key).write.bucketBy(number, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def written_together(**frames: DataFrame) -> dict[str, DataFrame]:
    """Frames that do not need each other, written side by side and read back; each by its name."""
    with ThreadPoolExecutor(len(frames)) as pool:
        jobs = {name: pool.submit(copy_context().run, written, df, name.replace("_", "-")) for name, df in frames.items()}
        return {name: job.result() for name, job in jobs.items()}
