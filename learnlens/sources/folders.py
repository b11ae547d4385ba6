"""The files of a store, as folders of one sync and day, and the manifest that says which of them a state is made of.

``<store>/sync=<label>/day=<date>`` holds the rows that a sync added to a day (a store without days has no second level). A
manifest lists the live folders of a state with their number of rows. A reader opens exactly those, so
folders of an unfinished or newer state do not show, and merging folders is writing a new one and naming it instead of the old ones.
There are a few folders a day, so a manifest has a few rows for each day of the data and is handled by the driver.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterable
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from learnlens.sources import scratch

MANIFEST = "store string, day date, label string, rows bigint, digest decimal(38,0)"
MOST_FOLDERS = 4
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: how Spark names the folder of a missing day


class Folder(NamedTuple):
    store: str
    day: dt.date | None
    label: str
    rows: int
    digest: Decimal | None = None


class Written(NamedTuple):
    """New folders, and the range of their time."""

    folders: list[Folder]
    low: dt.datetime | None = None
    high: dt.datetime | None = None


def read_manifest(spark: SparkSession, root: str, sync: int) -> list[Folder]:
    return [Folder(*row) for row in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/sync={sync}").collect()]


def write_manifest(spark: SparkSession, root: str, sync: int, folders: Iterable[Folder]) -> None:
    columns = [*zip(*folders, strict=True)] or [()] * len(Folder._fields)
    types = [pa.string(), pa.date32(), pa.string(), pa.int64(), pa.decimal128(38, 0)]
    table = pa.table({name: pa.array(column, kind) for name, column, kind in zip(Folder._fields, columns, types, strict=True)})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/sync={sync}")


def row_hash(columns: Iterable[str]) -> Column:
    """A hash of a row in which a missing value differs from an empty one."""
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns])


def digest(columns: Iterable[str]) -> Column:
    """A sum over rows that does not depend on their order; sums of folders add up."""
    return F.sum(row_hash(columns).cast("decimal(38,0)"))


def of_days(df: DataFrame, days: Iterable[dt.date | None]) -> DataFrame:
    found = set(days)
    dated = F.col("day").isin(sorted(d for d in found if d is not None))
    return df.where(dated | F.col("day").isNull() if None in found else dated)


class Folders:
    """The folders of one store with a fixed layout, below a root; ``digested`` ones of days are compared by their digest."""

    def __init__(self, spark: SparkSession, root: str, store: str, layout: T.StructType, time: str | None, digested: bool = False):
        self.spark, self.root, self.store, self.time, self.digested = spark, root, store, time, digested
        self.layout = T.StructType(layout.fields)

    def _path(self, folder: Folder) -> str:
        day = f"/day={folder.day or NO_DAY}" if self.time else ""
        return f"{self.root}/{self.store}/sync={folder.label}{day}"

    def _schema(self) -> T.StructType:
        parts = [T.StructField("sync", T.StringType())] + ([T.StructField("day", T.DateType())] if self.time else [])
        return T.StructType(self.layout.fields + parts)

    def open(self, folders: list[Folder]) -> DataFrame:
        """The rows of the folders, with their day where the store has days."""
        if not folders:
            return self.spark.createDataFrame([], self._schema()).drop("sync")
        reader = self.spark.read.schema(self._schema()).option("basePath", f"{self.root}/{self.store}")
        return reader.parquet(*[self._path(f) for f in folders]).drop("sync")

    def write(self, df: DataFrame, label: str) -> list[Folder]:
        return self.add(df, label).folders

    def add(self, df: DataFrame, label: str) -> Written:
        """Adds rows under a label.

        Rows are gathered by day first, so that a folder has as many files as its size asks for and not one per task; adaptive
        execution splits a large day and puts small ones together. Files are sorted by time.
        """
        path = f"{self.root}/{self.store}/sync={label}"
        rows = df.select(*self.layout.names)
        if not self.time:
            rows.write.mode("overwrite").parquet(path)
            n = self.spark.read.schema(self.layout).parquet(path).count()
            return Written([Folder(self.store, None, label, n)] if n else [])
        dated = rows.withColumn("day", F.to_date(self.time)).hint("rebalance", "day")
        dated.sortWithinPartitions("day", self.time).write.partitionBy("day").mode("overwrite").parquet(path)
        schema = T.StructType([*self.layout.fields, T.StructField("day", T.DateType())])
        found = self.spark.read.schema(schema).parquet(path).groupBy("day").agg(
            F.count(F.lit(1)).alias("rows"),
            (digest(self.layout.names) if self.digested else F.lit(None)).alias("digest"),
            F.min(self.time).alias("low"),
            F.max(self.time).alias("high"),
        )
        days = found.collect()
        dated = [r for r in days if r["low"] is not None]
        return Written(
            [Folder(self.store, r["day"], label, r["rows"], r["digest"]) for r in days],
            min((r["low"] for r in dated), default=None),
            max((r["high"] for r in dated), default=None),
        )

    def merged(self, folders: list[Folder], label: str, most: int = MOST_FOLDERS, all_of_them: bool = False) -> list[Folder]:
        """The same rows in at most about ``most`` folders a day; ``all_of_them`` leaves one folder for each day with more.

        Of a day with more folders those that are small beside each other are rewritten as one: from the smallest on, as long as
        the next is at most twice as large as all before it. So the folders left grow by factors, there are a logarithm of
        them, and a row is rewritten a logarithm of times however many syncs there are.
        """
        by_day: dict[dt.date | None, list[Folder]] = defaultdict(list)
        for folder in folders:
            by_day[folder.day].append(folder)
        chosen = [f for of_day in by_day.values() if len(of_day) > most for f in (of_day if all_of_them else _alike(of_day))]
        if not chosen:
            return folders
        return [f for f in folders if f not in chosen] + self.write(self.open(chosen), label)


def _alike(folders: list[Folder]) -> list[Folder]:
    ordered = sorted(folders, key=lambda f: f.rows)
    taken, total = 1, ordered[0].rows
    while taken < len(ordered) and ordered[taken].rows <= 2 * total:
        total += ordered[taken].rows
        taken += 1
    return ordered[:taken] if taken > 1 else []


def remove_unused(spark: SparkSession, root: str, old: list[Folder], live: list[Folder]) -> None:
    """Deletes the folders of ``old`` that are not in ``live``."""
    labels = {(f.store, f.label) for f in live}
    kept = {(f.store, f.label, f.day) for f in live}
    gone = {f"{f.store}/sync={f.label}" for f in old if (f.store, f.label) not in labels}
    gone |= {
        f"{f.store}/sync={f.label}/day={f.day or NO_DAY}" for f in old if (f.store, f.label) in labels and (f.store, f.label, f.day) not in kept
    }
    for folder in sorted(gone):
        scratch.delete(spark, f"{root}/{folder}")
