"""Reading the source tables from files or over JDBC, cast once to the declared layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.schema import SOURCE_SCHEMAS

FETCH_ROWS = 10_000


class Tables(Mapping):
    """Source tables by name; each is set up when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._made:
            self._made[table] = conform(self._makers[table](), table)
        return self._made[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def replacing(self, **tables: DataFrame) -> Tables:
        """The same tables with some of them replaced."""
        return Tables({**self._makers, **{n: (lambda df=df: df) for n, df in tables.items()}})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the declared columns of a source table, in order and with their declared types."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SOURCE_SCHEMAS[table].fields]
    )


def read_files(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """All source tables from ``root/<table>``; unused columns are never read."""
    return Tables(
        {
            table: (lambda path=f"{root}/{table}": spark.read.format(fmt).load(path))
            for table in SOURCE_SCHEMAS
        }
    )


def jdbc_options(
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    split: tuple[str, str, str, int] | None = None,
) -> dict[str, str]:
    """Options for one table. ``split`` is (column, lower, upper, parts) for a parallel read.

    Rows are fetched in chunks by each task. A lost connection fails one task, which Spark retries, so
    there is no retry loop here.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(FETCH_ROWS), **(properties or {})}
    if split:
        column, lower, upper, parts = split
        options |= {
            "partitionColumn": column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": str(parts),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    names: Mapping[str, str],
    properties: Mapping[str, str] | None = None,
    splits: Mapping[str, tuple[str, str, str, int]] | None = None,
) -> Tables:
    """Source tables over JDBC; ``names`` maps our table names to those in the database."""
    splits = splits or {}

    def load(table: str) -> DataFrame:
        options = jdbc_options(url, names[table], properties, splits.get(table))
        return spark.read.format("jdbc").options(**options).load()

    return Tables({table: (lambda table=table: load(table)) for table in names})
