"""The incremental refresh driven by arriving files instead of a clock.

Each micro-batch of new attempt records is one sync of the store. Records may arrive in any order, so the
newest stored time is no lower bound here. A batch that is replayed after a failure adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from learnlens.schema import SOURCE_SCHEMAS
from learnlens.sources.readers import Tables
from learnlens.sources.snapshots import SnapshotStore


def attempt_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """New attempt records as files arrive under ``path``."""
    return spark.readStream.schema(SOURCE_SCHEMAS["question_attempts"]).format(fmt).load(path)


def refresh_on_arrival(
    arriving: DataFrame,
    tables: Tables,
    store: SnapshotStore,
    checkpoint: str,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
) -> StreamingQuery:
    """Start a stream that syncs the store with every batch of arriving records and then stops.

    ``tables`` gives the other source tables, read anew for each batch.
    """

    def sync(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.absorb(tables.replacing(question_attempts=batch), clock())

    return (
        arriving.writeStream.foreachBatch(sync)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
