"""What the text operators share: input columns, white space, case, stored intermediates and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a missing text is empty.

    Other columns are left out at once, so their names cannot clash with an operator's own.
    """
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def without(docs: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """The documents with no match in ``gone``, all columns. In ``on`` a document's columns are fields of ``row``, so that
    no name of theirs clashes with one of ``gone``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, on, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts without other letters take the fast way, which gives the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as decimal text; the learned operators hold rows out by its remainder."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def sha_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text, for choosing a number of partitions."""
    return docs.select(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0


def partitions_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece holds at most ``limit`` bytes of ``column``, or one row."""
    sizes = offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def offsets(values: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, also of a slice of one."""
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind, count=len(values) + 1 + values.offset)[values.offset :].astype(np.int64) if len(values) else np.zeros(1, np.int64)


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and where each value starts; no copy is made."""
    at = offsets(values)
    data = np.frombuffer(values.buffers()[2], np.uint8) if len(values) and values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]
