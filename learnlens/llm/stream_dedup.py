"""Exact dedup as a stateful stream: every distinct text is remembered in keyed state that never expires.

The stream groups rows by the digest of their normalised text. Its state lives in RocksDB on the executors' disks, with
its changes in the shared folder, and holds per digest the stable identifier and content locator (file and row) of the
first copy and the number of rows. There is no watermark, so nothing is forgotten, and a later run with the same
folder goes on where the last one stopped. The state is then read as a table.

A digest met more than once is a hit, and hits are confirmed on full bytes: texts whose digest was hit are grouped by
digest and whole text. Digests under which different texts met are grouped again by the texts themselves.

Only DataFrame and SQL functions run on the executors. A digest's rows are counted before they are shuffled, and so are
the copies of a text; joins by digest carry no text and are left to adaptive skew handling. Which texts to confirm is told
while scanning by a bitmap of the hits, of fixed size; where it is wrong, a text is grouped for nothing.

Defined results: a null text counts as empty, and empty texts equal each other. Of equal texts the smallest doc_id stays;
rows without an id come after all others; among rows with one id the first by file and position stays, so that
exactly one row of a group is kept. Repeated rows are copies like any others. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from learnlens.llm.base import WHITE_RUN
from learnlens.sources.scratch import new_path, written

FILTER_BITS = 1 << 23
STORE = "spark.sql.streaming.stateStore."
SETTINGS = {
    STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a store holds disk and memory only while its task runs, and no more than its content
    STORE + "unloadOnCommit": "true",
    STORE + "rocksdb.allowFAllocate": "false",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Sets the state store for the streams and state readers that start within."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, normalised text and the struct by which copies are ordered, of rows read from files."""
    identifier = F.col(f"`{doc_id}`").cast("long")
    norm = normalised(F.col(f"`{text}`").cast("string"))
    place = F.struct(identifier.isNull().alias("no_id"), identifier.alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(place.alias("place"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def _pattern(path: str) -> str:
    """The path as a pattern for itself alone: a stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def remember(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, doc_id: str = "doc_id", text: str = "text", max_bytes_per_trigger: int = 64 << 30, digest: Callable[[Column], Column] = sha256) -> None:
    """Takes all files of ``path`` not seen by earlier runs into the state kept under ``checkpoint``.

    The state has as many partitions as the session's shuffles have at the first run.
    """
    arriving = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(_pattern(path))
    seen = _located(arriving, doc_id, text, digest).groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    with disk_state(spark):
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, first (id and locator of the first copy) and n."""
    state = spark.read.format("statestore").load(checkpoint)
    first, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{first}`").alias("first"), F.col(f"value.`{n}`").alias("n"))


def hit_filter(hits: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that holds for every digest in ``hits`` and few others, by a bitmap of ``bits`` bits in words of 64."""
    spark = hits.sparkSession
    bit = lambda digest: F.pmod(F.xxhash64(digest), F.lit(bits))
    words = hits.select(bit(F.col("digest")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    dense = spark.range(bits // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("entry"))
    bitmap = dense.agg(F.transform(F.sort_array(F.collect_list("entry")), lambda entry: entry["word"]).alias("bitmap")).scalar()
    return lambda digest: F.getbit(F.element_at(bitmap, (F.shiftright(bit(digest), 6) + 1).cast("int")), bit(digest).bitwiseAND(F.lit(63)).cast("int")) == 1


def decide(spark: SparkSession, path: str, schema: T.StructType, known: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``path``: doc_id, keep_id, group_size, kept, text_sha256."""
    with disk_state(spark):
        hits = written(known.where("n > 1").select("digest", "first", "n"), "hits")
    rows = _located(spark.read.schema(schema).parquet(path), doc_id, text, digest)

    suspects = rows.where(hit_filter(hits, filter_bits)(F.col("digest"))).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("copies"))
    texts = suspects.join(hits, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    mixed = written(texts.where("texts > 1").select("digest"), "mixed")

    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    settled = rows.select("digest", "place", sha.alias("sha"), "norm")
    if not mixed.isEmpty():
        unsound = settled.join(mixed, "digest", "left_semi")
        regrouped = unsound.groupBy("digest", "norm").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        unsound = unsound.join(regrouped, ["digest", "norm"]).select("place", "first", "n", "sha")
        settled = settled.join(mixed, "digest", "left_anti")
    settled = settled.drop("norm").join(hits, "digest", "left").select("place", "first", "n", "sha")
    if not mixed.isEmpty():
        settled = settled.unionByName(unsound)
    first = F.coalesce("first", "place")
    return settled.select(
        F.col("place.id").alias("doc_id"),
        first["id"].alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("place") == first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", max_bytes_per_trigger: int = 64 << 30, digest: Callable[[Column], Column] = sha256, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Decisions for all rows of the Parquet files at ``path``, by a stream over them with state of its own."""
    schema = spark.read.parquet(path).schema
    checkpoint = new_path(spark, "dedup-stream")
    remember(spark, path, schema, checkpoint, doc_id, text, max_bytes_per_trigger, digest)
    return decide(spark, path, schema, remembered(spark, checkpoint), doc_id, text, digest, filter_bits)


def op10_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
