"""Line dedup by range partitions of line hashes, with keep bitmaps per document as its result.

Lines become rows of two 64-bit hashes, document and position; no text is shuffled to find repeats. Rows are range
partitioned by hash and slot and sorted by document and position, and one pass over each run streams the first document
that holds a line. A slot is a remainder of the document, so that a line of a third of all documents is spread over
``slots`` runs. Within a run, lines of later documents are settled: they go. Only the lines of each run's first document
take a second pass, sorted by hash alone, which settles them between the slots. There is no join in the search and
no window over all the holders of a line.

The result is a bitmap per document, in words of 64 lines, in which words whose lines all stay are left out. ``apply``
puts bitmaps on documents.

Only DataFrame and SQL functions are used.

Defined results: a null or empty text has one empty line. Keys shorter than ``min_chars`` code points never go. Repeats
within one document stay when the document is the first that holds the line. Rows that share a doc_id count as one
document; their bitmaps are kept apart by a hash of the text. Rows without an id neither lose lines nor make others
lose them. An empty table gives an empty result. Other columns are not read, and ``apply`` keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from learnlens.llm.base import WHITE, ascii_lower, documents, id_and_text
from learnlens.sources.scratch import written

SLOTS = 32
MIN_CHARS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row per line that may be dropped: doc_id, body (hash of the text), pos and the two hashes of the line's key."""
    rows = id_and_text(docs).where("doc_id is not null")
    lines = rows.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    trimmed = lines.select("doc_id", "body", "pos", F.btrim("line", F.lit(WHITE)).alias("line"))
    keyed = trimmed.where(F.char_length("line") >= min_chars).withColumn("line", ascii_lower(F.col("line")))
    return keyed.select("doc_id", "body", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def dropped_lines(lines: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The lines that go: doc_id, body, pos."""
    slotted = lines.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
    ranged = slotted.repartitionByRange("h1", "h2", "slot")
    in_run = Window.partitionBy("h1", "h2", "slot").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = written(ranged.withColumn("later", F.first("doc_id").over(in_run) != F.col("doc_id")).drop("slot"), "line-runs")

    heads = runs.where(~F.col("later")).drop("later").repartitionByRange("h1", "h2")
    over_slots = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    late_heads = heads.withColumn("later", F.first("doc_id").over(over_slots) != F.col("doc_id")).where("later")
    picked = ["doc_id", "body", "pos"]
    return runs.where("later").select(picked).unionByName(late_heads.select(picked))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, slots: int = SLOTS) -> DataFrame:
    """doc_id, body, n_dropped and ``keep``: map from the number of a word of 64 lines to its bits, 1 for lines that stay.

    Words that are not in the map have all lines kept; documents that lose no line have no row.
    """
    gone = dropped_lines(line_rows(docs, min_chars), slots)
    # a set: rows that repeat a whole document name the same line twice
    bits = gone.groupBy("doc_id", "body", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    return bits.groupBy("doc_id", "body").agg(
        F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))).alias("keep"),
    )


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per document, which has doc_id and text: ``row`` (all its columns), ``text`` of the lines that stay, n_lines, n_dropped."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    marks = bitmaps.select("doc_id", "body", "n_dropped", "keep")
    joined = rows.join(marks, (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(text) == F.col("body")), "left")
    word = lambda i: F.coalesce(F.try_element_at("keep", F.shiftright(i, 6)), F.lit(-1).cast("long"))
    lines = lines_of(F.col("row.text"))
    kept = F.array_join(F.filter(lines, lambda line, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 1), "\n")
    return joined.select(
        "row",
        F.when(F.col("keep").isNull(), F.col("row.text").cast("string")).otherwise(kept).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = apply(docs.select("doc_id", "text"), keep_bitmaps(docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, all columns; ``n_chars``, where there is one, counts the new text."""
    out = apply(docs, keep_bitmaps(docs))
    of = lambda c: F.col(f"row.`{c}`")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNull(), of("n_chars")).otherwise(F.char_length("text").cast("long"))
    return out.select(*[changed.get(c, of(c)).alias(c) for c in docs.columns])


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
)
SELECT doc_id, count(*) AS n_lines, count(first) FILTER (WHERE doc_id <> first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
