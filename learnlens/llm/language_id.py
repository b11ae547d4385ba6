"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, and its 1- to 3-grams of characters are hashed to
``BUCKETS`` buckets; n-grams that begin with two spaces are left out. Learning counts buckets per language in Spark,
over at most about ``per_language`` rows of each language, chosen by a hash of the id so that the choice is the same on
every run. The matrix of log probabilities has BUCKETS rows and a column per language and is broadcast: its size is bounded by
``max_languages``. Scoring sums, per document, the matrix rows of all its n-grams (a sparse count vector times the matrix).

``score`` is the posterior of the language when the mean evidence per n-gram is counted ``EVIDENCE`` times at most, so that
long texts do not all score 1.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was
learned. Rows without an id or language are not learned from; a row without an id counts as held out. Equal scores go to
the language that sorts first. Repeated rows are scored each. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from learnlens.llm.base import crc_of_id, documents, joined_bytes, slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
EVIDENCE = 32
UNKNOWN = "und"
PER_LANGUAGE = 4000
MAX_LANGUAGES = 512
SMOOTHING = 0.5
SLICE_BYTES = 2 << 20
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def hashed_ngrams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the bucket at each character (BUCKETS where there is no n-gram); where texts start; which have a letter."""
    low = pc.utf8_lower(texts)
    data, _ = joined_bytes(low)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.asarray(pc.utf8_length(low)), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    is_letter = letters()[points]
    count = np.concatenate([[0], np.cumsum(is_letter)])
    points = np.where(is_letter, points, np.uint32(32))
    after = np.concatenate([points[1:], np.full(1, 32, np.uint32)]) if len(points) else points
    after[ends[ends > starts] - 1] = 32  # what follows a text is a space, not the text beside it in the batch
    blank = (points == 32) & (after == 32)
    found = []
    for order in ORDERS:
        mixed = np.zeros(len(points), np.uint32)
        for k in range(min(order, len(points))):
            mixed[: len(points) - k] += points[k:] * np.uint32(MULTIPLIERS[k] + 2 * order & 0xFFFFFFFF)
        bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(MULTIPLIERS[3]) >> np.uint32(16)).astype(np.int32)
        bucket[blank] = BUCKETS
        for k in range(1, order):  # n-grams that would reach into the next text
            last = ends - k
            bucket[last[last >= starts]] = BUCKETS
        found.append(bucket)
    return found, starts, count[ends] > count[starts]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            langs = np.asarray(piece.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                grams, _, _ = hashed_ngrams(piece.column("text").filter(pa.array(langs == lang)))
                mine = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for bucket in grams:
                    mine += np.bincount(bucket, minlength=BUCKETS + 1)
    for lang, mine in totals.items():
        at = np.flatnonzero(mine[:BUCKETS])
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(mine[at])})


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log probabilities with a last row of zeros, from rows not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null").where(crc_of_id(F.col("doc_id")) % 4 != 2)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0))
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < min(1.0, per_language / n) * (1 << 20)))
    counts = rows.where(chosen).select("text", "lang").mapInArrow(_counted, "lang string, bucket int, n long")
    langs = sorted(sizes)
    matrix = np.full((BUCKETS + 1, len(langs)), SMOOTHING)
    # at most BUCKETS rows a language, as Arrow columns: rows as Python objects would stay in the driver's memory
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    of_lang = pc.index_in(found["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    matrix[found["bucket"].to_numpy(), of_lang] += found["n"].to_numpy()
    matrix = np.log(matrix / matrix[:BUCKETS].sum(axis=0))
    matrix[BUCKETS] = 0
    return langs, matrix


def score_texts(texts: pa.Array, langs: list[str], matrix: np.ndarray, most: float = EVIDENCE) -> tuple[list[str], np.ndarray]:
    texts = pc.fill_null(texts, "")
    grams, starts, has_letter = hashed_ngrams(texts)
    total, number = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    filled = np.flatnonzero(np.diff(np.append(starts, len(grams[0]))))
    if len(filled) and langs:
        at = starts[filled]
        for bucket in grams:
            number[filled] += np.add.reduceat((bucket < BUCKETS).astype(np.float64), at)
            for k in range(len(langs)):
                total[filled, k] += np.add.reduceat(np.ascontiguousarray(matrix[:, k])[bucket], at)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    evidence = total * (np.minimum(number, most) / np.maximum(number, 1))[:, None]
    posterior = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = posterior.argmax(axis=1)
    known = has_letter & (number > 0)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, posterior[np.arange(len(best)), best], 0.0)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                pred, score = score_texts(piece.column("text"), names, table)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    held_out = F.coalesce(crc_of_id(F.col("doc_id").cast("long")) % 4 == 2, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least ``least_score`` by all their n-grams; all columns stay.

    The rows themselves pass through the scorer, so no join by id is needed and repeated ids do no harm.
    """
    langs, matrix = learn(docs)
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                pred, score = score_texts(piece.column("text"), names, table, np.inf)
                stays = np.array([p != UNKNOWN for p in pred], bool) & (score >= least_score)
                yield pa.record_batch({"row": piece.column("row").filter(pa.array(stays))})

    out = kept.mapInArrow(passed, T.StructType([T.StructField("row", kept.schema["row"].dataType)]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, *learn(docs))
