"""Quality by an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Every run of white space is one character, and texts begin with ``ORDER`` - 1 start characters. Characters are UTF-16 code units, so one
beyond the basic plane is two, and an n-gram is packed into one long. All texts are scored and all trusted texts are counted, but for those
whose crc32(doc_id as text) is a multiple of ``HELD_OUT``: they give the thresholds.

1. A scan counts, per block of rows, the n-grams of trusted texts, and lists the n-grams of all texts.
2. Summed over the blocks, the counts are sharded by n-gram. Grouping by suffix gives the continuation counts of the lower
   orders, grouping by context the totals and back-off weights. Discounts come from the counts of counts of each order.
3. The distinct n-grams of the corpus are scored once, by joins with the count shards of each order.
4. The scores go back to the blocks that need them, and a second scan sums them per document.

So neither texts nor occurrences are shuffled, only distinct n-grams of blocks, and the model is never broadcast or collected.

A document is kept if its perplexity is not above ``threshold``: the ``quantile`` of the perplexities of its language's trusted texts
that were held out of the counts. A language with fewer than ``LEAST`` of them, also a missing one, takes the quantile over all that
were held out; if these are fewer than ``LEAST`` too, over all trusted texts.

Defined results: a null or empty text, or one of white space alone, has no perplexity and is not kept. Without any trusted text all
characters are alike and everything else is kept. Repeated rows are counted and scored each. A row without an id is
never trusted but scored. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnlens.llm.base import crc_of_id, documents, joined_bytes, slices, table
from learnlens.llm.blocks import block, in_files, read_block, row_in_block, write_blocks
from learnlens.sources.scratch import written

ORDER = 4
START = 2
QUANTILE, HELD_OUT, LEAST = 0.99, 10, 20
SLICE_BYTES = 4 << 20
HELD_NGRAMS = 4 << 20


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams that end at each character, and where each text's begin (one more than texts)."""
    trimmed = pc.utf8_trim(pc.replace_substring_regex(texts, r"[\s\x0b]+", " "), " ")
    data, _ = joined_bytes(trimmed)
    units = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-16-le"), np.uint16)
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(trimmed), np.int64))])
    if starts[-1] < len(units):  # some characters are two units, of which the second is 0xDC00 to 0xDFFF
        starts = np.append(np.flatnonzero(units & 0xFC00 != 0xDC00), len(units))[starts]
    lengths, pad = np.diff(starts), ORDER - 1
    padded = np.full(len(units) + pad * len(lengths), START, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(units)) + pad * (owner + 1)
    padded[at] = units
    packed = np.zeros(len(units), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | padded[at - pad + k]
    return packed.view(np.int64), starts


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)


def block_ngrams(docs: DataFrame, trusted: str) -> DataFrame:
    """block, gram, n (occurrences in trusted texts), for every n-gram of each block's texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, grams, counts, held = None, np.zeros(0, np.int64), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if grams:
                distinct, n = _summed(grams, counts)
                yield pa.record_batch({"block": pa.array(np.full(len(distinct), name, np.int64)), "gram": pa.array(distinct), "n": pa.array(n)})

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                names = np.asarray(piece.column("block"))
                for run in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                    mine = piece.slice(int(run[0]), len(run))
                    if names[run[0]] != name:
                        yield from out()
                        name, grams, counts, held = int(names[run[0]]), [], [], 0
                        found = read_block(trusted, name, ["row"])
                        rows = np.zeros(0, np.int64) if found is None else np.asarray(found.column("row"))
                    packed, starts = ngrams(mine.column("text"))
                    good = np.repeat(np.isin(np.asarray(mine.column("row")), rows), np.diff(starts))
                    distinct, inverse = np.unique(packed, return_inverse=True)
                    grams.append(distinct)
                    counts.append(np.bincount(inverse, good, len(distinct)).astype(np.int64))
                    held += len(distinct)
                    if held > HELD_NGRAMS:
                        distinct, n = _summed(grams, counts)
                        grams, counts, held = [distinct], [n], 0 if len(distinct) < HELD_NGRAMS // 2 else held // 2
        yield from out()

    rows = docs.select(block().alias("block"), row_in_block().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "block long, gram long, n long")


def suffix(gram: Column, order: int) -> Column:
    """The last ``order`` characters of a packed n-gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def context(gram: Column) -> Column:
    """All characters but the last."""
    return F.shiftrightunsigned(gram, 16)


class Model:
    """The count shards of each order: table ``grams`` (gram, n) and ``contexts`` (context, total, weight), and discounts."""

    def __init__(self, counts: DataFrame):
        self.grams: dict[int, DataFrame] = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):
            higher = self.grams[order + 1]
            self.grams[order] = written(higher.groupBy(suffix(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
        self.discounts: dict[int, list[float]] = {}
        self.contexts: dict[int, DataFrame] = {}
        for order, grams in self.grams.items():
            one = grams.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
            self.discounts[order] = discounts(*one)
            kinds = [F.count(F.when(F.col("n") == k if k < 3 else F.col("n") >= 3, 1)) for k in (1, 2, 3)]
            weight = sum(d * kind for d, kind in zip(self.discounts[order], kinds, strict=True)) / F.sum("n")
            self.contexts[order] = written(grams.groupBy(context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), weight.alias("weight")), f"contexts-{order}")
        self.characters = self.grams[1].count() + 1

    def scored(self, grams: DataFrame) -> DataFrame:
        """gram and the logarithm of its last character's probability after the others."""
        out = grams.select("gram").withColumn("p", F.lit(1.0 / self.characters))
        for order in range(1, ORDER + 1):
            key, before = suffix(F.col("gram"), order), context(suffix(F.col("gram"), order))
            mine = self.grams[order].select(F.col("gram").alias("key"), "n")
            theirs = self.contexts[order].select(F.col("context").alias("before"), "total", "weight")
            if order == 1:  # one context: a row of totals
                row = theirs.first()
                total, weight = (row["total"], row["weight"]) if row else (None, None)
                joined = out.withColumn("key", key).join(mine, "key", "left").withColumns({"total": F.lit(total).cast("long"), "weight": F.lit(weight).cast("double")})
            else:
                joined = out.withColumn("key", key).join(mine, "key", "left").withColumn("before", before).join(theirs, "before", "left")
            d1, d2, d3 = self.discounts[order]
            left = F.col("n") - F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            higher = F.coalesce(F.greatest(left, F.lit(0.0)), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("p")
            # a context never seen leaves the lower order as it is
            out = joined.select("gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(higher).alias("p"))
        return out.select("gram", F.log("p").alias("logp"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ from the counts of counts, each between 0 and its count; where counts are missing, one half of it."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    found = []
    for k, (here, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        d = k - (k + 1) * y * after / here if y is not None and here and after else k / 2
        found.append(min(max(d, 0.05), k - 0.05))
    return found


def perplexities(docs: DataFrame, scores: str) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of every row, by the scores of its block's n-grams."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, grams, logp = None, np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                names = np.asarray(piece.column("block"))
                for run in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                    mine = piece.slice(int(run[0]), len(run))
                    packed, starts = ngrams(mine.column("text"))
                    if names[run[0]] != name and len(packed):
                        name = int(names[run[0]])
                        found = read_block(scores, name, ["gram", "logp"])
                        grams, logp = np.asarray(found.column("gram")), np.asarray(found.column("logp"))
                        order = np.argsort(grams)
                        grams, logp = grams[order], logp[order]
                    n = np.diff(starts)
                    total = np.zeros(len(n))
                    if len(packed):
                        at = np.searchsorted(grams, packed)
                        if at.max() >= len(grams) or not np.array_equal(grams[at], packed):
                            raise ValueError("an n-gram is missing from its block's scores")
                        total[n > 0] = np.add.reduceat(logp[at], starts[:-1][n > 0])
                    value = np.exp(-total / np.maximum(n, 1))
                    yield pa.record_batch({"doc_id": mine.column("doc_id"), "lang": mine.column("lang"), "n_tokens": pa.array(n), "perplexity": pa.array(value, mask=n == 0)})

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), block().alias("block"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, lang string, n_tokens long, perplexity double")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, perplexity, threshold, kept. Trusted are labels' doc_ids of quality 1."""
    docs = in_files(docs)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    places = docs.select(F.col("doc_id").cast("long").alias("doc_id"), block().alias("block"), row_in_block().alias("row"))
    held_out = crc_of_id(F.col("doc_id")) % HELD_OUT == 0
    trusted = write_blocks(places.join(good.where(~held_out), "doc_id", "left_semi").select("block", "row"), "trusted")

    found = written(block_ngrams(docs, trusted), "block-ngrams")
    counts = written(found.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    scores = Model(counts).scored(found.select("gram").distinct())
    folder = write_blocks(found.select("block", "gram").distinct().join(scores, "gram"), "scores")

    rows = written(perplexities(docs, folder), "perplexities")
    mine = rows.join(good, "doc_id", "left_semi").where("perplexity is not null").withColumn("held_out", held_out)
    value = F.percentile_approx("perplexity", quantile, 100_000).alias("threshold")
    number = F.count(F.lit(1)).alias("number")
    by_lang = mine.where("held_out and lang is not null").groupBy("lang").agg(value, number).where(F.col("number") >= LEAST).drop("number")
    overall = {r["held_out"]: r for r in mine.groupBy("held_out").agg(value, number).collect()}
    if True in overall and overall[True]["number"] >= LEAST:
        other = overall[True]["threshold"]
    else:
        other = mine.agg(value).first()["threshold"] if overall else float("inf")
    out = rows.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(other)))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", kept.alias("kept"))


def op8_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
