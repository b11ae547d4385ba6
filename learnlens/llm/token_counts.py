"""Token counts of whole texts by a tokenizer file, without keeping ids.

An Arrow function takes the texts as they are scanned, in batches of about ``BATCH_BYTES`` bytes, and returns lengths only.
A text of more than ``LONG_TEXT`` bytes is cut into pieces of about ``PIECE_CHARS`` characters, which are written with the number of
their row, dealt evenly over all tasks, counted and added up, so neither a task nor a call of the tokenizer holds much more than
a batch, and one very long text is counted by many tasks.

A cut is safe between two characters that are neighbours in no entry of the vocabulary: no merge can join them, and merges
on one side do not depend on the other side. The tokenizer puts a word mark before every text it is given. Where the cut is at a space,
the right piece leaves that space out, as its own mark stands for it; elsewhere the mark before the right piece must be
an entry that joins with nothing there, and one token is taken off. Text without a safe place stays whole, and so does text that the
tokenizer's normaliser changes, and any text of a tokenizer that is not of the .model kind.

Defined results: a null or empty text has no bytes and no tokens. Special strings inside texts are what the library takes them
for by default. Repeated rows are counted each; a row without an id keeps its null. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import documents, id_and_text, offsets, partitions_for, slices
from learnlens.sources.scratch import written

BATCH_BYTES = 1 << 20
LONG_TEXT = 1 << 16
PIECE_CHARS = 1 << 14
TOKEN_LIMIT = 4096
SPACE, MARK = 0x20, 0x2581


class JsonCounter:
    """Lengths by a .json file; its texts are never cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the tasks'
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str, limit: int) -> Iterator[tuple[str, int]]:
        yield text, 0


class PieceCounter:
    """Lengths by a .model file, and pieces of a text whose lengths add up to that of the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_byte(i)]
        points = np.frombuffer("\0".join(entries).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.joined = np.unique(points[:-1] << 21 | points[1:])
        self.mark_is_entry = chr(MARK) in entries

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.model.encode(texts, num_threads=1)]

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 21 | right
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        return self.joined[at] == pairs

    def _cuts(self, window: str) -> np.ndarray:
        """Where the window may be cut: before these characters, never before the first or last one."""
        plain = chr(MARK) + window.replace(" ", chr(MARK))
        if len(window) < 3 or self.model.normalize(window) != plain:
            return np.zeros(0, np.int64)
        points = np.frombuffer(plain[1:].encode("utf-32-le"), np.uint32).astype(np.int64)
        left, right = points[:-2], points[1:-1]
        safe = ~self._joins(left, right)
        safe &= (right == MARK) | (~self._joins(np.full(len(right), MARK), right) & self.mark_is_entry)
        return np.flatnonzero(safe) + 1

    def pieces(self, text: str, limit: int) -> Iterator[tuple[str, int]]:
        """Pieces, and for each how many tokens its count has beyond those of its text."""
        start = extra = 0
        while len(text) - start > limit:
            reach = limit
            while not len(cuts := self._cuts(text[start : start + reach + 1])) and start + reach < len(text):
                reach *= 2
            if not len(cuts):
                break
            stop = start + int(cuts[-1] if reach == limit else cuts[0])
            yield text[start:stop], extra
            extra = 0 if text[stop] in (" ", chr(MARK)) else 1
            start = stop + 1 - extra
        yield text[start:], extra


_counters: dict[str, JsonCounter | PieceCounter] = {}


def counter(path: str) -> JsonCounter | PieceCounter:
    """The counter of this Python worker, which serves one task after the other."""
    if path not in _counters:
        _counters[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, tokenizer: str, token_limit: int = TOKEN_LIMIT, long_text: int = LONG_TEXT, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                lengths = counter(tokenizer).lengths(part.column("text").to_pylist())
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array(np.diff(offsets(part.column("text")))),
                    "n_tokens": pa.array(lengths, pa.int64()),
                })

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held: list[tuple[str, int]] = []
                for piece in counter(tokenizer).pieces(batch.column("text")[k].as_py(), piece_chars):
                    held.append(piece)
                    if len(held) * piece_chars > BATCH_BYTES:
                        yield _pieces(batch, k, held)
                        held = []
                if held:
                    yield _pieces(batch, k, held)

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                lengths = counter(tokenizer).lengths(part.column("text").to_pylist())
                n_tokens = np.array(lengths, np.int64) - np.asarray(part.column("extra")).astype(np.int64)
                yield pa.record_batch({
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "n_tokens": pa.array(n_tokens),
                })

    spark = docs.sparkSession
    texts = id_and_text(docs)
    long = F.octet_length("text") > long_text
    counts = texts.where(~long).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    # written, so that a row keeps its number whatever is lost later
    rows = texts.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    pieces = written(rows.mapInArrow(cut, "row long, doc_id long, n_bytes long, text string, extra int"), "pieces")
    n_bytes = pieces.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = pieces.repartition(partitions_for(spark, n_bytes, BATCH_BYTES * 16))
    whole = (
        dealt.mapInArrow(count_pieces, "row long, doc_id long, n_bytes long, n_tokens long")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
        .drop("row")
    )
    return counts.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > token_limit)


def _pieces(batch: pa.RecordBatch, k: int, held: list[tuple[str, int]]) -> pa.RecordBatch:
    def same(name: str) -> pa.Array:
        return pa.array([batch.column(name)[k].as_py()] * len(held), pa.int64())

    return pa.record_batch({
        "row": same("row"), "doc_id": same("doc_id"), "n_bytes": same("n_bytes"),
        "text": pa.array([text for text, _ in held], pa.string()), "extra": pa.array([extra for _, extra in held], pa.int32()),
    })


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
