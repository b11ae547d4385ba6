"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is split by the pattern of the vocabulary. A word (a match) becomes an array of its bytes' ids, and a fold merges the
adjacent pair with the lowest rank, the first of equals, until no pair has a rank. Ranks come from one stored row, read by
a scalar subquery: small arrays of pairs and ranks, dealt to buckets by the pair, so that a look-up takes the same time in a
vocabulary of any size. Only the two ranks next to a merge are looked up anew. Words of the vocabulary that no merges lead to
are in the row as they are.

Only distinct words are folded. Rows of a file are taken in blocks of ``BLOCK_ROWS``, the distinct words of the blocks are
shuffled by word, each word is folded once, and its ids go back to the blocks that hold it, as one small
dictionary file per block in the shared folder. A second pass over the documents splits them again and puts the ids
together, block by block. Texts are never shuffled, no task holds more than a block's words, and a row of a word lists at most about
``LISTED`` of the blocks that hold it. A block is named by its file and row numbers, so it is the same however a file is
cut into tasks.

Ids are decoded by the vocabulary's byte strings, whose pieces are concatenated.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows are encoded each. Very long texts
are encoded whole; the time of one word grows with the square of its length. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnlens.llm.base import documents, offsets
from learnlens.llm.blocks import block, in_files, read_block, write_blocks
from learnlens.sources.scratch import written

BUCKETS = 131_071
SLICE_WORDS = 1 << 20
BLOCK_ROWS, LISTED = 8192, 1 << 16
NO_RANK = 2147483647

# Code points, in hexadecimal digits, of letters and numbers that Unicode 14 to 16 added, which the encoding's
# library knows and a JVM with Unicode 13 does not.
NEWER_LETTERS = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3
a7d5-a7dc a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc
105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075
1123f-11240 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11740-11746 11ab0-11abf 11bc0-11be0 11f02 11f04-11f10
11f12-11f33 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff 1aff0-1aff3 1aff5-1affb
1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0
1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af
""".split()
NEWER_NUMBERS = """
10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9
16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa
""".split()


def ranks_of(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as file:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, file)]


def java_pattern(pattern: str, newer: bool) -> str:
    """The pattern with classes as the vocabulary's own library reads them; those of ``newer`` code points take longer."""
    listed = lambda ranges: "".join("-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in ranges if newer)
    letters, numbers = "\\p{L}" + listed(NEWER_LETTERS), "\\p{N}" + listed(NEWER_NUMBERS)
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", "\0").replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]")
    return "(?U)" + pattern.replace("\0", f"[^\\s{letters}{numbers}]")


def split_words(text: Column, pattern: str) -> Column:
    """All matches of the pattern; only texts that could hold newer code points are split by the longer form."""
    found = [F.regexp_extract_all(text, F.lit(java_pattern(pattern, newer)), F.lit(0)) for newer in (True, False)]
    return F.when(F.regexp_like(text, F.lit(f"[\\x{{{NEWER_LETTERS[0].split('-')[0]}}}-\\x{{10ffff}}]")), found[0]).otherwise(found[1])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with a name for ``value``, so that a large or costly value stands in the plan once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merges(ranks: list[tuple[bytes, int]]) -> Iterator[tuple[int, int, int]]:
    """All pairs of ids whose byte strings together are one, with its id, which is also the rank of the merge."""
    known = dict(ranks)
    for token, rank in ranks:
        for cut in range(1, len(token)):
            if token[:cut] in known and token[cut:] in known:
                yield known[token[:cut]], known[token[cut:]], rank


def _spot(a, b):
    """The bucket of a pair, for numbers and columns alike."""
    return a * 31_337 + b * 7_919


KIND = "struct<keys:array<array<bigint>>,values:array<array<int>>,bytes:array<int>,whole:map<string,int>>"


def rank_map(ranks: list[tuple[bytes, int]]) -> dict:
    """What the fold looks up: ranks of pairs in buckets, ids of single bytes, and words that no merges lead to."""
    known = dict(ranks)
    if any(bytes([b]) not in known for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    keys: list[list[int]] = [[] for _ in range(BUCKETS)]
    values: list[list[int]] = [[] for _ in range(BUCKETS)]
    by_pair = {}
    for a, b, rank in merges(ranks):
        by_pair[a, b] = rank
        keys[_spot(a, b) % BUCKETS].append((a << 32) + b)
        values[_spot(a, b) % BUCKETS].append(rank)
    single = [known[bytes([b])] for b in range(256)]
    whole = {token.hex().upper(): rank for token, rank in ranks if merged_ids([single[b] for b in token], by_pair) != [rank]}
    return {"keys": keys, "values": values, "bytes": single, "whole": whole}


def rank_column(spark: SparkSession, path: str) -> Column:
    """The rank map as a scalar subquery over a stored row.

    A task builds and writes it. So no plan spells it out, the driver's Python never holds it, and its JVM holds one block of
    bytes per query that is run.
    """

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.record_batch({"held": pa.array([json.dumps(rank_map(ranks_of(path)), separators=(",", ":"))])})

    text = spark.range(1, numPartitions=1).mapInArrow(built, "held string")
    return written(text.select(F.from_json("held", KIND).alias("held")), "ranks").scalar()


def merged_ids(ids: list[int], by_pair: dict[tuple[int, int], int]) -> list[int]:
    """The fold in plain Python, for the few thousand entries of a vocabulary."""
    while len(ids) > 1:
        rank, at = min((by_pair.get(pair, NO_RANK), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
        if rank == NO_RANK:
            break
        ids = [*ids[:at], rank, *ids[at + 2 :]]
    return ids


class Fold:
    """Ids of words, given the rank map."""

    def __init__(self, held: Column):
        self.held = held

    def rank(self, a: Column, b: Column) -> Column:
        a, b = a.cast("long"), b.cast("long")
        spot = F.pmod(_spot(a, b), F.lit(BUCKETS)).cast("int")
        at = F.array_position(F.get(self.held["keys"], spot), F.shiftleft(a, 32) + b).cast("int")
        return F.coalesce(F.get(F.get(self.held["values"], spot), at - 1), F.lit(NO_RANK))

    def __call__(self, word: Column) -> Column:
        data = word.cast("binary")
        # one character for each byte
        characters = F.split(F.decode(data, "ISO-8859-1"), "")
        single = F.transform(F.slice(characters, 1, F.octet_length(data)), lambda c: F.get(self.held["bytes"], F.ascii(c)))
        whole = F.try_element_at(self.held["whole"], F.hex(data))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(bound(single, self._merged))

    def _merged(self, single: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(single) - 2), lambda i: self.rank(F.get(single, i), F.get(single, i + 1)))
        start = F.struct(single.alias("ids"), pairs.alias("ranks"))
        folded = F.aggregate(F.sequence(F.lit(2), F.size(single)), start, lambda held, _: bound(F.struct(held.alias("held"), F.array_min(held["ranks"]).alias("least")), self._merge))
        return F.when(F.size(single) == 1, single).otherwise(folded["ids"])

    def _merge(self, step: Column) -> Column:
        """The first pair of the least rank merged; the id of what it makes is that rank."""
        at = F.array_position(step["held"]["ranks"], step["least"]).cast("int")  # from 1: the pair of ids at and at + 1
        merged = bound(F.struct(step["held"]["ids"].alias("ids"), step["held"]["ranks"].alias("ranks"), step["least"].alias("new"), at.alias("at")), self._after)
        return F.when(step["least"] == NO_RANK, step["held"]).when(step["least"].isNull(), step["held"]).otherwise(merged)

    def _after(self, step: Column) -> Column:
        """The ids after a merge with the ranks of their pairs: the merged pair is gone, and its neighbours are new."""
        ids, ranks, new, at = step["ids"], step["ranks"], step["new"], step["at"]
        none = F.expr("cast(array() as array<int>)")
        before = F.when(at > 1, F.array(self.rank(F.get(ids, at - 2), new))).otherwise(none)
        after = F.when(at < F.size(ranks), F.array(self.rank(new, F.get(ids, at + 1)))).otherwise(none)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, F.size(ranks))).alias("ranks"),
        )


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, block and the words of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), block(BLOCK_ROWS).alias("block"), split_words(text, pattern).alias("words"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block that a task reads."""
    name, held, size = None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        words = pc.unique(pa.chunked_array(held))
        for k in range(0, len(words), SLICE_WORDS):
            part = words.slice(k, SLICE_WORDS)
            yield pa.record_batch({"block": pa.array(np.full(len(part), name, np.int64)), "word": part})

    for batch in batches:
        names = np.asarray(batch.column("block"))
        for run in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
            if held and names[run[0]] != name:
                yield from out()
                held, size = [], 0
            name = int(names[run[0]])
            held.append(pc.unique(batch.column("words").slice(int(run[0]), len(run)).flatten()))
            size += len(held[-1])
            if size > SLICE_WORDS:
                held = [pc.unique(pa.chunked_array(held))]
                size = 0
    if held:
        yield from out()


def folded(rows: DataFrame, path: str) -> DataFrame:
    """The distinct words of ``rows``, the blocks that hold them, and their ids."""
    # a given number of partitions: folding costs time, not bytes, so few bytes must not be put into few tasks
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = 1 + rows.count() // (BLOCK_ROWS * LISTED)
    pairs = rows.select("block", "words").mapInArrow(_distinct, "block long, word string").withColumn("part", F.pmod("block", F.lit(lists)))
    words = pairs.repartition(spread, "word", "part").groupBy("word", "part").agg(F.collect_list("block").alias("blocks"))
    # subqueries may not stand within higher-order functions, so the optimiser puts the column into the fold, where it stands once
    words = words.withColumn("held", rank_column(rows.sparkSession, path))
    return words.select("word", "blocks", bound(F.col("held"), lambda held: Fold(held)(F.col("word"))).alias("ids"))


def dictionaries(rows: DataFrame, path: str) -> str:
    """The folder of the blocks' dictionaries: word and ids, a partition per block."""
    return write_blocks(folded(rows, path).select(F.explode("blocks").alias("block"), "word", "ids"), "dictionaries")


class Dictionary:
    """The words of one block with their ids."""

    def __init__(self, folder: str, name: int):
        found = read_block(folder, name, ["word", "ids"])
        self.words = found.column("word").combine_chunks()
        ids = found.column("ids").combine_chunks()
        self.ids = np.asarray(ids.flatten()).astype("<u4")
        self.counts = np.asarray(pc.list_value_length(ids)).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in order, and how many each has."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            raise ValueError("a word is missing from its block's dictionary")
        at = np.asarray(at)
        return gathered(self.ids, self.starts[at], self.counts[at]), self.counts[at]


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        tokens = [b""] * (max((rank for _, rank in ranks), default=-1) + 1)
        for token, rank in ranks:
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.counts = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def __call__(self, ids: np.ndarray) -> bytes:
        return gathered(self.data, self.starts[ids], self.counts[ids]).tobytes()


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    """The decoder of this Python worker, which serves one task after the other."""
    if path not in _decoders:
        _decoders[path] = Decoder(ranks_of(path))
    return _decoders[path]


def encoded(docs: DataFrame, path: str, pattern: str, finish: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` of the doc_ids and ids of each slice of rows, for every row of ``docs`` (doc_id and text)."""
    rows = _blocks(in_files(docs), pattern)
    folder = dictionaries(rows, path)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dictionary = None, None
        for batch in batches:
            names, sizes = batch.column("block").to_pylist(), offsets(batch.column("words"))
            start = 0
            while start < batch.num_rows:
                stop = start + 1  # rows of one block, with not too many words
                while stop < batch.num_rows and names[stop] == names[start] and sizes[stop + 1] - sizes[start] <= SLICE_WORDS:
                    stop += 1
                words = batch.column("words").slice(start, stop - start)
                flat, each = words.flatten(), np.diff(offsets(words))
                if not len(flat):
                    ids = [np.zeros(0, "<u4")] * len(words)
                else:
                    if names[start] != held:
                        held, dictionary = names[start], Dictionary(folder, names[start])
                    flat_ids, per_word = dictionary(flat)
                    ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(each)])]
                    ids = [flat_ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield finish(batch.column("doc_id").slice(start, stop - start), ids)
                start = stop

    return rows.mapInArrow(assembled, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row."""

    def finish(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": doc_ids, "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())})

    return encoded(docs, path, pattern, finish, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids and of the bytes they decode to, of every row."""
    def finish(doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        decode = decoder(path)
        return pa.record_batch({
            "doc_id": doc_ids,
            "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(decode(i)).hexdigest() for i in ids], pa.string()),
        })

    return encoded(docs, path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
