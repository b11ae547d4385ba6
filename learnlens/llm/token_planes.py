"""Token-id output in bit planes.

Documents are range partitioned and sorted by id, tokenised where they then are, and each partition writes one file:

    magic, then for each block of ``block_ids`` ids its planes, each compressed with zstandard,
    the index (zstandard): number of documents, doc_ids (int64, and a byte for null), ids per document (int64),
    then per block the number of ids and per plane the size in bytes (int64),
    the footer: index offset, index size, ids a block, planes a block, number of ids, number of blocks (int64), magic

A block of n ids is a matrix of n rows and 32 bits (``bit``) or 4 bytes (``byte``); a plane is one of its columns, packed.
High planes of small ids are all zero and vanish, and planes of like entropy compress better than ids do. Blocks are read
one by one through the index, so memory does not depend on the length of a file or document but for its own ids.

Files have names of their own per task attempt, and the manifest lists those of the attempts that ended well, so a lost
executor or a task run twice leaves a stray file but never a wrong one. Only the manifest (a row per file) comes to the
driver, which adds up where each file's ids start.

Text is cut into units before tokenising, which changes no id: the tokenizer drops white space, and nothing in its
normalisation or pattern reaches across it. Units met before come from a cache of bounded size.

Defined results: a null or empty text has the end id alone. Rows without an id come first. Rows with one id are ordered by
a hash of their text; repeated rows are written each. An empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import documents, id_and_text, partitions_for, slices, total_bytes
from learnlens.sources.scratch import new_path

MAGIC = b"BITPLN01"
FOOTER = struct.Struct("<6q")
BLOCK_IDS = 1 << 16
END_ID = 1
CACHE_UNITS = 600_000
SLICE_BYTES = 1 << 20

# The tokenizer's pattern for lower-case ASCII and Latin-1 letters, and the texts it serves.
_LATIN = "\u00df-\u00f6\u00f8-\u00ff"
# letters stand first, as most units are of them and no other choice begins with one
UNIT = re.compile(f"[a-z{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \\t\\n\\ra-z0-9{_LATIN}]+")
PLAIN = re.compile("[ \\t\\n\\r\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
CHUNK = re.compile("[^ \\t\\n\\r]+")
WORD_END = "</w>"
PARTITION_BYTES = 64 << 20
MANIFEST = "part int, path string, n_docs long, n_ids long"


def arrow_uri(uri: str) -> str:
    """A folder named as Spark names it, in the names Arrow knows; credentials come from the environment of the workers."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    return uri


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named as Spark names it, and the path in it."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n)
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(n)


class Writer:
    """Writes one file; ``add`` takes documents one after the other."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, kind: str = "byte"):
        self.stream, self.block_ids, self.kind = stream, block_ids, kind
        self.packer = zstandard.ZstdCompressor(level=3)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.at = len(MAGIC)
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[list[int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            held = np.concatenate(self.waiting)
            full = len(held) // self.block_ids * self.block_ids
            for start in range(0, full, self.block_ids):
                self._block(held[start : start + self.block_ids])
            self.waiting, self.n_waiting = [held[full:].copy()], len(held) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) for p in to_planes(ids, self.kind)]
        for p in packed:
            self.stream.write(p)
            self.at += len(p)
        self.blocks.append([len(ids), *map(len, packed)])

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        n = len(self.doc_ids)
        index = b"".join((
            struct.pack("<q", n),
            np.array([i or 0 for i in self.doc_ids], "<i8").tobytes(),
            np.array([i is None for i in self.doc_ids], np.uint8).tobytes(),
            np.array(self.lengths, "<i8").tobytes(),
            np.array(self.blocks, "<i8").tobytes(),
        ))
        index = self.packer.compress(index)
        self.stream.write(index)
        planes = 4 if self.kind == "byte" else 32
        self.stream.write(FOOTER.pack(self.at, len(index), self.block_ids, planes, self.n_ids, len(self.blocks)) + MAGIC)


class Reader:
    """Reads one file written by ``Writer``."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(FOOTER.size + len(MAGIC), size - FOOTER.size - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a whole bit-plane file")
        at, length, self.block_ids, self.planes, self.n_ids, n_blocks = FOOTER.unpack(tail[: FOOTER.size])
        self.unpacker = zstandard.ZstdDecompressor()
        index = self.unpacker.decompress(file.read_at(length, at))
        (n,) = struct.unpack_from("<q", index)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.no_id = np.frombuffer(index, np.uint8, n, 8 + 8 * n)
        self.lengths = np.frombuffer(index, "<i8", n, 8 + 9 * n)
        self.blocks = np.frombuffer(index, "<i8", n_blocks * (1 + self.planes), 8 + 17 * n).reshape(n_blocks, 1 + self.planes)
        self.places = len(MAGIC) + np.concatenate([[0], np.cumsum(self.blocks[:, 1:].sum(axis=1))])

    def block(self, k: int) -> np.ndarray:
        n, sizes = int(self.blocks[k, 0]), self.blocks[k, 1:]
        data = self.file.read_at(int(sizes.sum()), int(self.places[k]))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return from_planes([self.unpacker.decompress(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, reading only their blocks."""
        parts = []
        for k in range(start // self.block_ids, -(-stop // self.block_ids)):
            base = k * self.block_ids
            parts.append(self.block(k)[max(0, start - base) : stop - base])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place of the first id in the file and ids, in order, holding one block at a time."""
        held, at, k = np.zeros(0, "<u4"), 0, 0
        for doc_id, no_id, n in zip(self.doc_ids.tolist(), self.no_id.tolist(), self.lengths.tolist(), strict=True):
            parts, missing = [held[:n]], n - len(held[:n])
            held = held[n:]
            while missing > 0:
                held, k = self.block(k), k + 1
                parts.append(held[:missing])
                missing, held = missing - len(parts[-1]), held[missing:]
            yield (None if no_id else doc_id), at, np.concatenate(parts)
            at += n


class Encoder:
    """Ids of texts by a tokenizer file, with a cache of the units that the tokenizer's pattern finds.

    Texts of ASCII and Latin-1 letters are split here, in lower case, by the pattern as it reads for these characters, in which
    nothing is left for the normaliser to compose. Others are cut at white space only, and the tokenizer splits the chunks.
    Units and chunks met for the first time go to the tokenizer.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the tasks'
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.of_units = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.of_units.encode_special_tokens = True  # their strings in a text are ordinary text
        # units of plain texts are normal and split as they are: only white space parts them
        self.of_units.normalizer = normalizers.Sequence([])
        self.of_units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id. What all of them hold for the first time is learned at once."""
        plain = [PLAIN.fullmatch(text) is not None for text in texts]
        units = [UNIT.findall(text.lower()) if p else CHUNK.findall(text) for text, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        for kind in (True, False):
            new = set().union(*(u for u, p in zip(units, plain, strict=True) if p == kind)).difference(self.known)
            if new:
                self._learn(list(new), kind)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join([*map(known, u), self.end]), "<u4") for u in units]

    def _learn(self, new: list[str], plain: bool) -> None:
        if not plain:
            for unit, found in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                self.known[unit] = struct.pack(f"<{len(found.ids)}I", *found.ids)
            return
        # as one text: each unit is one word, which closes with a token of its own kind
        ids = np.array(self.of_units.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        data = ids.tobytes()
        self.known.update(zip(new, [data[start:stop] for start, stop in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The encoder of this Python worker, which serves one task after the other."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write(docs: DataFrame, tokenizer: str, folder: str, kind: str = "byte", block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Writes all documents under ``folder`` in ascending order of id; the files in order, each with where its ids start."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        writer, path, system, stream = None, "", None, None
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                if writer is None:
                    system, root = open_folder(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.bitpln"
                    stream = system.open_output_stream(path)
                    writer = Writer(stream, block_ids, kind)
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text").to_pylist()), strict=True):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.record_batch({
                "part": pa.array([part], pa.int32()), "path": pa.array([path.rpartition("/")[2]]),
                "n_docs": pa.array([len(writer.lengths)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()),
            })

    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    n = partitions_for(docs.sparkSession, total_bytes(docs), PARTITION_BYTES)
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files, start = [], 0
    for row in sorted(ordered.mapInArrow(written, MANIFEST).collect()):
        files.append((row["path"], start))
        start += row["n_ids"]
    return files


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                found: list[tuple] = []
                with system.open_input_file(f"{root}/{name}") as file:
                    for doc_id, at, ids in Reader(file).documents():
                        found.append((doc_id, base + at, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
                        if len(found) == 10_000:
                            yield _table(found)
                            found = []
                yield _table(found)

    listed = spark.createDataFrame(files, "path string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(found: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.record_batch({name: pa.array([row[k] for row in found], pa.int64()) for k, name in enumerate(names)})


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-planes")
    files = write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(spark, folder, files)
