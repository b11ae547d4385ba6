"""Alignment of two tokenizers: inverted pair bitmaps.

Tokenizer A (byte-level, .json) encodes a space and the text, tokenizer B (.model) the text, before which it puts a space itself. Both
cut the same bytes; an A token and a B token are linked where their byte ranges overlap, and byte offsets where tokens of both end cut the text
into groups.

The index is inverted by pair of ids. Rows of files form blocks of 4096; for each block a pair has *planes*: plane k is a
compressed bitmap of the block's documents in which bit k of the number of the pair's links is set. The bitmaps of a pair's planes OR-ed
together are the documents that hold it, so their population count is the pair's number of documents in the block; plane k's count times 2^k, added
up, is its number of links. A bitmap is a sorted list of 16-bit numbers or, from 256 documents on, 4096 bits.

A space between two characters that are not blank opens a token of A and of B, so texts are cut there into units that are aligned one by one.
A worker keeps the units it has met, up to a bound. A tokenizer for which this does not hold takes whole texts as units.

``postings`` encodes every text once and writes planes and a digest per document. ``pairs`` adds up the counts of all blocks, aggregated
before they are shuffled, so a pair that every document holds costs a row per task. ``scores`` joins the counts to the
postings and reads them block by block: each plane returns its pair's count, 2^k times, to the documents in it. A task holds the sums of
one block, never a group.

Defined results: a text that is null or empty, or whose tokens of A or of B do not spell the space and the text, has no tokens: zeros and an
empty digest. Special strings inside texts are plain text. A repeated row is a document of its own; a row without an id
keeps its null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import documents, offsets, slices
from learnlens.llm.blocks import BLOCK_ROWS, block, in_files, row_in_block
from learnlens.llm.byte_bpe import gathered
from learnlens.sources.scratch import written

SLICE_BYTES = 2 << 20
CACHE_UNITS = 400_000
JOINED_UNITS = 4000
CACHE_LINKS = 3_000_000
UNIT_CUT = re.compile(r"(?<=\S) (?=\S)")
DENSE = BLOCK_ROWS // 16  # from here on 4096 bits are the smaller form
NO_TOKENS = ""

#: one file holds both kinds of row: digests (a row per document) and postings (a row per block part, pair and plane)
POSTINGS = (
    "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, b int, plane int, members binary, n_docs long, links long"
)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(0x100 + k): b for k, b in enumerate(moved)}


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.counts = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.starts[ids], self.counts[ids])


class Aligner:
    """Aligns units; what it knows of them is in arrays by number of unit, links one after the other."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are the tasks'
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        entries_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            entries_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        entries_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Vocabulary(entries_a), Vocabulary(entries_b)
        steps = json.loads(self.a.to_str())
        opens_a = steps["normalizer"] is None and (steps["pre_tokenizer"] or {}).get("type") == "ByteLevel" and steps["pre_tokenizer"]["use_regex"]
        self.cuts = opens_a and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.spelled = np.zeros(0, bool)
        self.links = np.zeros((0, 2), np.int64)

    def units(self, text: str) -> list[str]:
        return [] if not text else UNIT_CUT.split(text) if self.cuts else [text]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts per text, digests of the groups, and for each link the text, and the ids of A and of B."""
        if len(self.known) > CACHE_UNITS or len(self.links) > CACHE_LINKS:
            self.forget()
        units = [self.units(text) for text in texts]
        if new := [*{u for found in units for u in found if u not in self.known}]:
            self._learn(new)
        numbers = [[*map(self.known.__getitem__, found)] for found in units]
        sizes = np.array([len(found) for found in numbers], np.int64)
        flat = np.fromiter((k for found in numbers for k in found), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), bool)  # these have no tokens
        bad[text[~self.spelled[flat]]] = True
        flat, text = flat[~bad[text]], text[~bad[text]]
        sums = np.stack([np.bincount(text, self.counts[flat, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
        digests = [
            hashlib.sha256(b";".join([*map(self.groups.__getitem__, found)])).hexdigest() if found and not gone else NO_TOKENS
            for found, gone in zip(numbers, bad.tolist(), strict=True)
        ]
        n_links = self.counts[:, 3]
        starts = np.cumsum(n_links) - n_links
        return sums, digests, np.repeat(text, n_links[flat]), gathered(self.links, starts[flat], n_links[flat])

    def _learn(self, units: list[str]) -> None:
        """Adds units. Those that neither end in a blank nor hold a word mark are encoded many in a text, which is cut at their ends."""
        joins = [self.cuts and "▁" not in u and not u[0].isspace() and not u[-1].isspace() for u in units]
        plain = [u for u, j in zip(units, joins, strict=True) if j]
        parts = [(self.counts, self.spelled, self.links)]
        for start in range(0, len(plain), JOINED_UNITS):
            here = plain[start : start + JOINED_UNITS]
            text = " ".join(here)
            wanted = [b" " + u.encode() for u in here]
            a, b = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text), np.int64)
            n_a, n_b = _cut(wanted, a, self.bytes_a), _cut(wanted, b, self.bytes_b)
            whole = n_a is not None and n_b is not None
            parts.append(self._add(here, a, n_a, b, n_b, np.ones(len(here), bool)) if whole else self._learn_each(here))
        parts.append(self._learn_each([u for u, j in zip(units, joins, strict=True) if not j]))
        self.counts, self.spelled, self.links = (np.concatenate(column) for column in zip(*parts, strict=True))

    def _learn_each(self, units: list[str]) -> tuple[np.ndarray, ...]:
        ids_a = [found.ids for found in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        a, n_a = _flat(ids_a)
        b, n_b = _flat(ids_b)
        wanted = [b" " + u.encode() for u in units]
        spelled = _spells(wanted, a, n_a, self.bytes_a) & _spells(wanted, b, n_b, self.bytes_b)
        return self._add(units, a[np.repeat(spelled, n_a)], n_a * spelled, b[np.repeat(spelled, n_b)], n_b * spelled, spelled)

    def _add(self, units: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, ...]:
        unit_a = np.repeat(np.arange(len(units)), n_a)
        end_a, end_b = np.cumsum(self.bytes_a.counts[a]), np.cumsum(self.bytes_b.counts[b])
        start_a, start_b = end_a - self.bytes_a.counts[a], end_b - self.bytes_b.counts[b]
        first = np.searchsorted(end_b, start_a, "right")
        n_each = np.searchsorted(start_b, end_a, "left") - first
        closes_a = end_b[np.searchsorted(end_b, end_a)] == end_a if len(a) else np.zeros(0, bool)
        group_ends = end_a[closes_a]
        counts = [n_a, n_b, np.bincount(unit_a[closes_a], minlength=len(units)), np.bincount(unit_a, n_each, len(units))]
        self.groups += _written(a, n_a, closes_a, b, n_b, np.searchsorted(group_ends, end_b), np.isin(end_b, group_ends))
        links = np.stack([np.repeat(a, n_each), gathered(b, first, n_each)], axis=1)
        self.known |= {u: len(self.known) + k for k, u in enumerate(units)}
        return np.stack(counts, axis=1).astype(np.int64), spelled, links


def _spells(wanted: list[bytes], ids: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Which of the texts their tokens spell."""
    data = vocabulary.spelled(ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(vocabulary.counts[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
    return np.array([data[x:y] == w for x, y, w in zip(ends[:-1], ends[1:], wanted, strict=True)], bool)


def _cut(wanted: list[bytes], ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray | None:
    """How many of the ids each of the texts has, if the ids spell them all and a token ends with each."""
    if vocabulary.spelled(ids).tobytes() != b"".join(wanted):
        return None
    ends, stops = np.cumsum(vocabulary.counts[ids]), np.cumsum([len(w) for w in wanted])
    last = np.searchsorted(ends, stops)
    return np.diff(last, prepend=-1) if np.array_equal(ends[last], stops) else None


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(i) for i in ids], np.int64)
    return np.fromiter((i for found in ids for i in found), np.int64, int(n.sum())), n


def _written(a: np.ndarray, n_a: np.ndarray, closes_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, group_b: np.ndarray, closes_b: np.ndarray) -> list[bytes]:
    """Each unit's groups in decimal: ``a1,a2|b1;a3|b2,b3``."""
    if not len(a):
        return [b""] * len(n_a)
    group_a = np.cumsum(closes_a) - closes_a
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a))])  # tokens of A before each group
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b))])
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
    ids[place_a], ids[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(closes_a, ord("|"), ord(",")), np.where(closes_b, ord(";"), ord(","))
    digits = np.ones(len(ids), np.int64)
    power = 10
    while (more := ids >= power).any():
        digits += more
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1], np.uint8)
    out[ends - 1] = mark
    for k in range(int(digits.max())):
        has = digits > k
        out[ends[has] - 2 - k] = ord("0") + ids[has] // 10**k % 10
    data = out.tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    return [data[x : max(x, y - 1)] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def pack(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bitmaps of consecutive runs of ``rows`` (sorted within a run, below BLOCK_ROWS), ``counts`` long."""
    dense = counts >= DENSE
    sizes = np.where(dense, BLOCK_ROWS // 8, 2 * counts)
    ends, row_ends = np.cumsum(sizes), np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    sparse = ~dense
    lists = gathered(rows, (row_ends - counts)[sparse], counts[sparse]).astype("<u2").view(np.uint8)
    held = np.repeat(sparse, sizes)
    out[held] = lists
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK_ROWS, bool)
        bits[rows[row_ends[k] - counts[k] : row_ends[k]]] = True
        out[ends[k] - sizes[k] : ends[k]] = np.packbits(bits)
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(out)])


def unpack(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of bitmaps that begin at ``starts`` in ``data``, and which bitmap each is of."""
    dense = sizes == BLOCK_ROWS // 8
    sparse = np.flatnonzero(~dense)
    rows = [gathered(data, starts[sparse], sizes[sparse]).view("<u2").astype(np.int64)]
    of = [np.repeat(sparse, sizes[sparse] // 2)]
    for k in np.flatnonzero(dense).tolist():
        rows.append(np.flatnonzero(np.unpackbits(data[starts[k] : starts[k] + BLOCK_ROWS // 8])))
        of.append(np.full(len(rows[-1]), k))
    return np.concatenate(rows), np.concatenate(of)


def _planes(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[dict[str, pa.Array]]:
    """The planes of the links between ``a`` and ``b`` in documents ``row``."""
    width = int(b.max()) + 1
    keys, times = np.unique((a * width + b) * BLOCK_ROWS + row, return_counts=True)
    plane = 0
    while len(keys):
        here = (times >> plane) & 1 == 1
        lowest = (times & -times)[here] == 1 << plane  # counts each document in one plane
        pair, rows = keys[here] // BLOCK_ROWS, keys[here] % BLOCK_ROWS
        if len(pair):
            begins = np.flatnonzero(np.diff(pair, prepend=-1))
            counts = np.diff(begins, append=len(pair))
            yield {
                "a": pa.array((pair[begins] // width).astype(np.int32)),
                "b": pa.array((pair[begins] % width).astype(np.int32)),
                "plane": pa.array(np.full(len(begins), plane, np.int32)),
                "members": pack(rows, counts),
                "n_docs": pa.array(np.add.reduceat(lowest, begins, dtype=np.int64)),
                "links": pa.array(counts << plane),
            }
        plane += 1
        left = times >> plane > 0
        keys, times = keys[left], times[left]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker, which serves one task after the other."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Digests and planes of all documents, written to the shared folder."""
    files = in_files(docs)
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in POSTINGS.split(", "))])

    def filled(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names, rows = np.asarray(part.column("block")), np.asarray(part.column("row")).astype(np.int64)
                counts, digests, text, links = aligner(path_a, path_b).align(part.column("text").to_pylist())
                yield filled(part.num_rows, {
                    "block": part.column("block"), "row": part.column("row"), "doc_id": part.column("doc_id"),
                    "groups_sha256": pa.array(digests, pa.string()), **{k: pa.array(counts[:, c]) for c, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                })
                for name in np.unique(names[text]).tolist():
                    of_block = names[text] == name
                    for columns in _planes(rows[text[of_block]], *links[of_block].T):
                        n = len(columns["a"])
                        yield filled(n, {"block": pa.array(np.full(n, name, np.int64)), **columns})

    rows = files.select(
        block().alias("block"), row_in_block().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return written(rows.mapInArrow(inverted, POSTINGS), "postings")


def pairs(index: DataFrame) -> DataFrame:
    """a, b, in how many documents they are linked, how many links they have, and whether no other b has more documents with that a."""
    counted = index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("links").alias("links"))
    counted = written(counted, "pairs")
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(most, "a").select("a", "b", "n_docs", "links", (F.col("n_docs") == F.col("most")).alias("best"))


def scores(index: DataFrame, counted: DataFrame) -> DataFrame:
    """block, row, links whose pair is the best of its a, and the sum of all links' counts, for documents that have links."""

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, total = None, np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64)

        def closed() -> pa.RecordBatch:
            rows = np.flatnonzero(total)
            return pa.record_batch({
                "block": pa.array(np.full(len(rows), held, np.int64)), "row": pa.array(rows.astype(np.int32)),
                "n_best": pa.array(best[rows]), "count_sum": pa.array(total[rows]),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.asarray(batch.column("block"))
            members = batch.column("members")
            at = offsets(members)
            data = np.frombuffer(members.buffers()[2], np.uint8)
            times = np.int64(1) << np.asarray(batch.column("plane")).astype(np.int64)
            count = np.asarray(batch.column("n_docs")) * times
            liked = np.asarray(batch.column("best")) * times
            begins = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]).tolist()
            for x, y in zip(begins[:-1], begins[1:], strict=True):
                if names[x] != held:
                    if held is not None:
                        yield closed()
                    held = int(names[x])
                    best[:] = total[:] = 0
                rows, of = unpack(data, at[x:y], np.diff(at[x : y + 1]))
                np.add.at(total, rows, count[x:y][of])
                np.add.at(best, rows, liked[x:y][of])
        if held is not None:
            yield closed()

    planes = index.where("a IS NOT NULL").select("block", "a", "b", "plane", "members")
    # merged at every size: a plan that broadcasts small tables would shuffle more than in proportion when they grow
    joined = planes.join(counted.select("a", "b", "n_docs", "best").hint("merge"), ["a", "b"]).select("block", "plane", "members", "n_docs", "best")
    by_block = joined.repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(returned, "block long, row int, n_best long, count_sum long")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: tokens of both, groups, links, the links' counts over all documents, and the digest of the groups."""
    index = postings(docs, path_a, path_b)
    found = scores(index, pairs(index))
    digests = index.where("groups_sha256 IS NOT NULL").select("block", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = digests.join(found, ["block", "row"], "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
