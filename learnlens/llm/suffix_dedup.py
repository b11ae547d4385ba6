"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in any document. Only some
suffixes are sorted, and no repeated string is missed by that:

1. Every string of LENGTH bytes has an anchor: the place, among its first ``REACH``, where a hash of 16 bytes is least. Equal strings
   have their anchors at equal places. All strings with one anchor hold the CORE bytes from it on.
2. Anchors whose core occurs once in the corpus can have no repeated string; cores are counted by hash.
3. The suffixes at the other anchors, LENGTH bytes each, are sorted: tasks sort runs, cut them by core, and exchange them
   front coded (length of the prefix shared with the suffix before, and the rest). A loser tree merges the runs of a
   part; it plays by the known lengths of common prefixes and compares bytes only from there on.
4. The sorted order and its common prefixes, and the same of what stands left of the anchors, tell which strings around an anchor occur
   twice: those that agree on the bytes before and on the bytes after it with those of another anchor. All of an anchor's strings overlap in the
   core, so what they cover is one span.
5. Spans go back to the blocks of rows, and a scan removes them.

Cores that occur more than ``HOT`` times would be too much for one task: the strings around their anchors are told apart by two 64-bit
hashes instead, counted before they are shuffled. Texts are never shuffled; suffixes are only where cores repeat.

Defined results: a null text counts as empty; texts shorter than LENGTH bytes lose nothing. Repeated rows are copies of each
other, and each loses all its bytes if it is long enough. Ids are not used, so missing and repeated ones do no harm. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import documents, joined_bytes, slices
from learnlens.llm.blocks import block, in_files, read_block, row_in_block, write_blocks
from learnlens.llm.near_dedup import mixed, powers
from learnlens.sources.scratch import written

LENGTH, REACH, GRAM = 400, 128, 16
CORE = LENGTH - REACH + 1
HOT = 20_000
SLICE_BYTES = 2 << 20
PIECE_BYTES = 4 << 20
RUN_SUFFIXES = 40_000
PART_SUFFIXES = 30_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = [np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)]
_LOW = np.uint64((1 << 24) - 1)
PLACE = np.dtype([("block", "<i8"), ("row", "<i4"), ("pos", "<i8"), ("least", "u1"), ("most", "u1")])


def string_hash(data: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, by which the hash of any substring is told."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), dtype=np.uint64)])
    return summed, powers(inverse, len(data) + 1)


def hash_of(prepared: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    summed, down = prepared
    return mixed((summed[start + length] - summed[start]) * down[start])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of LENGTH bytes within the texts that begin at ``starts`` (and end with ``data``):
    places, and the first and last string of each.
    """
    count = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    grams = (words[:-8] * _A) ^ (np.roll(words, -8)[: len(words) - 8] * _B)
    grams = (grams ^ (grams >> np.uint64(31))) * _A
    ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < REACH:
        ranked = np.minimum(ranked[:-span], ranked[span:])
        span *= 2
    anchor = (ranked[:count] & _LOW).astype(np.int64)
    ends = np.append(starts[1:], len(data))
    valid = np.zeros(count + 1, np.int64)
    whole = ends - starts >= LENGTH
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, np.minimum(ends[whole] - LENGTH + 1, count), -1)
    first = np.flatnonzero(np.cumsum(valid)[:count] > 0)
    if not len(first):
        return none, none, none
    anchor = anchor[first]
    # strings of one anchor follow each other; a text's last and the next one's first never share one
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = np.append(new[1:], len(first)) - 1
    return anchor[new], first[new], first[last]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, bytes, starts of texts, their rows, and the place in its text at which each begins (not 0 for the later
    pieces of very long texts, which overlap by LENGTH - 1).
    """
    for part in slices(batch, "text", SLICE_BYTES):
        names = np.asarray(part.column("block"))
        for run in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
            mine = part.slice(int(run[0]), len(run))
            data, at = joined_bytes(mine.column("text"))
            rows = np.asarray(mine.column("row"))
            if len(data) <= PIECE_BYTES:
                yield int(names[run[0]]), data, at[:-1], rows, np.zeros(len(rows), np.int64)
                continue
            for row, a, b in zip(rows, at[:-1], at[1:], strict=True):
                for begin in range(int(a), max(int(a) + 1, int(b) - LENGTH + 1), PIECE_BYTES - LENGTH + 1):
                    yield int(names[run[0]]), data[begin : min(begin + PIECE_BYTES, int(b))], np.zeros(1, np.int64), np.array([row]), np.array([begin - a])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data, starts, rows, shifts in pieces(batch):
            place, first, last = anchors(data, starts)
            if len(place):
                keys = hash_of(string_hash(data, _BASES[0]), place, CORE).view(np.int64)
                text = np.searchsorted(starts, place, "right") - 1
                yield pa.record_batch({
                    "block": pa.array(np.full(len(place), name, np.int64)),
                    "row": pa.array(rows[text].astype(np.int32)),
                    "pos": pa.array(place - starts[text] + shifts[text]),
                    "least": pa.array((place - last).astype(np.int16)),
                    "most": pa.array((place - first).astype(np.int16)),
                    "key": pa.array(keys),
                })


def scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(block().alias("block"), row_in_block().alias("row"), text.alias("text"))


def front_coded(sorted_: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The length of the prefix each string shares with the one before, and the rest."""
    shared = common_prefixes(sorted_)
    return shared, [s[n:] for s, n in zip(sorted_, shared.tolist(), strict=True)]


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """For each string, how many bytes it begins with like the one before it."""
    out = np.zeros(len(strings), np.int32)
    if len(strings) < 2:
        return out
    sizes = np.array([len(s) for s in strings], np.int32)
    width = max(1, int(sizes.max()))
    for start in range(1, len(strings), 8192):
        held = strings[start - 1 : start + 8192]
        grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in held), np.uint8).reshape(len(held), width)
        differs = grid[1:] != grid[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        lengths = sizes[start - 1 : start + 8192]
        out[start : start + 8192] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def _first_difference(a: bytes, b: bytes, at: int) -> int:
    n = min(len(a), len(b))
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    while at < n and a[at] == b[at]:
        at += 1
    return min(at, n)


class LoserTree:
    """Merges sorted runs of strings with known common prefixes.

    Each string that waits in the tree knows how many bytes it shares with the string that beat it. Of two
    that meet, both relative to the last string given out, the one that shares more with it is smaller, and its
    rival goes on sharing what it did; bytes are compared, from the shared length on, only if the two lengths are equal.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.next = [0] * self.size
        self.head: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r][0] else None for r in range(self.size)]
        self.shared = [0 if h is not None else -1 for h in self.head]
        self.losers = [-1] * self.size
        self.winner = self._start(1)

    def _start(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._start(2 * node), self._start(2 * node + 1))

    def _play(self, node: int, one: int, two: int) -> int:
        shared = self.shared
        if shared[one] == shared[two] and shared[one] >= 0:
            a, b = self.head[one], self.head[two]
            at = _first_difference(a, b, shared[one])
            if at < len(b) and (at == len(a) or a[at] < b[at]) or at == len(a) == len(b):
                shared[two] = at
            else:
                shared[one] = at
                one, two = two, one
        elif shared[one] < shared[two]:
            one, two = two, one
        self.losers[node] = two
        return one

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, index and length shared with the string given out before, in sorted order."""
        while self.head[self.winner] is not None:
            run = self.winner
            index = self.next[run]
            yield run, index, self.shared[run]
            index += 1
            self.next[run] = index
            strings, shared = self.runs[run]
            if index < len(strings):
                self.head[run], self.shared[run] = strings[index], shared[index]
            else:
                self.head[run], self.shared[run] = None, -1
            best, node = run, (run + self.size) // 2
            while node:
                best = self._play(node, best, self.losers[node])
                node //= 2
            self.winner = best


RUN_ROW = "part long, count int, places binary, shared binary, sizes binary, rest binary, left_sizes binary, left binary"


def _packed(part: int, chosen: list[tuple[bytes, bytes, int]], places: np.ndarray) -> dict:
    """A sorted run for one part, front coded. An entry is suffix, reversed left context and index of the place."""
    shared, rest = front_coded([suffix for suffix, _, _ in chosen])
    return {
        "part": part, "count": len(chosen), "places": places[[i for *_, i in chosen]].tobytes(), "shared": shared.astype("<u2").tobytes(),
        "sizes": np.array([len(r) for r in rest], "<u2").tobytes(), "rest": b"".join(rest),
        "left_sizes": np.array([len(x) for _, x, _ in chosen], "u1").tobytes(), "left": b"".join(x for _, x, _ in chosen),
    }


def _cut(joined: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def unpacked(row: dict) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    """Suffixes, shared lengths, left contexts and places of a run."""
    shared = np.frombuffer(row["shared"], "<u2").tolist()
    strings, before = [], b""
    for n, rest in zip(shared, _cut(row["rest"], np.frombuffer(row["sizes"], "<u2")), strict=True):
        before = before[:n] + rest
        strings.append(before)
    return strings, shared, _cut(row["left"], np.frombuffer(row["left_sizes"], "u1")), np.frombuffer(row["places"], PLACE)


def runs(docs: DataFrame, live: str, parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at live anchors, cut by the hash of the core."""

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int]] = []
        places: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = np.array(places, PLACE)
            by_part: dict[int, list] = {}
            for part, suffix, left, i in sorted(held):
                by_part.setdefault(part, []).append((suffix, left, i))
            rows = [_packed(part, chosen, table) for part, chosen in by_part.items()]
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], schema=_RUN_SCHEMA)
            held.clear()
            places.clear()

        for name, row, text, found in _with_anchors(batches, live, ["row", "pos", "least", "most", "key"]):
            for pos, least, most, key in found:
                held.append((key % parts, text[pos : pos + LENGTH], text[max(0, pos - REACH + 1) : pos][::-1], len(places)))
                places.append((name, row, pos, least, most))
            if len(held) >= RUN_SUFFIXES:
                yield from out()
        if held:
            yield from out()

    return scanned(docs).mapInArrow(sorted_runs, RUN_ROW)


_RUN_SCHEMA = pa.schema([("part", pa.int64()), ("count", pa.int32()), *[(n, pa.binary()) for n in ("places", "shared", "sizes", "rest", "left_sizes", "left")]])


def _with_anchors(batches: Iterator[pa.RecordBatch], folder: str, columns: list[str]) -> Iterator[tuple[int, int, bytes, list[tuple]]]:
    """Block, row, bytes of the text and what the block's file has for the row, for rows that are in it."""
    name, table = None, {}
    for batch in batches:
        for block_name, row, text in zip(batch.column("block").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            if block_name != name:
                name, table = block_name, {}
                found = read_block(folder, block_name, columns)
                if found is not None:
                    for key, *rest in zip(*(found.column(c).to_pylist() for c in columns), strict=True):
                        table.setdefault(key, []).append(tuple(rest))
            yield name, row, bytes(text.as_buffer()) if row in table else b"", table.get(row, [])


def repeated(shared: np.ndarray, lefts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes: which anchors have a string that occurs twice, and the least and most bytes before the anchor of such a string."""
    n = len(places)
    group = np.cumsum(np.concatenate([[True], shared[1:] < CORE]))
    order = sorted(range(n), key=lambda i: (group[i], lefts[i]))
    left_shared = common_prefixes([lefts[i] for i in order])
    order = np.array(order)
    left_new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    low, high = np.full(n, REACH), np.full(n, -1)
    least, most = places["least"].astype(int), places["most"].astype(int)
    alone = np.bincount(group, minlength=int(group[-1]) + 1)[group] < 2
    for before in range(REACH):
        valid = np.flatnonzero((least <= before) & (before <= most) & ~alone)
        if not len(valid):
            continue
        right = np.cumsum(np.concatenate([[True], shared[1:] < LENGTH - before]))
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(left_new | (left_shared < before))
        both = right[valid].astype(np.int64) * (n + 1) + left[valid]
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        twice = valid[counts[inverse] > 1]
        low[twice] = np.minimum(low[twice], before)
        high[twice] = before
    return high >= 0, low, high


_SPANS = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
SPANS = "block long, row int, start long, stop long"


def merged(table: pa.Table) -> pa.Table:
    """Spans to remove, from all runs of one part."""
    held = [unpacked(row) for row in table.to_pylist()]
    order = list(LoserTree([(strings, shared) for strings, shared, _, _ in held]))
    if not order:
        return _SPANS.empty_table()
    shared = np.array([n for *_, n in order])
    lefts = [held[run][2][index] for run, index, _ in order]
    bases = np.cumsum([0, *[len(h[3]) for h in held]])
    places = np.concatenate([h[3] for h in held])[[bases[run] + index for run, index, _ in order]]
    found, low, high = repeated(shared, lefts, places)
    pos = places["pos"][found]
    return pa.table({"block": places["block"][found], "row": places["row"][found], "start": pos - high[found], "stop": pos - low[found] + LENGTH}, schema=_SPANS)


def hot_spans(docs: DataFrame, hot: str) -> DataFrame:
    """Spans around anchors of very frequent cores: their strings are told apart by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, row, text, found in _with_anchors(batches, hot, ["row", "pos", "least", "most"]):
            for k in range(0, len(found), 4096):
                part = found[k : k + 4096]
                begin = max(0, min(pos for pos, _, _ in part) - REACH)
                data = np.frombuffer(text, np.uint8)[begin : max(pos for pos, _, _ in part) + LENGTH]
                starts = np.concatenate([np.arange(pos - most, pos - least + 1) for pos, least, most in part])
                one, two = (hash_of(string_hash(data, base), starts - begin, LENGTH).view(np.int64) for base in _BASES)
                yield pa.record_batch({"block": np.full(len(starts), name), "row": np.full(len(starts), row, np.int32), "start": starts, "h1": one, "h2": two})

    found = written(scanned(docs).mapInArrow(strings, "block long, row int, start long, h1 long, h2 long").distinct(), "hot-strings")
    twice = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return found.join(twice, ["h1", "h2"], "left_semi").select("block", "row", "start", (F.col("start") + LENGTH).alias("stop"))


def spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """block, row, start, stop: byte ranges to remove from the rows of ``docs`` (rows of files), which may overlap."""
    spark = docs.sparkSession
    found = written(scanned(docs).mapInArrow(_anchored, "block long, row int, pos long, least short, most short, key long"), "anchors")
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = written(found.join(keys, "key"), "live")
    n = live.where(F.col("n") <= hot).count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_SUFFIXES))
    usual = write_blocks(live.where(F.col("n") <= hot).drop("n"), "live-anchors")
    out = runs(docs, usual, parts).groupBy("part").applyInArrow(merged, SPANS)
    many = live.where(F.col("n") > hot)
    if not many.isEmpty():
        out = out.unionByName(hot_spans(docs, write_blocks(many.drop("n", "key"), "hot-anchors")))
    return out


def joined_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges covered by the spans; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    docs = in_files(docs)
    folder = write_blocks(spans(docs, hot), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table = None, {}
        for batch in batches:
            out = []
            for doc_id, block_name, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                if block_name != name:
                    name, table = block_name, {}
                    found = read_block(folder, block_name, ["row", "start", "stop"])
                    if found is not None:
                        for r, a, b in zip(*(found.column(c).to_pylist() for c in ("row", "start", "stop")), strict=True):
                            table.setdefault(r, []).append((a, b))
                data = text.as_buffer()
                gone = joined_spans(table.get(row, []))
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(data.slice(at, a - at))
                    at = b
                digest.update(data.slice(at, len(data) - at) if at < len(data) else b"")
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), block().alias("block"), row_in_block().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
