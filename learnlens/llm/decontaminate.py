"""Benchmark decontamination by templates, which also catches questions with other numbers, names and units.

A text becomes tokens: runs of letters, single letters of scripts written without spaces, and numbers. Numbers, units of measure and names (capitalised words inside a
sentence) become typed placeholders, other words are lower-cased; punctuation and white space go. Every window of
``WINDOW`` template tokens with at least ``LEAST_WORDS`` real words is hashed; a benchmark item shorter than a window is
one window of its own length. A window with capitalised words that begin sentences is hashed a second time with those as names too,
as the same name may stand inside a sentence in the other text, or be another one there.

An item of which less than half of the windows have that many words, or of fewer than ``LEAST_TOKENS`` tokens, also has exact
windows: of its tokens without placeholders, lower-cased, whatever words they hold.

Documents keep only windows that a bitmap of the benchmark's windows may hold; its size is fixed whatever the size of the
benchmark. Those windows are joined with the benchmark's by hash. Matches of a document and an item on one diagonal
(distance between the two places) are an alignment. In an alignment each slot of the item has a value in the
document; the values are consistent if equal slots of the item got equal values in nearly all places. They are judged without the words
that begin sentences and again with them, and one of the two is enough. A window with the item's own
values counts anyway. An item is leaked in a document if what is consistent covers at least ``COVERAGE`` of its windows, or
has ``RUN`` tokens in a row, each in a matching window and none of the item's windows between them missed.

Documents are scanned whole, and no text is shuffled. A passage that very many documents hold is a hot key of the join on
the documents' side alone, which adaptive skew handling splits; what comes after is grouped by document and item.

Defined results: null and empty texts match nothing, and neither do items without tokens; an item of a single word is leaked
wherever that word stands. An empty benchmark leaves all documents clean. Rows that share a doc_id are judged each by its own text, repeated rows alike,
and rows without an id like all others. Rows of one item_id are judged each by its own text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from learnlens.llm.base import documents, joined_bytes, slices, table, without
from learnlens.llm.near_dedup import MIX, TAIL, mixed, powers
from learnlens.sources.scratch import written

WINDOW, LEAST_TOKENS, LEAST_WORDS = 6, 5, 3
COVERAGE, CONSISTENT, RUN = 0.5, 0.8, 13
FILTER_BITS = 1 << 24
SLICE_BYTES = 2 << 20

# Names of units of measure.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound
pounds ml l liter liters litre litres gallon gallons cup cups second seconds sec minute minutes min hour hours hr day days week weeks
month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit watt
watts volt volts joule joules newton newtons meter meters metre metres centimeter centimeters kilometer kilometers kmh mph
""".split()

# Scripts written without spaces between words, as ranges of code points.
UNSEGMENTED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF)]

WORD, NUMBER, NAME, UNIT = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACEHOLDER = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_STARTS_SENTENCE = frozenset(".!?:;\n\r\"“”«»()[]")
_tables: list[tuple[np.ndarray, ...]] = []
TEMPLATE, OPENED, EXACT = range(3)
_EXACT = np.uint64(0xC2B2AE3D27D4EB4F)
_WINDOW_MIX = np.concatenate([MIX, MIX * TAIL[0] + TAIL[1]])


def _characters() -> tuple[np.ndarray, ...]:
    """For each code point: kind (0 other, 1 letter, 2 digit, 3 a word by itself), lower case, whether upper, whether it ends a sentence."""
    if not _tables:
        size = 0x110000
        kind, lower, upper, stop = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32), np.zeros(size, bool), np.zeros(size, bool)
        for i in range(size):
            char = chr(i)
            if char.isalpha():
                kind[i] = 1
                low = char.lower()
                upper[i] = low != char
                lower[i] = ord(low) if len(low) == 1 else i
            elif char.isdecimal():
                kind[i] = 2
            stop[i] = char in _STARTS_SENTENCE
        for low, high in UNSEGMENTED:
            part = kind[low : high + 1]
            part[part == 1] = 3
        _tables.append((kind, lower, upper, stop))
    return _tables[0]


def _hashed(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    up, down = powers(_BASE, len(points) + 1), powers(_INVERSE, len(points) + 1)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mixed((summed[last] - summed[first]) * down[first])


def _unit_hashes() -> np.ndarray:
    return np.sort(np.concatenate([_hashed(np.array([*map(ord, u)], np.uint32), np.array([0]), np.array([len(u)])) for u in UNITS]))


class Tokens:
    """Tokens of a batch of texts: where they begin and end, kind, template value, and the text each belongs to."""

    def __init__(self, texts: pa.Array):
        kind_of, lower_of, upper_of, stop_of = _characters()
        data, _ = joined_bytes(texts)
        self.points = points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.asarray(pc.utf8_length(texts)), dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        kind = kind_of[points]
        edge = np.zeros(len(points) + 1, bool)
        edge[starts] = True
        begins, closes = kind > 0, kind > 0
        if len(points):
            changes = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1] | (kind == 3)
            begins = begins & changes
            closes = closes & np.concatenate([changes[1:], [True]])
        first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(ends, first, "right")
        # 1,234.5 is one number: digits after digits and one point or comma
        number = kind[first] == 2
        if len(first) > 1:
            tied = number[1:] & number[:-1] & (first[1:] == last[:-1] + 1) & np.isin(points[last[:-1]], [44, 46]) & (self.text[1:] == self.text[:-1])
            keep = np.concatenate([[True], ~tied])
            last = last[np.concatenate([~tied, [True]])]
            first, number, self.text = first[keep], number[keep], self.text[keep]
        lowered = lower_of[points]
        hashes = _hashed(lowered, first, last)
        stops = np.concatenate([[0], np.cumsum(stop_of[points])])
        opening = np.ones(len(first), bool)
        if len(first) > 1:
            opening[1:] = (self.text[1:] != self.text[:-1]) | (stops[first[1:]] > stops[last[:-1]])
        second = np.minimum(first + 1, max(len(points) - 1, 0))
        title = upper_of[points[first]] & (last - first > 1) & ~upper_of[points[second]] if len(first) else opening
        units = _unit_hashes()
        unit = units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes
        self.kind = np.select([number, unit, title & ~opening], [NUMBER, UNIT, NAME], WORD)
        self.value = np.where(self.kind == WORD, hashes, _PLACEHOLDER[self.kind])
        opener = title & opening & (self.kind == WORD)
        self.openers = np.concatenate([[0], np.cumsum(opener)])
        opened = np.where(opener, NAME, self.kind)
        #: kind and value of each token by the way a window is hashed; an exact window has only words
        self.kinds = {TEMPLATE: self.kind, OPENED: opened, EXACT: np.full(len(first), WORD)}
        self.values = {TEMPLATE: self.value, OPENED: np.where(opener, _PLACEHOLDER[NAME], self.value), EXACT: hashes}
        self.first, self.last = first, last
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def windows(self, length: int, way: int = TEMPLATE) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at which a window of the length begins, and the windows' hashes; of the way OPENED only where it differs."""
        n = len(self.first) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.text[:n] == self.text[length - 1 :]
        if way == OPENED:
            inside &= self.openers[length:] > self.openers[:n]
        if way != EXACT:
            words = np.concatenate([[0], np.cumsum(self.kinds[way] == WORD)])
            inside &= words[length:] - words[:n] >= LEAST_WORDS
        at = np.flatnonzero(inside)
        total = np.full(len(at), length, np.uint64) * TAIL[1] + _EXACT * np.uint64(way == EXACT)
        for k in range(length):
            total += self.values[way][at + k] * _WINDOW_MIX[k]
        return at, mixed(total)

    def slots(self, at: int, length: int, way: int = TEMPLATE) -> list[dict]:
        """The placeholders of a window: offset, kind and text of each."""
        found, kinds = [], self.kinds[way]
        for k in range(at, at + length):
            if kinds[k] != WORD:
                text = self.points[self.first[k] : self.last[k]].tobytes().decode("utf-32-le").lower()
                found.append({"offset": k - at, "kind": int(kinds[k]), "value": text})
        return found


SLOTS = "array<struct<offset:int,kind:int,value:string>>"
_SLOT_TYPE = pa.list_(pa.struct([("offset", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))


def _between(at: np.ndarray, hashes: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    mine = (at >= first) & (at < end)
    return at[mine], hashes[mine]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, out = Tokens(batch.column("text")), []
        for i, (a, b) in enumerate(zip(tokens.bounds[:-1], tokens.bounds[1:], strict=True)):
            n, length = int(b - a), min(WINDOW, int(b - a))
            ways, usable = [], 0
            if n >= LEAST_TOKENS:
                ways = [(way, *_between(*tokens.windows(length, way), a, b)) for way in (TEMPLATE, OPENED)]
                usable = len(ways[0][1])
            if n and 2 * usable < n - length + 1:
                ways.append((EXACT, *_between(*tokens.windows(length, EXACT), a, b)))
            for way, at, hashes in ways:
                # what OPENED has is among the windows of TEMPLATE
                whole = ways[0][1] if way == OPENED else at
                for rank, place, value in zip(np.searchsorted(whole, at).tolist(), at, hashes.view(np.int64).tolist(), strict=True):
                    out.append((batch.column("item_id")[i].as_py(), batch.column("row")[i].as_py(), way, int(place - a), rank, len(whole), length, value, tokens.slots(place, length, way)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), _SLOT_TYPE)
        names = ("item_id", "row", "way", "item_pos", "rank", "n_windows", "length", "hash", "slots")
        yield pa.record_batch({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.withColumn("row", F.xxhash64("item_id", "text")).distinct()
    return written(items.mapInArrow(_item_windows, f"item_id long, row long, way int, item_pos int, rank int, n_windows int, length int, hash long, slots {SLOTS}"), "benchmark")


def window_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the windows' hashes, one byte for eight bits; at most bits / 64 rows come to the driver, as Arrow columns."""
    spread = windows.select(F.pmod("hash", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    words = np.zeros(bits // 64, np.int64)
    found = spread.toArrow()
    words[found["id"].to_numpy()] = found["word"].to_numpy()
    return words


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents that the benchmark may hold: doc_id, body (hash of the text), doc_pos, hash, opened, slots."""
    exact = F.col("way") == EXACT
    kinds = sorted((row["exact"], row["length"]) for row in windows.select(exact.alias("exact"), "length").distinct().collect())
    ways = [(way, length) for exact, length in kinds for way in ((EXACT,) if exact else (TEMPLATE, OPENED))]
    held = docs.sparkSession.sparkContext.broadcast(window_filter(windows))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        bits = np.int64(len(words) * 64)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                tokens = Tokens(piece.column("text"))
                for way, length in ways:
                    at, hashes = tokens.windows(length, way)
                    hashes = hashes.view(np.int64)
                    bit = np.mod(hashes, bits)
                    hit = np.flatnonzero(words[bit >> 6] >> (bit & 63) & 1)
                    if len(hit):
                        at, owner = at[hit], pa.array(tokens.text[at[hit]])
                        yield pa.record_batch({
                            "doc_id": piece.column("doc_id").take(owner),
                            "body": piece.column("body").take(owner),
                            "doc_pos": pa.array((at - tokens.bounds[tokens.text[at]]).astype(np.int64)),
                            "hash": pa.array(hashes[hit]),
                            "opened": pa.array(np.full(len(hit), way == OPENED)),
                            "slots": pa.array([tokens.slots(k, length, way) for k in at], _SLOT_TYPE),
                        })

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("body", F.xxhash64("text")).mapInArrow(found, f"doc_id long, body long, doc_pos long, hash long, opened boolean, slots {SLOTS}")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body, item_id, coverage: the items leaked in documents."""
    windows = benchmark_windows(benchmark)
    theirs = windows.select("item_id", "row", "way", "item_pos", "rank", "n_windows", "length", "hash", F.col("slots").alias("item_slots"))
    matched = candidates(docs, windows).join(theirs, "hash")
    # the same slots in the same places, so that a collision of hashes or kinds is no match
    shape = lambda slots: F.transform(slots, lambda s: F.struct(s["offset"], s["kind"]))
    matched = matched.where(shape(F.col("slots")) == shape(F.col("item_slots")))
    pair = ["doc_id", "body", "item_id", "row"]
    matched = matched.withColumns({"diagonal": F.col("doc_pos") - F.col("item_pos"), "own": F.col("slots") == F.col("item_slots"), "exact": F.col("way") == EXACT, "opened": F.col("opened") | (F.col("way") == OPENED)})
    matched = written(matched.drop("hash", "way"), "matches")

    # judged without (0) and with (1) the windows in which words that begin sentences are names
    matched = matched.withColumn("view", F.explode(F.when(F.col("opened"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    line = [*pair, "diagonal", "view"]
    slots = matched.select(*line, "item_pos", F.explode(F.arrays_zip("slots", "item_slots")).alias("s"))
    slots = slots.select(*line, (F.col("item_pos") + F.col("s.slots.offset")).alias("place"), F.col("s.slots.kind").alias("kind"), F.col("s.item_slots.value").alias("item_value"), F.col("s.slots.value").alias("value")).distinct()
    values = slots.groupBy(*line, "kind", "item_value", "value").agg(F.count(F.lit(1)).alias("places"))
    values = values.groupBy(*line, "kind", "item_value").agg(F.max("places").alias("same"), F.sum("places").alias("all"))
    torn = values.groupBy(*line).agg(F.sum("same").alias("same"), F.sum("all").alias("all")).where(F.col("same") < CONSISTENT * F.col("all"))

    on = ~F.col("own")
    torn = torn.select(*[F.col(c).alias(f"t_{c}") for c in line])
    for c in line:
        on = on & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    sound = matched.join(torn, on, "left_anti").select(*pair, "exact", "diagonal", "item_pos", "rank", "n_windows", "length").distinct()
    ordered = Window.partitionBy(*pair, "exact", "diagonal").orderBy("item_pos")
    follows = (F.col("rank") == F.lag("rank").over(ordered) + 1) & (F.col("item_pos") - F.lag("item_pos").over(ordered) <= F.col("length"))
    sound = sound.withColumn("begins", F.when(~F.coalesce(follows, F.lit(False)), F.col("item_pos")))
    sound = sound.withColumn("run", F.col("item_pos") + F.col("length") - F.last("begins", ignorenulls=True).over(ordered))
    covered = sound.groupBy(*pair, "exact", "n_windows").agg((F.size(F.collect_set("item_pos")) / F.col("n_windows")).alias("coverage"), F.max("run").alias("run"))
    return covered.where((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN)).groupBy("doc_id", "body", "item_id").agg(F.max("coverage").alias("coverage"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_items, item_ids (ascending), coverage (of the best), kept."""
    found = leaks(docs, benchmark).groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "item_ids", "coverage")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("body"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("item_ids").isNull().alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaked items; all columns stay."""
    gone = leaks(docs, benchmark).select("doc_id", "body").distinct()
    text = F.xxhash64(F.col("row.text").cast("string"))
    return without(docs, gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (text == F.col("body")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
