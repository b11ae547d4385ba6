"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Each document's distinct shingles of ``width`` words are hashed to a signature of ``HASHES`` minima. Documents with the same
   words in the same order, by the sha256 of their words, are one class from here on, represented by the smallest id.
2. ``BANDS`` bands of the signature put classes into buckets. Two sets with similarity 0.8 share no bucket once in
   twenty million pairs (0.59 ** 32). Buckets of one class end here.
3. In each bucket every class is paired with one centre, another one per band; so a bucket of n gives n - 1 pairs.
4. Pairs are compared batch by batch of their signatures. After m of n equal hashes, with a uniform prior, the similarity s
   has the posterior Beta(m + 1, n - m + 1); a pair goes as soon as P(s >= threshold) < ``MISS``.
5. Survivors are verified on the full sets of shingles: first the best pair of each class, then those that still lie between
   different components.
6. Buckets whose classes all lie in one component need no more pairs. In the others the classes of different components
   are compared chunk against chunk within tasks, by step 4 and then on the full sets; a task joins components as it
   goes and gives out only the links that join two, which are verified on the texts. So no link between components is lost, no
   matter how large a bucket is, and no task holds more than a few chunks.

A centre's text is spread over as many copies as its pairs need. Only counts come to the driver.

Defined results: a null or empty text or one of white space has no shingles and is linked with nothing; its component is
its own id. A text with fewer than ``width`` words has its whole sequence as one shingle. Rows that repeat a doc_id count
as one document. Rows without an id are linked with nothing, stay, and have no component. Very long texts are hashed
whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import LOWER, UPPER, documents, id_and_text, joined_bytes, slices, without
from learnlens.llm.components import components
from learnlens.sources.scratch import written

WORDS = 4
HASHES, BANDS, BATCH = 128, 32, 16
ROWS = HASHES // BANDS
PERCENT = 80
MISS = 1e-6
CHUNK, CHUNK_SHINGLES, FACING = 256, 1 << 20, 8
SPREAD = 512
SLICE_BYTES = 1 << 18
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

_random = np.random.default_rng(20_240_101)
_odd = lambda n: _random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX, TAIL = _odd(1)[0], _odd(4), _odd(2)
FACTORS, SHIFTS = _odd(HASHES), _odd(HASHES)
BAND_MIX = _odd(ROWS)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * TAIL[0]
    return h ^ (h >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and for each text the place of its first word."""
    data, starts = joined_bytes(texts)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts[:-1][starts[:-1] < len(data)]] |= ~space[starts[:-1][starts[:-1] < len(data)]]
    first = np.flatnonzero(begins)
    ends = ~space
    ends[:-1] &= space[1:]
    inner = starts[1:][(starts[1:] > 0)] - 1
    ends[inner] |= ~space[inner]
    last = np.flatnonzero(ends) + 1
    up = powers(BASE, len(data) + 1)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down = powers(inverse, len(data) + 1)
    return mixed((summed[last] - summed[first]) * down[first]), np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of one text; of fewer words than ``width``, one hash of the whole sequence."""
    if not len(words):
        return words
    factors = powers(MIX[0], min(len(words), width) + 1)[1:]
    if len(words) < width:
        return mixed((words * factors).sum(keepdims=True, dtype=np.uint64) + TAIL[1] * np.uint64(len(words)))
    grams = len(words) - width + 1
    return np.unique(mixed(sum(words[k : k + grams] * factors[k] for k in range(width))))


def word_digest(text: str) -> bytes:
    """sha256 of the words in order; bytes split at the same six characters as words."""
    return sha256(b" ".join(text.encode().translate(_LOWER).split())).digest()


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set (``starts`` of non-empty runs of ``hashes``) the least value of each hash function, as uint32."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((hashes * FACTORS[k] + SHIFTS[k]) >> np.uint64(32), starts)
    return out


def _signed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            words, at = words_of(piece.column("text"))
            sets = [shingle_hashes(words[a:b], width) for a, b in zip(at[:-1], at[1:], strict=True)]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            signature = np.zeros((len(sets), HASHES), np.uint32)
            cuts = np.concatenate([[0], np.cumsum(sizes[full])])
            start = 0
            while start < len(full):  # runs that stay in the processor's cache
                stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + 30_000)))
                stop = min(stop, len(full))
                signature[full[start:stop]] = minima(np.concatenate([sets[i] for i in full[start:stop]]), cuts[start:stop] - cuts[start])
                start = stop
            rows = signature.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
            keys = mixed((rows * BAND_MIX).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * TAIL[1]).view(np.int64)
            low = signature.astype(np.uint16)
            yield pa.record_batch({
                "doc_id": piece.column("doc_id"),
                "n_shingles": pa.array(sizes),
                "digest": pa.array([word_digest(text) for text in piece.column("text").to_pylist()], pa.binary()),
                "signature": pa.array([row.tobytes() for row in low], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
            })


def signatures(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the words, signature (16 bits a hash) and band keys of every row."""
    return id_and_text(docs).mapInArrow(partial(_signed, width), "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>")


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair goes on.

    With m of n equal, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    fewest = []
    for n in range(batch, hashes + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return fewest


def agreement(left: np.ndarray, right: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Equal hashes of each pair of rows, or -1 for pairs given up on the way."""
    total = np.zeros(len(left), np.int32)
    open_ = np.arange(len(left))
    for k, least in enumerate(fewest):
        part = slice(k * BATCH, (k + 1) * BATCH)
        total[open_] += (left[open_, part] == right[open_, part]).sum(axis=1, dtype=np.int32)
        lost = total[open_] < least
        total[open_[lost]] = -1
        open_ = open_[~lost]
        if not len(open_):
            break
    return total


def unpacked(column: pa.Array) -> np.ndarray:
    data, _ = joined_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(len(column), HASHES)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fewest = least_matches()
    for batch in batches:
        equal = agreement(unpacked(batch.column("sig_a")), unpacked(batch.column("sig_b")), fewest)
        stays = equal >= 0
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "equal": pa.array(equal)}).filter(pa.array(stays))


def _linked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two chunks against each other: links that join components, found by bands, signatures and whole sets in turn."""
    fewest = least_matches()
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [_Side(batch.column(name)[k].values) for name in ("left", "right")]
            left, right = sides
            same = batch.column("same")[k].as_py()
            for i in range(len(left.ids)):
                other = right.components != left.components[i]
                if same:
                    other &= right.ids > left.ids[i]
                other &= 100 * np.minimum(right.sizes, left.sizes[i]) >= PERCENT * np.maximum(right.sizes, left.sizes[i])
                at = np.flatnonzero(other)
                at = at[(right.bands[at] == left.bands[i]).any(axis=1)]
                if not len(at):
                    continue
                equal = agreement(np.broadcast_to(left.signatures[i], (len(at), HASHES)), right.signatures[at], fewest)
                found = []
                for j in at[np.argsort(-equal, kind="stable")][: int((equal >= 0).sum())]:
                    if left.components[i] != right.components[j]:
                        both = len(np.intersect1d(left.sets[i], right.sets[j], assume_unique=True))
                        if 100 * both >= PERCENT * (left.sizes[i] + right.sizes[j] - both):
                            found.append(j)
                            into, gone = left.components[i], right.components[j]
                            for side in sides:
                                side.components[side.components == gone] = into
                if found:
                    yield pa.record_batch({"a": pa.array(np.full(len(found), left.ids[i])), "b": pa.array(right.ids[found])})


class _Side:
    """The classes of a chunk."""

    def __init__(self, rows: pa.StructArray):
        field = lambda name: rows.field(name)
        self.ids, self.sizes = np.asarray(field("rep")), np.asarray(field("n"))
        self.components = np.array(field("component"))
        self.signatures = unpacked(field("signature"))
        self.bands = np.asarray(field("bands").flatten()).reshape(-1, BANDS)
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.asarray(field("shingles").flatten())
        self.sets = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            words, at = words_of(piece.column("text"))
            sets = [shingle_hashes(words[a:b], width).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch({"rep": piece.column("doc_id"), "shingles": pa.array(sets, pa.list_(pa.int64()))})


def shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    words = [w for w in _SPLIT.split(text.translate(str.maketrans(UPPER, LOWER))) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _verified(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[int | None, set] = (None, set())
    for batch in batches:
        linked = []
        for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            if held[0] != b:
                held = (b, shingle_set(text_b.as_py(), width))
            mine = shingle_set(text_a.as_py(), width)
            both = len(mine & held[1])
            linked.append(100 * both >= PERCENT * (len(mine) + len(held[1]) - both))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(linked))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows and at most ``BATCH_BYTES``, or one row, in an Arrow batch while a plan runs whose rows hold whole texts or chunks."""
    before = {key: spark.conf.get(key) for key in (ARROW_ROWS, ARROW_BYTES)}
    spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def verify(pairs: DataFrame, texts: DataFrame, width: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. b may be one end of very many pairs."""
    spark = pairs.sparkSession
    copies = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / SPREAD) + 1).cast("int").alias("copies"))
    left = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    left = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = copies.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    both = left.join(right, ["b", "copy"]).select("a", "b", "text_a", "text_b")
    with small_batches(spark, 128):
        return written(both.mapInArrow(partial(_verified, width), "a long, b long"), "verified")


def _named(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """Classes with the component found so far, their own id where there is none."""
    return reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    a = comps.select(F.col("node").alias("a"), F.col("component").alias("comp_a"))
    b = comps.select(F.col("node").alias("b"), F.col("component").alias("comp_b"))
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.withColumn("comp_a", F.coalesce("comp_a", "a")).withColumn("comp_b", F.coalesce("comp_b", "b")).where("comp_a <> comp_b")


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    links = links.select("a", "b")
    if comps is not None:
        links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links)


def _settled(pairs: DataFrame, texts: DataFrame, comps: DataFrame | None, by: list[str], width: int) -> DataFrame:
    """Components after verifying ``pairs``: the best for each ``by`` first, the rest only where it could still matter."""
    if comps is not None:
        pairs = written(_still_apart(pairs, comps), "apart")
    best = written(pairs.groupBy(*by).agg(F.max_by(F.struct("a", "b"), "equal").alias("best")).select("best.*").distinct(), "best")
    comps = _joined(comps, verify(best, texts, width))
    rest = written(_still_apart(pairs.select("a", "b"), comps).select("a", "b").distinct().join(best, ["a", "b"], "left_anti"), "rest")
    return comps if rest.isEmpty() else _joined(comps, verify(rest, texts, width))


def _late_links(members: DataFrame, near: DataFrame, texts: DataFrame, width: int) -> DataFrame | None:
    """Links between classes of different components that share a bucket; enough of them to join what belongs together.

    Buckets that still hold several components are gathered into groups of classes, so that a pair is compared once, however
    many buckets it shares. Chunks, bounded in classes and in shingles, meet in a join and are compared within tasks; a key of the
    join holds ``FACING`` chunks of a group and all that face them.
    """
    named = members.join(near.select("rep", "component"), "rep")
    open_ = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("least")).where("low <> high").select("bucket", "least")
    apart = written(members.select("bucket", "rep").join(open_, "bucket").select("rep", "least").distinct(), "apart")
    if apart.isEmpty():
        return None
    groups = components(apart, "rep", "least").withColumnRenamed("node", "rep").withColumnRenamed("component", "grouped")
    sizes = groups.join(near.select("rep", "n"), "rep").groupBy("grouped").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    sizes = sizes.select("grouped", F.greatest(F.floor(F.col("members") / CHUNK), F.floor(F.col("total") / CHUNK_SHINGLES)).alias("more"))
    sets = texts.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(partial(_sets, width), "rep long, shingles array<long>")
    rows = groups.join(sizes, "grouped").join(near, "rep").join(sets, "rep")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("more") + 1).cast("int"))
    gathered = rows.groupBy("grouped", "more", "chunk").agg(F.collect_list(F.struct("rep", "component", "n", "signature", "bands", "shingles")).alias("rows"))
    with small_batches(members.sparkSession, BATCH_ROWS):
        chunks = written(gathered, "chunks")
    part = lambda chunk: F.floor(chunk / FACING).cast("int")
    left = chunks.select("grouped", part(F.col("chunk")).alias("part"), F.col("chunk").alias("one"), F.col("rows").alias("left"))
    right = chunks.select("grouped", F.explode(F.sequence(F.lit(0), part(F.col("chunk")))).alias("part"), F.col("chunk").alias("two"), F.col("rows").alias("right"))
    facing = left.join(right, ["grouped", "part"]).where("one <= two").select("left", "right", (F.col("one") == F.col("two")).alias("same"))
    with small_batches(members.sparkSession, 2):
        return written(facing.mapInArrow(_linked_chunks, "a long, b long").distinct(), "late-links")


def near_duplicates(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, by shingles of ``width`` words."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        rows = written(signatures(docs, width), "signatures")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    reps = rows.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature", "bands"), "reps")

    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min_by("rep", F.xxhash64("bucket", "rep")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(banded.join(buckets, "bucket"), "members")
    involved = written(members.select(F.col("rep").alias("doc_id")).distinct(), "involved")
    comps = None
    if not involved.isEmpty():
        texts = written(id_and_text(docs).join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
        near = written(reps.join(involved.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"), "near")
        a = near.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("sig_a"))
        b = near.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("sig_b"))
        stars = members.where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
        like = stars.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        pairs = written(like.select("a", "b", "sig_a", "sig_b").mapInArrow(_compared, "a long, b long, equal int"), "pairs")
        comps = _settled(pairs, texts, None, ["a"], width)

        late = _late_links(members, _named(near, comps), texts, width)
        if late is not None:
            comps = _joined(comps, verify(late, texts, width))

    out = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", rep.alias("rep"))
    if comps is not None:
        out = _named(out, comps).withColumnRenamed("component", "component_id")
    else:
        out = out.withColumn("component_id", F.col("rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """The documents without those whose component has a smaller id; all columns stay."""
    gone = near_duplicates(docs, width).where("not kept").select("doc_id").distinct()
    return without(docs, gone, F.col("row.doc_id").cast("long") == F.col("doc_id"))


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT shingle, doc_id FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM r x JOIN r y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), c AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents
  UNION
  SELECT c.node, l.b FROM c JOIN l ON l.a = c.reached
), m AS (SELECT node, min(reached) AS component_id FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""
