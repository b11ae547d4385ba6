"""Exact, line, near and suffix dedup against brute force and in odd cases."""

import glob
import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from llm_rows import ODD, rows_by_id
from pyspark.sql import functions as F

from learnlens.llm import line_dedup, near_dedup, registry, stream_dedup, suffix_dedup
from learnlens.llm.components import _star, components

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    theirs = connection.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(theirs)


# --- exact -----------------------------------------------------------------------------------------


def path_of(docs):
    return docs.inputFiles()[0].rsplit("/", 1)[0]


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda text: F.substring(stream_dedup.sha256(text), 1, 0)])
def test_exact_dedup_of_odd_rows(spark, odd, digest):
    """Also when all digests collide: full bytes tell the texts apart."""
    found = stream_dedup.exact_dedup(spark, path_of(odd), digest=digest, filter_bits=64).collect()
    norm = {(i, t): re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in ODD}
    sizes = Counter(norm[row] for row in ODD)
    first = {text: min((i for i, t in ODD if norm[i, t] == text and i is not None), default=None) for text in sizes}
    want = Counter((i, first[norm[i, t]], sizes[norm[i, t]], hashlib.sha256(norm[i, t].encode()).hexdigest()) for i, t in ODD)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(sizes)


def test_exact_dedup_remembers_earlier_runs(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "doc_id long, text string"
    for batch in ([(3, "a b"), (4, "c")], [(1, "a\nb"), (5, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        frame = spark.read.parquet(path)
        stream_dedup.remember(spark, path, frame.schema, state, max_bytes_per_trigger=1)
    with stream_dedup.disk_state(spark):
        known = stream_dedup.remembered(spark, state).collect()
    assert sorted((r["first"]["id"], r["n"]) for r in known) == [(1, 2), (4, 1), (5, 1)]


def test_exact_dedup_of_nothing(spark, none):
    assert stream_dedup.exact_dedup(spark, path_of(none)).collect() == []


# --- lines -----------------------------------------------------------------------------------------


def lines_by_brute_force(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


def line_digests(docs, **how):
    out = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, **how))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return Counter(tuple(r) for r in out.select("row.doc_id", "n_lines", "n_dropped", sha).collect())


def test_lines_of_odd_rows(odd):
    assert line_digests(odd) == lines_by_brute_force(ODD)
    assert line_dedup.deduplicated(odd).columns == odd.columns


@pytest.mark.parametrize("slots", [1, 3, 32])
def test_a_line_of_very_many_documents(make, slots):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["The common line of all", f"own line number {i}", "another shared one", "short"]) for _ in range(rng.randint(1, 150)))) for i in range(200)]
    assert line_digests(make(rows), slots=slots) == lines_by_brute_force(rows)


def test_lines_of_nothing(none):
    assert line_digests(none) == Counter()


# --- near copies -----------------------------------------------------------------------------------


def near_by_brute_force(rows, width=4):
    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    reached = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(reached[a], reached[b])
            if (reached[a], reached[b]) != (low, low):
                reached[a] = reached[b] = low
                changed = True
    return {i: (len(sets[i]), reached[i]) for i in sets}


def chain(prose, copies, words=120):
    """Each text differs a little from the one before it, so far ones are linked through others only."""
    rng, current, out = random.Random(1), prose(words, 1).split(), []
    for _ in range(copies):
        out.append(" ".join(current))
        current[rng.randrange(words)] = f"new{rng.random()}"
    return out


@pytest.mark.parametrize("chunk", [4, 256])
def test_near_copies_are_linked_as_by_brute_force(make, prose, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = list(enumerate([*chain(prose, 40), *[prose(60, 100 + k) for k in range(15)], "a b", "A  b", "a b c", "", " "]))
    random.Random(2).shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    found = near_dedup.near_duplicates(make(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near_by_brute_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_copies_by_longer_shingles(make, prose):
    rows = list(enumerate([*chain(prose, 30, 60), *[prose(40, 200 + k) for k in range(10)], "a b c d", "A b  c d", "a b c"]))
    wide = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make(rows), 5).collect()}
    assert wide == near_by_brute_force(rows, 5) != near_by_brute_force(rows)
    kept = near_dedup.one_of_each(make(rows), 5).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, component) in wide.items() if i == component)


def test_large_groups_face_each_other_in_parts(make, prose, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "FACING", 2)
    rows = list(enumerate([*chain(prose, 50), *[prose(40, 300 + k) for k in range(5)]]))
    found = near_dedup.near_duplicates(make(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near_by_brute_force(rows)


def test_signatures_take_memory_of_a_slice_not_of_a_batch(prose):
    texts = [prose(2000, k) for k in range(300)]
    batch = pa.record_batch({"doc_id": pa.array(range(300), pa.int64()), "text": pa.array(texts)})
    tracemalloc.start()
    sizes = [n for out in near_dedup._signed(4, iter([batch])) for n in out.column("n_shingles").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [len(near_dedup.shingle_set(text, 4)) for text in texts]
    assert batch.nbytes > 3 << 20 and peak < 8 * batch.nbytes


def test_arrow_batches_with_texts_are_bounded_in_bytes(spark):
    def lengths(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes])})

    texts = spark.range(200, numPartitions=1).select(F.repeat(F.lit("a"), 1 << 18).alias("text"))
    before = [spark.conf.get(key) for key in (near_dedup.ARROW_ROWS, near_dedup.ARROW_BYTES)]
    with near_dedup.small_batches(spark, 128):
        found = [r["n"] for r in texts.mapInArrow(lengths, "n long").collect()]
    assert sum(found) >= 200 << 18 and max(found) <= near_dedup.BATCH_BYTES + (1 << 20)
    assert [spark.conf.get(key) for key in (near_dedup.ARROW_ROWS, near_dedup.ARROW_BYTES)] == before


def test_near_copies_of_odd_rows(odd):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_id = rows_by_id(found)
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (1, 2, 3))
    assert by_id[7]["component_id"] == 6 and not by_id[7]["kept"]
    left = near_dedup.one_of_each(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 5, 6, 8, 9, 10]


def test_near_copies_of_nothing(none):
    assert near_dedup.near_duplicates(none).collect() == []


def test_pairs_of_the_threshold_are_rarely_given_up():
    fewest = near_dedup.least_matches()
    rng = random.Random(0)
    lost = 0
    for _ in range(3000):
        equal = [rng.random() < 0.8 for _ in range(near_dedup.HASHES)]
        lost += any(sum(equal[: (k + 1) * near_dedup.BATCH]) < least for k, least in enumerate(fewest))
    assert lost == 0 and fewest == sorted(fewest)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16)]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{i: 16 for i in range(16, 21)}}


def test_few_links_in_many_partitions_are_few_tasks(spark, monkeypatch):
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in changed}
    links = [(k + 1, k) for k in range(30) if k % 10]
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        frame = spark.createDataFrame(links, "a long, b long")
        assert all(_star(frame, large, 3).rdd.getNumPartitions() <= 3 for large in (True, False))
        monkeypatch.setattr("learnlens.llm.components.LINKS_EACH", 2)
        found = components(frame).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r["node"]: r["component"] for r in found} == {k: (k - 1) // 10 * 10 + 1 for k in range(1, 31)}


# --- repeated byte strings -------------------------------------------------------------------------


def bytes_by_brute_force(rows, n=suffix_dedup.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + n] for d in data for k in range(len(d) - n + 1))
    out = Counter()
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - n + 1):
            if seen[d[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_bytes_as_by_brute_force(make, prose, hot):
    rng = random.Random(4)
    shared = [prose(90, k)[:n] for k, n in ((1, 399), (2, 400), (3, 401), (4, 520))]
    rows = []
    for i in range(40):
        parts = [prose(rng.randint(3, 120)) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared)[rng.choice([0, 0, 1]) :])
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 1300), (101, "ab" * 500), (102, rows[3][1]), (103, rows[3][1][:700]), (104, "é" * 250), (None, rows[5][1]), (7, rows[7][1]), (105, None), (106, "")]
    found = suffix_dedup.removed(make(rows, clashing=True), hot).collect()
    assert Counter(tuple(r) for r in found) == bytes_by_brute_force(rows)


def test_long_texts_are_anchored_in_overlapping_pieces(make, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 900)
    rows = [(1, prose(600, 1)), (2, prose(300, 2) + prose(600, 1)[500:2600] + prose(50, 3))]
    found = suffix_dedup.removed(make(rows)).collect()
    assert Counter(tuple(r) for r in found) == bytes_by_brute_force(rows)


def test_repeated_bytes_of_nothing(none):
    assert suffix_dedup.removed(none).collect() == []


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(6)
    runs = []
    for _ in range(7):
        strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 30)))
        shared, _ = suffix_dedup.front_coded(strings)
        runs.append((strings, shared.tolist()))
    order = list(suffix_dedup.LoserTree(runs))
    merged = [runs[r][0][k] for r, k, _ in order]
    assert merged == sorted(s for strings, _ in runs for s in strings)
    assert [n for *_, n in order] == [0, *[len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:], strict=False)]]
