"""Periodic runs against a plain version of the definition."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from llm_rows import ODD

from learnlens.llm import periodic_runs

SMALL = "/root/testdata/sf0.001"


def runs_plainly(words):
    """Every stretch in which words q apart agree, for every q; of equal stretches the smallest q."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def row_plainly(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(runs_plainly(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 50), st.integers(1, 12))
def test_runs_of_symbols(symbols, at, period):
    tail = symbols[at:]
    for words in (symbols, symbols[:at] + [tail[i % period % len(tail)] for i in range(len(tail))]):
        found = [*zip(*[x.tolist() for x in periodic_runs.runs(np.array(words, np.int64))])]
        assert found == runs_plainly(words)


def test_runs_of_rows(make):
    rng = random.Random(2)
    made = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    made += ["a " * 500, "a b c " * 300 + "d " * 7, "\x1c " * 9, "x\x0by z w " * 6, "Fibonacci " + " ".join("abaababaabaab" * 3)]
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(made)]]
    for source in (None, periodic_runs.planted):
        found = periodic_runs.periodic_runs(make(rows, clashing=True), source).collect()
        assert Counter(tuple(r) for r in found) == Counter(row_plainly(i, t, source is not None) for i, t in rows)


def test_whole_small_table(spark):
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = periodic_runs.op13_periodic_runs(spark, SMALL).collect()
    assert Counter(tuple(r) for r in found) == Counter(row_plainly(r["doc_id"], r["text"], True) for r in rows)
    assert sum(r["n_runs"] > 0 for r in found) > len(rows) / 20


def test_a_long_run_and_a_long_text():
    words = np.array([*range(30_000), *([5, 6, 7] * 20_000), *range(40_000, 50_000)])
    assert [x.tolist() for x in periodic_runs.runs(words)] == [[30_000], [60_000], [3]]


def test_runs_of_nothing(none):
    assert periodic_runs.periodic_runs(none).collect() == []
