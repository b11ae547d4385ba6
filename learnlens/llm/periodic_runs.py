"""Periodic runs of words, found on enhanced suffix arrays.

A run is a stretch of words with smallest period q (words q apart are the same), as long as it can be made, of at least
``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods. The documents of a batch share one suffix array of word numbers that differ from document
to document, so no prefix is shared across documents. It is built by doubling: the ranks by the first 1, 2, 4, ... words
are kept, and each round sorts only suffixes that are not alone yet. The kept ranks also give the longest common extension of any two
places, to the right or to the left, in a logarithm of steps.

Every LCP interval (a range of the suffix array that shares d words, and no more) is found from the neighbouring smaller LCP values.
Its children are the ranges between its own LCP values. For the suffixes i of all children but the largest it is looked up in the inverse
suffix array whether i + d or i - d lies in the same interval and another child: then a square of period d stands at i (or i - d) that is
not followed by one more word of the period. That is the last square of a stretch with period d; rotating it to the left as far as words agree gives
the stretch. Stretches of one place are merged, the smallest period stays. No tree is built, and taking smaller children
only bounds all look-ups by n log n.

A document in which no four words in a row occur three times has no run (one of four periods and six words repeats its first four words
three times), so its suffix array is not built.

Defined results: a null, empty or blank text has no words and no run. Rows without an id keep their text as it is. Repeated rows are
treated each. An empty table gives an empty result. Other columns are not read. A task holds a batch of about
``BATCH_BYTES`` bytes of text, or one longer document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from learnlens.llm.base import documents, id_and_text, slices
from learnlens.llm.byte_bpe import gathered

LEAST_WORDS, LEAST_PERIODS = 6, 4
GRAM = 4  # words of which a run holds three equal ones
BATCH_BYTES = 2 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Source = Callable[[int | None, int], np.ndarray | None]


def rank_levels(symbols: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols until all differ (or ``levels`` of them); equal prefixes have equal ranks.

    A rank is the number of suffixes that sort before the group. Each array has one more place for the end, which equals no other.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    opens = np.diff(symbols[order], prepend=symbols[order[:1]] - 1) != 0
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    found = [rank.astype(np.int32)]
    members = np.flatnonzero(_shared(rank[:n], n))
    length = 1
    while len(members) and len(found) != levels:
        after = rank[np.minimum(members + length, n)]
        key = rank[members] * (n + 2) + after + 1
        by_key = np.argsort(key, kind="stable")
        members, key = members[by_key], key[by_key]
        place = np.arange(len(members))
        group = np.maximum.accumulate(np.where(np.diff(key // (n + 2), prepend=-1) != 0, place, 0))
        part = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        rank = rank.copy()
        rank[members] += part - group
        found.append(rank.astype(np.int32))
        members = members[_shared(rank[members], n)]
        length *= 2
    return found


def _shared(ranks: np.ndarray, n: int) -> np.ndarray:
    """Which ranks occur more than once."""
    return (np.bincount(ranks, minlength=n) > 1)[ranks]


def _lcp(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at i and j share."""
    i, j = i.copy(), j.copy()
    shared = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        step = np.where(levels[k][i] == levels[k][j], 1 << k, 0)
        shared += step
        i += step
        j += step
    return shared


def _rotated_left(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The first place from which on words agree with those a period later, up to ``start``."""
    start = start.copy()
    for k in reversed(range(len(levels))):
        to = start - (1 << k)
        inside = np.maximum(to, 0)
        start = np.where((to >= 0) & (levels[k][inside] == levels[k][inside + period]), to, start)
    return start


def _smaller_before_and_after(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before and the nearest one after it with a smaller value; the ends of ``lcp`` are smaller than all."""
    minima = [lcp]
    while 2 << (len(minima) - 1) <= len(lcp):
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    value, before, after = lcp[at], at.copy(), at + 1
    for k in reversed(range(len(minima))):
        size, held = 1 << k, minima[k]
        low = before - size  # the values from here to before - 1
        before = np.where((low >= 0) & (held[np.maximum(low, 0)] >= value), low, before)
        fits = after + size <= len(lcp)
        after = np.where(fits & (held[np.minimum(after, len(held) - 1)] >= value), after + size, after)
    return before - 1, after


def last_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place and period of the squares that one more symbol does not continue."""
    n = len(levels[0]) - 1
    inverse = levels[-1][:n].astype(np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[1:n] = _lcp(levels, suffixes[:-1], suffixes[1:])
    cuts = np.flatnonzero(lcp > 0)
    first, after = _smaller_before_and_after(lcp, cuts)
    large = after - first >= LEAST_PERIODS  # a run's last square shares its interval with two suffixes more at least
    cuts, first, after = cuts[large], first[large], after[large]
    if not len(cuts):
        return cuts, cuts
    depth = lcp[cuts].astype(np.int64)
    order = np.lexsort((cuts, depth, first))
    cuts, first, after, depth = cuts[order], first[order], after[order], depth[order]
    opens = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(depth, prepend=-1) != 0))
    number = np.zeros(len(cuts), np.int64)
    number[opens] = 1
    number = np.cumsum(number) - 1
    # an interval of k cuts has k + 1 children: one from its first suffix on, and one from each cut on
    n_children = np.diff(opens, append=len(cuts)) + 1
    head = np.cumsum(n_children) - n_children
    child_first = np.empty(len(cuts) + len(opens), np.int64)
    child_first[head] = first[opens]
    child_first[np.arange(len(cuts)) + number + 1] = cuts
    child_after = np.append(child_first[1:], 0)
    child_after[head + n_children - 1] = after[opens]
    sizes = child_after - child_first
    of = np.repeat(np.arange(len(opens)), n_children)
    rank_in = np.lexsort((-sizes, of))  # the largest child first; it is left out
    small = np.ones(len(sizes), bool)
    small[rank_in[head]] = False
    small = np.flatnonzero(small)
    count = sizes[small]
    child = np.repeat(small, count)
    i = suffixes[gathered(np.arange(n), child_first[small], count)]
    d, low, high = depth[opens][of[child]], first[opens][of[child]], after[opens][of[child]]
    places, periods = [], []
    for other, square in ((i + d, i), (i - d, i - d)):
        inside = (other >= 0) & (other < n)
        rank = inverse[np.where(inside, other, 0)]
        hit = inside & (rank >= low) & (rank < high) & ~((rank >= child_first[child]) & (rank < child_after[child]))
        places.append(square[hit])
        periods.append(d[hit])
    return np.concatenate(places), np.concatenate(periods)


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, by start and period. Symbols of different documents differ."""
    none = np.zeros(0, np.int64)
    if len(symbols) < LEAST_WORDS:
        return none, none, none
    levels = rank_levels(symbols)
    place, period = last_squares(levels)
    stop = place + 2 * period
    start = _rotated_left(levels, place, period)
    long = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, stop, period = start[long], stop[long], period[long]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0)
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (stop - start)[order], period[order]


def _with_repeats(symbols: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Which documents hold some ``GRAM`` words in a row three times."""
    if not len(symbols):
        return np.zeros(n_docs, bool)
    levels = rank_levels(symbols, GRAM.bit_length())
    held = np.zeros(n_docs, bool)
    if len(levels) == GRAM.bit_length():
        grams = levels[-1][:-1]
        held[doc[(np.bincount(grams, minlength=len(symbols)) >= 3)[grams]]] = True
    return held


def _batch(doc_ids: list[int | None], texts: list[str], source: Source | None) -> pa.RecordBatch:
    words = [text.encode().split() for text in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(n_words) - n_words
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for found in words for w in found]
    if source is not None:
        for k, doc_id in enumerate(doc_ids):
            if (at := source(doc_id, len(words[k]))) is not None:
                here = slice(starts[k], starts[k] + n_words[k])
                flat[here] = flat[here][at]
    numbers, known = pd.factorize(flat)
    doc = np.repeat(np.arange(len(texts)), n_words)
    symbols = doc * max(1, len(known)) + numbers
    picked = _with_repeats(symbols, doc, len(texts))[doc]
    places = np.flatnonzero(picked)
    start, length, period = runs(symbols[picked])
    start = places[start]  # a run lies within one document, whose words all are picked
    drops = np.zeros(len(flat) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, start + length, -1)
    kept = np.cumsum(drops)[:-1] == 0
    of = doc[start]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    columns: list[list] = [[], [], [], [], [], [], []]
    for k in range(len(texts)):
        here = slice(bounds[k], bounds[k + 1])
        found = [*zip((start[here] - starts[k]).tolist(), length[here].tolist(), period[here].tolist(), strict=True)]
        best = max(found, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)
        body = flat[starts[k] : starts[k] + n_words[k]]
        if found:
            body = body[kept[starts[k] : starts[k] + n_words[k]]]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        values = (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], _sha(listed.encode()), _sha(b" ".join(body)))
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    names = [field.split()[0] for field in SCHEMA.split(", ")][1:]
    longs = {name: pa.array(column, pa.int64()) for name, column in zip(names[:5], columns[:5], strict=True)}
    texts_out = {name: pa.array(column, pa.string()) for name, column in zip(names[5:], columns[5:], strict=True)}
    return pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), **longs, **texts_out})


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def periodic_runs(docs: DataFrame, source: Source | None = None) -> DataFrame:
    """Per row the number of runs, the one of the greatest length per period, and digests of all runs and of the words kept.

    ``source`` may give, for an id and a number of words, which word stands at each place instead.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield _batch(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), source)

    return id_and_text(docs).mapInArrow(found, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The periodic tail that the query plants in a tenth of the documents, by the crc32 of their id."""
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), planted)
