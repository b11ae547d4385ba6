"""Toxicity by a bidirectional gated recurrent network with attention, over words and their characters.

A word's input is the sum of two learned vectors: one of the word (hashed) and the mean of those of its 3 to 5
adjacent characters (hashed); a run of more than ``LONG_WORD`` letters is several words. Two recurrent layers read a window of ``WINDOW`` words from both ends, attention pools their states, and a
logistic unit scores the window. A window begins at every word up to the last whole one, so that every phrase of up to
``WINDOW`` words lies whole in a window, and a document's score is that of its worst window.

The network is trained in numpy on the driver, on about ``PER_CLASS`` toxic and twice as many clean labelled documents of at most
``TRAIN_CHARS`` characters, chosen by a hash of the id: the bound of what is collected. Labels are of documents; of a toxic
one the windows that score highest, of those that begin every ``TRAIN_STRIDE`` words, count as toxic, at first by how much more often their words occur in toxic documents. The model
(under 4 MB, of fixed size) is broadcast, and all texts are scored whole.

Defined results: a text that is null, empty or without words gets the score of a window of no words. Without labels of both
classes every score is the share of toxic labels, or 0 without any. Rows without an id are held out. A doc_id labelled
more than once is toxic if any of its labels is; a missing label is none. Repeated rows are scored each. Other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from learnlens.llm.base import crc_of_id, documents, joined_bytes, slices, table

WINDOW, TRAIN_STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS, INPUT, HIDDEN, ATTENTION = 1 << 15, 1 << 16, 8, 8, 8
PER_CLASS, TRAIN_CHARS, EPOCHS, BATCH = 1200, 12_000, 5, 128
CHARS, LONG_WORD = (3, 4, 5), 64
SLICE_BYTES = 1 << 20
CACHE_WORDS = 200_000
SCORED_AT_ONCE = 1024
SLID_AT_ONCE = 1024
WORD = re.compile(r"[^\W\d_]+")
CRC_START, CRC_MASK = 7, np.uint32(0xFFFFFFFF)


def words_of(text: str) -> list[str]:
    """Runs of letters; longer ones as words of ``LONG_WORD`` letters, of which neighbours share all but the last of the longest run of characters."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= LONG_WORD:
        return found
    step = LONG_WORD - max(CHARS) + 1
    return [word[k : k + LONG_WORD] for word in found for k in range(0, max(1, len(word) - LONG_WORD + step), step)]


def features(word: str) -> tuple[int, np.ndarray]:
    """Row of the word and rows of its runs of 3 to 5 characters, of which the word's ends count as one each."""
    data = f"<{word}>".encode()
    grams = [zlib.crc32(data[k : k + n], CRC_START) % CHAR_ROWS for n in CHARS for k in range(len(data) - n + 1)]
    return zlib.crc32(data) % WORD_ROWS, np.array(grams, np.int32)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of many words at once: rows of the words, how many runs each has, and the rows of all runs."""
    data = [f"<{word}>".encode() for word in words]
    rows = np.array([zlib.crc32(d) % WORD_ROWS for d in data], np.int64)
    flat, begins = joined_bytes(pa.array(data, pa.large_binary()))
    lengths, begins = np.diff(begins), begins[:-1]
    counts = np.maximum(lengths[:, None] - np.array(CHARS) + 1, 0)
    firsts = (np.cumsum(counts) - counts.ravel()).reshape(counts.shape)
    grams = np.zeros(counts.sum(), np.int32)
    # the checksum of the n bytes from each place on, whatever word they are of
    crc = np.full(len(flat) + 1, CRC_START ^ CRC_MASK, np.uint32)
    for n in range(1, max(CHARS) + 1):
        crc = CRC_TABLE[(crc[:-1] ^ flat[n - 1 :]) & np.uint32(255)] ^ (crc[:-1] >> np.uint32(8))
        if n in CHARS:
            each, first = counts[:, CHARS.index(n)], firsts[:, CHARS.index(n)]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            grams[np.repeat(first, each) + within] = (crc[np.repeat(begins, each) + within] ^ CRC_MASK) % np.uint32(CHAR_ROWS)
    return rows, counts.sum(axis=1), grams


def window_starts(n: int, stride: int = 1) -> range | list[int]:
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, stride), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def summed_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """A table of ``size`` rows in which each of ``rows`` holds the sum of its values."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        held = rows[order]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        out[held[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda *shape: (0.05 * rng.standard_normal(shape)).astype(np.float32)
        self.p = {"words": small(WORD_ROWS, INPUT), "chars": small(CHAR_ROWS, INPUT), "Wa": w(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "ua": w(ATTENTION), "wo": w(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"Wx{d}": w(INPUT, 3 * HIDDEN), f"bx{d}": np.zeros(3 * HIDDEN, np.float32), f"Wh{d}": w(HIDDEN, 3 * HIDDEN), f"bh{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Input vectors of words, by their features."""
        if not found:
            return np.zeros((0, INPUT), np.float32)
        return self.summed(np.array([w for w, _ in found]), np.array([len(c) for _, c in found]), np.concatenate([c for _, c in found]))

    def summed(self, rows: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Input vectors of words, by their rows and the rows of their runs of characters."""
        means = np.add.reduceat(self.p["chars"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return self.p["words"][rows] + means

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inputs give to the gates of the two layers, a row per input."""
        return x @ self.p["Wxf"] + self.p["bxf"], x @ self.p["Wxb"] + self.p["bxb"]

    def forward(self, gates: tuple[np.ndarray, np.ndarray], windows: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Scores of windows (rows of ``gates`` in ``windows``, of which ``lengths`` count), and what learning needs."""
        p, (n, steps) = self.p, windows.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        short = lengths.min(initial=steps) < steps
        places = np.ascontiguousarray(windows.T)
        for d, order, part in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 1)):
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                g = gates[part].take(places[t], axis=0)
                a = h @ p[f"Wh{d}"] + p[f"bh{d}"]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if short:
                    new = np.where((t < lengths)[:, None], new, h)
                if keep:
                    trace[d].append((t, h, z, r, c, a[:, 2 * HIDDEN :]))
                h = new
                states[t, :, part * HIDDEN : (part + 1) * HIDDEN] = h
        inner = np.tanh(states @ p["Wa"] + p["ba"])
        e = inner @ p["ua"]
        if short:
            e = np.where(np.arange(steps)[:, None] < np.maximum(lengths, 1), e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        score = _sigmoid(pooled @ p["wo"] + p["bo"])
        return (score, (states, inner, weight, pooled, trace)) if keep else score

    def slid(self, gates: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
        """Scores of the windows that begin at each of ``words`` (rows of ``gates``) up to the last whole one, as by ``forward``.

        A window is a column, so that a step of all windows reads a slice of the words and no gate is copied.
        """
        p, scores = self.p, np.zeros(max(0, len(words) - WINDOW + 1), np.float32)
        half, two, most = np.float32(0.5), 2 * HIDDEN, min(SLID_AT_ONCE, len(scores))
        weights = [(np.ascontiguousarray(half * p[f"Wh{d}"].T), half * p[f"bh{d}"][:, None]) for d in "fb"]
        out = np.concatenate([p["Wa"].T, p["wo"][None]])
        held = np.empty((3 * HIDDEN, most), np.float32), np.empty((WINDOW, two, most), np.float32), np.empty((WINDOW, ATTENTION + 1, most), np.float32)
        for k in range(0, len(scores), SLID_AT_ONCE):
            n = min(most, len(scores) - k)
            a, states, pooled = held if n == most else [np.empty((*x.shape[:-1], n), np.float32) for x in held]
            zr, z, r, c = a[:two], a[:HIDDEN], a[HIDDEN:two], a[two:]
            for part, order in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
                w, b = weights[part]
                g = np.ascontiguousarray(gates[part].take(words[k : k + n + WINDOW - 1], axis=0).T)
                g[:two] *= half
                g[:two] += b[:two]
                h = np.zeros((HIDDEN, n), np.float32)
                for t in order:
                    # a sigmoid is half of one more than the tanh of half its input
                    np.matmul(w, h, out=a)
                    zr += g[:two, t : t + n]
                    np.tanh(zr, out=zr)
                    zr += 1
                    c += b[two:]
                    c *= r
                    c += g[two:, t : t + n]
                    np.tanh(c, out=c)
                    z *= half
                    new = np.subtract(h, c, out=states[t, part * HIDDEN : (part + 1) * HIDDEN])
                    new *= z
                    new += c
                    h = new
            np.matmul(out, states, out=pooled)
            inner = pooled[:, :-1]
            inner += p["ba"][:, None]
            e = p["ua"] @ np.tanh(inner, out=inner)
            e = np.exp(e - e.max(axis=0))
            scores[k : k + n] = _sigmoid((e * pooled[:, -1]).sum(axis=0) / e.sum(axis=0) + p["bo"])
        return scores

    def gradients(self, x: np.ndarray, windows: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss, for the weights and for the input vectors."""
        p, (n, steps) = self.p, windows.shape
        score, (states, inner, weight, pooled, trace) = self.forward(self.projected(x), windows, lengths, keep=True)
        out = {k: np.zeros_like(v) for k, v in p.items() if k not in ("words", "chars")}
        dy = ((score - target) / n).astype(np.float32)
        out["wo"], out["bo"] = pooled.T @ dy, dy.sum(keepdims=True)
        dpooled = dy[:, None] * p["wo"]
        dstates = weight[:, :, None] * dpooled
        dweight = (states * dpooled).sum(axis=2)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        out["ua"] = np.einsum("tn,tna->a", de, inner)
        dinner = de[:, :, None] * p["ua"] * (1 - inner**2)
        out["Wa"], out["ba"] = np.einsum("tnh,tna->ha", states, dinner), dinner.sum(axis=(0, 1))
        dstates += dinner @ p["Wa"].T
        places, parts = [], []
        for d, part in (("f", 0), ("b", 1)):
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, c, an in reversed(trace[d]):
                dh = dh + dstates[t, :, part * HIDDEN : (part + 1) * HIDDEN]
                alive = (t < lengths)[:, None]
                dnew = np.where(alive, dh, 0)
                dc = dnew * (1 - z) * (1 - c**2)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * an * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], axis=1)
                dg = np.concatenate([dz, dr, dc], axis=1)
                out[f"Wh{d}"] += h.T @ da
                out[f"bh{d}"] += da.sum(axis=0)
                xt = x[windows[:, t]]
                out[f"Wx{d}"] += xt.T @ dg
                out[f"bx{d}"] += dg.sum(axis=0)
                places.append(windows[:, t])
                parts.append(dg @ p[f"Wx{d}"].T)
                dh = np.where(alive, 0, dh) + dnew * z + da @ p[f"Wh{d}"].T
        return out, summed_rows(np.concatenate(places), np.concatenate(parts), len(x)).astype(x.dtype)


class Corpus:
    """Training documents as windows of numbered words."""

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {}
        self.features: list[tuple[int, np.ndarray]] = []
        windows, lengths, owner = [], [], []
        for i, text in enumerate(texts):
            ids = []
            for word in words_of(text):
                if word not in self.number:
                    self.number[word] = len(self.features)
                    self.features.append(features(word))
                ids.append(self.number[word])
            for start in window_starts(len(ids), TRAIN_STRIDE):
                part = ids[start : start + WINDOW]
                windows.append(part + [0] * (WINDOW - len(part)))
                lengths.append(len(part))
                owner.append(i)
        self.windows, self.lengths, self.owner = np.array(windows, np.int32).reshape(-1, WINDOW), np.array(lengths, np.int32), np.array(owner, np.int32)

    def rows(self) -> list[np.ndarray]:
        """The distinct word rows of each document."""
        row = np.array([w for w, _ in self.features])
        return [np.unique(row[mine]) for mine in np.split(self.windows, np.flatnonzero(np.diff(self.owner)) + 1)]

    def best(self, values: np.ndarray, each: int) -> np.ndarray:
        """The ``each`` windows of every document with the highest values."""
        order = np.lexsort((-values, self.owner))
        rank = np.arange(len(order)) - np.searchsorted(self.owner[order], self.owner[order])
        return order[rank < each]


def odds_of_rows(found: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Logarithm of how many times as often a word's row occurs in toxic documents; 0 for rows never seen."""
    seen = np.zeros((2, WORD_ROWS))
    for mine, kind in zip(found, toxic.astype(int), strict=True):
        seen[kind, mine] += 1
    rate = (seen + 5) / (np.array([(~toxic).sum(), toxic.sum()]) + 10)[:, None]
    unseen = np.log(toxic.sum() + 10) - np.log((~toxic).sum() + 10)
    return np.clip(np.log(rate[1] / rate[0]) + unseen, -3, 3).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, share: float | None = None, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """The network for texts of which ``share`` are toxic, learned from a sample in which another share may be."""
    net, corpus, rng = Network(seed), Corpus(texts), np.random.default_rng(seed)
    toxic = labels.astype(bool)
    # how much more often a word's row occurs in toxic documents, as the first value of its vector
    odds = odds_of_rows(corpus.rows(), toxic)
    net.p["words"][:, 0] += odds
    value = odds[[w for w, _ in corpus.features]][corpus.windows].max(axis=1)

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            gates = net.projected(net.inputs(corpus.features))
            value = np.concatenate([net.forward(gates, corpus.windows[k : k + SCORED_AT_ONCE], corpus.lengths[k : k + SCORED_AT_ONCE]) for k in range(0, len(corpus.windows), SCORED_AT_ONCE)])
        best = corpus.best(value, 1)
        best = best[toxic[corpus.owner[best]]]
        clean = np.concatenate([corpus.best(value, 2), corpus.best(rng.random(len(value)), 2)])
        clean = clean[~toxic[corpus.owner[clean]]]
        # toxic windows come as often as every fourth
        best = np.resize(best, max(len(best), len(clean) // 3))
        chosen = rng.permutation(np.concatenate([best, clean]))
        for k in range(0, len(chosen), BATCH):
            at = chosen[k : k + BATCH]
            distinct, index = np.unique(corpus.windows[at], return_inverse=True)
            found = [corpus.features[i] for i in distinct]
            grads, dx = net.gradients(net.inputs(found), index.reshape(-1, WINDOW), corpus.lengths[at], toxic[corpus.owner[at]].astype(np.float32))
            sizes = np.array([len(c) for _, c in found])
            shares = np.repeat(dx / sizes[:, None], sizes, axis=0).astype(np.float32)
            grads["words"] = summed_rows(np.array([w for w, _ in found]), dx, WORD_ROWS)
            grads["chars"] = summed_rows(np.concatenate([c for _, c in found]), shares, CHAR_ROWS)
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if share:
        odds_of = lambda q: np.log(q / (1 - q))
        net.p["bo"] = (net.p["bo"] + odds_of(min(share, 0.999)) - odds_of(0.25)).astype(np.float32)
    return net


class Scorer:
    """Scores of texts, with the gates' inputs of words met before."""

    def __init__(self, net: Network):
        self.net = net
        self.number: dict[str, int] = {}
        self.gates = (np.zeros((0, 3 * HIDDEN), np.float32),) * 2

    def _numbers(self, lists: list[list[str]]) -> None:
        if len(self.number) > CACHE_WORDS:
            self.number, self.gates = {}, (self.gates[0][:0], self.gates[1][:0])
        new = list(set().union(*lists).difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            more = self.net.projected(self.net.summed(*features_of(new)))
            self.gates = tuple(np.concatenate(pair) for pair in zip(self.gates, more, strict=True))

    def __call__(self, texts: list[str]) -> np.ndarray:
        lists = [words_of(t) for t in texts]
        self._numbers(lists)
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int32)
        sizes = np.array([len(words) for words in lists], np.int64)
        begins = np.cumsum(sizes) - sizes
        gates = self.gates if len(self.gates[0]) else (np.zeros((1, 3 * HIDDEN), np.float32),) * 2
        scores = np.zeros(len(texts))
        short = np.flatnonzero(sizes < WINDOW)
        # places behind the end of a short text read some word, which the length leaves out
        places = np.minimum(begins[short, None] + np.arange(WINDOW), max(len(flat) - 1, 0))
        windows = flat[places] if len(flat) else np.zeros_like(places)
        for k in range(0, len(short), SCORED_AT_ONCE):
            part = slice(k, k + SCORED_AT_ONCE)
            scores[short[part]] = self.net.forward(gates, windows[part], sizes[short[part]])
        long = np.flatnonzero(sizes >= WINDOW)
        if len(long):
            # the long texts one behind the other; windows across two of them are left out
            words = flat[np.repeat(sizes >= WINDOW, sizes)]
            first = np.cumsum(sizes[long]) - sizes[long]
            bounds = np.stack([first, first + sizes[long] - WINDOW + 1], axis=1).ravel()
            scores[long] = np.maximum.reduceat(np.append(self.net.slid(gates, words), 0), bounds)[::2]
        return scores


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[tuple[int, str, int]], float]:
    """Bounded rows doc_id, text, toxic, none of them held out, in order of id; the share of toxic among all labels."""
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(crc_of_id(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 20))
    share = {kind: (kind == 0) * per_class + per_class for kind in (0, 1)}
    chosen = F.lit(False)
    for kind, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == kind) & (place < min(1.0, share[kind] / n) * (1 << 20)))
    sample = F.broadcast(marks.where(chosen))  # about three times per_class rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.char_length("text") <= TRAIN_CHARS)
    rows = texts.join(sample, "doc_id").select("doc_id", "text", "toxic").collect()
    return sorted({(r["doc_id"], r["text"], r["toxic"]) for r in rows}), sizes.get(1, 0) / max(1, sum(sizes.values()))


def scored(docs: DataFrame, net: Network | None, otherwise: float = 0.0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value) if model.value is not None else None
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                score = scorer(piece.column("text").to_pylist()) if scorer else np.full(piece.num_rows, otherwise)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    held_out = F.coalesce(crc_of_id(F.col("doc_id").cast("long")) % 5 == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, share = training_rows(docs, labels)
    marks = np.array([toxic for *_, toxic in rows])
    if len(set(marks.tolist())) < 2:
        return scored(docs, None, share)
    return scored(docs, train([text for _, text, _ in rows], marks, share))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
