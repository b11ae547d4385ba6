"""Token counts and the alignment of two tokenizers, against the libraries and a plain version of the definition."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import ODD

from learnlens.llm import token_alignment, token_counts
from learnlens.llm.blocks import BLOCK_ROWS

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = ["<s>x</s><unk> <|endoftext|>", "a\0b c", "  two  spaces ", "▁mark▁ ▁", "½²٣😀👍🏽 ﬁ", "tab\tand\nline\r\n", "\u0085　x", "日本語" * 40, " ", "é"]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_tokens():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer


def some_texts():
    rng = random.Random(4)
    return ["".join(rng.choice("ab 'stlé漢ñ.,!1 \n\t½😀▁the") for _ in range(rng.randint(1, 300))) for _ in range(60)]


# --- counts ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("long_text", [8, 1 << 16])
def test_counts_equal_the_library(make, pieces, long_text):
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate([*STRANGE, *some_texts()])], (900, "word " * 30000), (901, "x" * 70000), (902, "\n" * 70000)]
    found = token_counts.token_counts(make(rows, clashing=True), PIECES, 50, long_text, 5 if long_text == 8 else 1 << 14).collect()
    want = Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 50) for i, t in rows)
    assert Counter(tuple(r) for r in found) == want


def test_pieces_are_short_and_add_up(pieces):
    counter = token_counts.counter(PIECES)
    text = " ".join(some_texts()).replace("▁", "")
    parts = [*counter.pieces(text, 20)]
    assert len(parts) > len(text) / 60
    assert sum(len(pieces.encode(p)) - extra for p, extra in parts) == len(pieces.encode(text))
    assert [*counter.pieces("ab" * 50, 20)] == [("ab" * 50, 0)]  # every pair of letters is in the vocabulary


def test_counts_by_a_json_file(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    rows = [(k, t) for k, t in enumerate(["", *STRANGE])]
    found = token_counts.token_counts(make(rows), BYTES, long_text=8).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_counts_of_nothing(none):
    assert token_counts.token_counts(none, PIECES).collect() == []


# --- alignment -------------------------------------------------------------------------------------


def aligned_plainly(rows, byte_tokens, pieces):
    """The definition, token by token."""
    alphabet = token_alignment.byte_alphabet()
    entry = {i: t for t, i in byte_tokens.get_vocab().items()}
    documents, held = [], defaultdict(set)
    for number, (doc_id, text) in enumerate(rows):
        text = text or ""
        a = byte_tokens.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text)
        spelled_a = [bytes(alphabet[c] for c in entry[i]) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(pieces.id_to_piece, b))]
        if not text or b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            a, b, spelled_a, spelled_b = [], [], [], []
        ends_a, ends_b = np.cumsum([*map(len, spelled_a)]).tolist(), np.cumsum([*map(len, spelled_b)]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            inside = [[i for i, e in zip(ids, ends) if low < e <= cut] for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(",".join(map(str, ids)) for ids in inside))
            low = cut
        links = []
        for k, i in enumerate(a):
            for m, j in enumerate(b):
                if max(ends_a[k] - len(spelled_a[k]), ends_b[m] - len(spelled_b[m])) < min(ends_a[k], ends_b[m]):
                    links.append((i, j))
        for pair in links:
            held[pair].add(number)
        documents.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (i, _), where in held.items():
        most[i] = max(most[i], len(where))
    rows = Counter(
        (doc_id, n_a, n_b, n_groups, len(links), sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), digest)
        for doc_id, n_a, n_b, n_groups, links, digest in documents
    )
    return rows, {pair: len(where) for pair, where in held.items()}, Counter(p for d in documents for p in d[4])


def test_alignment_equals_the_definition(make, byte_tokens, pieces, prose):
    rows = [r for r in ODD if r[0] not in (6, 7)]
    rows += [(100 + k, t) for k, t in enumerate([*STRANGE, *some_texts(), *[prose(60) for _ in range(20)]])] + [(500, "the the the the the " * 20)] * 2
    docs = make(rows, clashing=True)
    want, n_docs, n_links = aligned_plainly(rows, byte_tokens, pieces)
    assert Counter(tuple(r) for r in token_alignment.aligned(docs, BYTES, PIECES).collect()) == want
    index = token_alignment.postings(docs, BYTES, PIECES)
    counted = {(r["a"], r["b"]): (r["n_docs"], r["links"]) for r in token_alignment.pairs(index).collect()}
    assert counted == {pair: (n_docs[pair], n_links[pair]) for pair in n_docs}
    assert index.where("plane >= 4").count() > 0  # a pair more than 15 times in one document


def test_alignment_over_blocks(spark, byte_tokens, pieces, tmp_path):
    words = "the of and zebra naïve 日本 1234".split()
    rows = [(k, " ".join(words[(k * j) % 7] for j in range(1, 4))) for k in range(BLOCK_ROWS + 900)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    want, _, _ = aligned_plainly(rows, byte_tokens, pieces)
    found = token_alignment.aligned(spark.read.parquet(path), BYTES, PIECES)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(BLOCK_ROWS, n, replace=False)) for n in (1, 2, 255, 256, 257, BLOCK_ROWS, 3)]
    packed = token_alignment.pack(np.concatenate(sets), np.array([len(s) for s in sets]))
    at = np.frombuffer(packed.buffers()[1], np.int32).astype(np.int64)[: len(sets) + 1]
    rows, of = token_alignment.unpack(np.frombuffer(packed.buffers()[2], np.uint8), at[:-1], np.diff(at))
    assert max(map(len, packed.to_pylist())) == BLOCK_ROWS // 8
    for k, s in enumerate(sets):
        assert np.array_equal(np.sort(rows[of == k]), s)


def test_alignment_of_nothing(none):
    assert token_alignment.aligned(none, BYTES, PIECES).collect() == []


def test_alignment_of_rows_that_are_no_files(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in token_alignment.aligned(docs, BYTES, PIECES).collect()}
    assert found[1]["n_links"] == found[1]["count_sum"] == 2 and found[2]["groups_sha256"] == ""
