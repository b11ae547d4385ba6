"""Language, tokens, quality, toxicity, decontamination and the pipeline, by round trips, held-out accuracy and brute force."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from llm_rows import ODD, rows_by_id

import corpus_pipeline
from learnlens.llm import base, byte_bpe, decontaminate, language_id, quality_kn, token_planes, toxicity

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- byte-pair encoding ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(byte_bpe.ranks_of(RANKS)), special_tokens={})


STRANGE = ["'s don't WE'LL  x y\x85z", "\r\n \n\n  a", "½²٣৪Ⅷ", "áë", "​zero‍", "😀👍🏽🇫🇷", "x" * 300, "<|endoftext|>", "ǅǈ ﬁ ß", "\x1c\x1d a\x1fb", "0x1F 1,234.5e-6", "ab\u0870cd \U0001e4f2\U0001e4f3x \U0002ebf1 \ua7d3's \U00016a71 1\U0001ccf5"]


def test_encoding_equals_the_reference_library(make, reference):
    rng = random.Random(9)
    mixed = ["".join(rng.choice("ab 'stlé漢ñ.,!1 \n\t½😀") for _ in range(60)) for _ in range(40)]
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate([*STRANGE, *mixed])]]
    found = byte_bpe.round_trip(make(rows, clashing=True), RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in found) == want


def test_encoding_takes_rows_that_are_no_files(spark, reference):
    docs = spark.createDataFrame([(1, "some text of this and that"), (2, None)], "doc_id long, text string")
    found = rows_by_id(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert np.frombuffer(found[1]["ids"], "<u4").tolist() == reference.encode_ordinary("some text of this and that")
    assert found[2]["ids"] == b""


def test_encoding_of_nothing(none):
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_plans_do_not_spell_out_the_ranks(make):
    words = byte_bpe._blocks(make([(1, "some text"), (2, None)]), public_tokenizers.PATTERN)
    found = byte_bpe.folded(words, RANKS)
    plans = found._jdf.queryExecution()
    assert all(len(plan.toString()) < 100_000 for plan in (plans.optimizedPlan(), plans.executedPlan()))
    # the ranks stand within the fold, and are not copied into every row
    assert " AS held#" not in plans.optimizedPlan().toString()
    assert {r["word"] for r in found.collect()} == {"some", " text"}


def test_vocabularies_with_words_no_merge_leads_to():
    ranks = [*((bytes([b]), b) for b in range(256)), (b"ab", 256), (b"xyz", 257)]
    held = byte_bpe.rank_map(ranks)
    assert held["whole"] == {"78797A": 257}
    with pytest.raises(ValueError):
        byte_bpe.rank_map(ranks[1:])


# --- token planes ----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(i or None, rng.integers(0, 1 << int(rng.integers(1, 33)), int(rng.integers(0, 300)), dtype=np.uint64).astype("<u4")) for i in range(40)]
    out = io.BytesIO()
    writer = token_planes.Writer(out, 64, kind)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = token_planes.Reader(pa.BufferReader(out.getvalue()))
    assert [(i, ids.tolist()) for i, _, ids in reader.documents()] == [(i, ids.tolist()) for i, ids in docs]
    flat = np.concatenate([ids for _, ids in docs])
    for a, b in ((0, 0), (0, 1), (63, 65), (64, 128), (100, len(flat)), (0, len(flat))):
        assert reader.ids(a, b).tolist() == flat[a:b].tolist()
    with pytest.raises(ValueError):
        token_planes.Reader(pa.BufferReader(out.getvalue()[:-1]))


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files_equal_the_library(spark, make, tmp_path, kind):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(STRANGE)]]
    folder = str(tmp_path)
    files = token_planes.write(make(rows, clashing=True), WORDS, folder, kind, 128)
    found = token_planes.read(spark, folder, files).collect()
    want, at = Counter(), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in found) == want


def test_texts_learn_their_new_units_together(monkeypatch):
    """A call to the tokenizer for each text with a new unit took half of the time."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    texts = [*STRANGE, "it's 'tis I'm don''t 'll'l they're 12.5% a'b", "\u00c0\u00c9 stra\u00dfe'm na\u00efve", "\u65e5\u672c I'm", "", "'", "<|endoftext|> x", *[f"word{k} qz{k}x, It's" for k in range(50)]]
    learned, encode = [], token_planes.Encoder(WORDS)
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda new, plain: (learned.append(plain), learn(new, plain)))
    for _ in range(2):
        assert [ids.tolist() for ids in encode(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert sorted(learned) == [False, True]
    monkeypatch.setattr(token_planes, "CACHE_UNITS", 1)
    assert [ids.tolist() for ids in encode(texts)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_token_files_of_nothing(spark, none, tmp_path):
    assert token_planes.write(none, WORDS, str(tmp_path)) == []
    assert token_planes.read(spark, str(tmp_path), []).collect() == []


# --- language --------------------------------------------------------------------------------------


def test_held_out_languages_are_told(spark):
    docs = base.documents(spark, "/root/testdata/sf0.01")
    found = language_id.predict(docs, *language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) > 100
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_rows(odd):
    found = language_id.predict(odd, *language_id.learn(odd)).collect()
    assert len(found) == len(ODD)
    by_id = rows_by_id(found)
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert by_id[8]["lang_pred"] == by_id[10]["lang_pred"] == "en" and by_id[None]["held_out"]
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in ODD if i not in (1, 2, 3, 9))


def test_language_of_nothing(none):
    langs, matrix = language_id.learn(none)
    assert langs == [] and language_id.predict(none, langs, matrix).collect() == []


@pytest.mark.parametrize(
    "uri, known",
    [
        ("file:/a/b", "file:///a/b"),
        ("file:///a/b", "file:///a/b"),
        ("/a/b", "/a/b"),
        ("s3a://bucket/a", "s3://bucket/a"),
        ("s3n://bucket/a", "s3://bucket/a"),
        ("abfss://c@account.dfs.core.windows.net/a", "abfss://c@account.dfs.core.windows.net/a"),
        ("hdfs://name:8020/a", "hdfs://name:8020/a"),
    ],
)
def test_folders_by_their_names(uri, known):
    assert token_planes.arrow_uri(uri) == known


def plain_ngrams(text):
    """Buckets of the n-grams of one text, character by character."""
    low = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    found = []
    for order in language_id.ORDERS:
        for at in range(len(low) - order + 1):
            if low[at] == 32 and (at + 1 == len(low) or low[at + 1] == 32):
                continue
            mixed = sum(p * (m + 2 * order) for p, m in zip(low[at : at + order], language_id.MULTIPLIERS, strict=False)) % 2**32
            found.append((mixed ^ (mixed >> 15)) * language_id.MULTIPLIERS[3] % 2**32 >> 16)
    return found


def test_language_by_the_sums_of_naive_bayes(spark, prose):
    """Learning and scores against plain sums over a small frame; neighbours in a batch change nothing."""
    tails = {"en": " the end. ", "de": " das Ende", "fr": ", la fin!  "}
    rows = [(i, prose(6 + i % 5, seed=i) + tails[lang] * (1 + i % 3), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(90, "", "en"), (91, None, "de"), (92, "12 34.", "fr"), (93, "fin", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    langs = sorted(counts)
    weight = {}
    for lang in langs:
        whole = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
        weight[lang] = lambda b, n=counts[lang], whole=whole: math.log((n[b] + language_id.SMOOTHING) / whole)
    found = {r["doc_id"]: r for r in language_id.predict(docs, *language_id.learn(docs)).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        grams = plain_ngrams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        evidence = [sum(map(weight[lang], grams)) * min(len(grams), language_id.EVIDENCE) / len(grams) for lang in langs]
        odds = [math.exp(e - max(evidence)) for e in evidence]
        best = max(range(len(langs)), key=lambda k: odds[k])
        assert found[i]["lang_pred"] == langs[best], i
        assert found[i]["score"] == pytest.approx(odds[best] / sum(odds), abs=1e-9), i


def test_no_ngram_reaches_across_texts():
    one = language_id.hashed_ngrams(pa.array(["ab", "", "cd"]))[0]
    other = [language_id.hashed_ngrams(pa.array([t]))[0] for t in ("ab", "cd")]
    for k in range(3):
        assert one[k].tolist() == [*other[0][k].tolist(), *other[1][k].tolist()]


# --- quality ---------------------------------------------------------------------------------------


def kneser_ney(texts, order=quality_kn.ORDER):
    """The model by its definition, on n-grams as tuples."""
    grams = {order: Counter()}
    for t in texts:
        padded = "\2" * (order - 1) + t
        grams[order].update(tuple(padded[k : k + order]) for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    size = len(grams[1]) + 1
    cuts = {k: quality_kn.discounts(*[sum(n == c for n in grams[k].values()) for c in (1, 2, 3, 4)]) for k in grams}

    def probability(gram):
        k = len(gram)
        lower = probability(gram[1:]) if k > 1 else 1 / size
        after = {g: n for g, n in grams[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return lower
        cut = lambda n: cuts[k][min(n, 3) - 1]
        n = grams[k][gram]
        return (max(n - cut(n), 0) if n else 0) / sum(after.values()) + sum(cut(c) for c in after.values()) / sum(after.values()) * lower

    return probability


def test_perplexity_by_definition(spark, make, prose):
    rows = [(i, prose(12, i)) for i in range(12)] + [(20, "###$$$ %%% ta ko"), (21, ""), (22, None), (None, prose(5, 3)), (23, "日本 ta ko"), (24, "ta 😀𝒳 ko"), (25, "ta 😀"), (5000, "mi 𝒴😁 ko")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(20, 0, 0), (None, 1, 0), (25, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_kn.judged(make(rows, clashing=True), labels).collect()
    assert len(found) == len(rows)
    by_id = rows_by_id(found)
    counted = lambda i: i is not None and (i < 8 or i == 25) and zlib.crc32(str(i).encode()) % quality_kn.HELD_OUT
    units = lambda t: "".join(chr(int.from_bytes(t.encode("utf-16-le")[k : k + 2], "little")) for k in range(0, len(t.encode("utf-16-le")), 2))
    probability = kneser_ney([units(t) for i, t in rows if counted(i)])
    for i, t in rows:
        if t:
            t = units(t)
            padded = "\2\2\2" + t
            want = math.exp(-sum(math.log(probability(tuple(padded[k : k + 4]))) for k in range(len(t))) / len(t))
            assert by_id[i]["perplexity"] == pytest.approx(want, rel=1e-9)
        else:
            assert by_id[i]["perplexity"] is None and not by_id[i]["kept"]
    assert not by_id[20]["kept"] and all(by_id[i]["kept"] for i in range(7))


def test_thresholds_are_those_of_trusted_texts_held_out(spark, make, prose):
    rows = [(i, prose(30, i)) for i in range(400)] + [(1000, "zz##qq")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = rows_by_id(quality_kn.judged(make(rows), labels, 0.5).collect())
    held = sorted(found[i]["perplexity"] for i in range(400) if zlib.crc32(str(i).encode()) % quality_kn.HELD_OUT == 0)
    assert len(held) >= quality_kn.LEAST and {r["threshold"] for r in found.values()} == {held[-(-len(held) // 2) - 1]}
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in found.values()) and not found[1000]["kept"]


def test_quality_without_trusted_text(spark, make, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] == bool((t or "").strip()) for t, r in zip(["one text", " "], quality_kn.judged(make([(1, "one text"), (2, " ")]), labels).orderBy("doc_id").collect(), strict=True))
    assert quality_kn.judged(none, labels).collect() == []


# --- toxicity --------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, windows = rng.standard_normal((9, toxicity.INPUT)), rng.integers(0, 9, (5, 6))
    lengths, target = np.array([6, 6, 3, 1, 0]), np.array([1, 0, 1, 0, 1.0])

    def loss():
        score = net.forward(net.projected(x), windows, lengths)
        return -np.mean(target * np.log(score) + (1 - target) * np.log(1 - score))

    grads, dx = net.gradients(x, windows, lengths, target)
    for values, grad in [*((net.p[k], grads[k]) for k in grads), (x, dx)]:
        at = tuple(rng.integers(0, n) for n in values.shape)
        held = values[at]
        values[at] = held + 1e-4
        up = loss()
        values[at] = held - 1e-4
        down = loss()
        values[at] = held
        assert (up - down) / 2e-4 == pytest.approx(grad[at], rel=1e-3, abs=1e-5)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = list(toxicity.window_starts(n))
        assert set(range(n)) <= {k for s in starts for k in range(s, s + toxicity.WINDOW)}
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_a_score_is_that_of_the_worst_of_all_windows(prose):
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k] * 3 + np.float32(0.1)
    texts = [prose(n) for n in (0, 1, 31, 32, 33, 5, 56, 57, 700, 32)]
    found = toxicity.Scorer(net)(texts)
    for text, score in zip(texts, found, strict=True):
        words = toxicity.words_of(text)
        parts = [words[k : k + toxicity.WINDOW] for k in range(max(1, len(words) - toxicity.WINDOW + 1))]
        ids = np.array([[*range(k, k + len(part)), *[0] * (toxicity.WINDOW - len(part))] for k, part in enumerate(parts)])
        gates = net.projected(net.inputs([toxicity.features(w) for w in words])) if words else (np.zeros((1, 3 * toxicity.HIDDEN), np.float32),) * 2
        assert score == pytest.approx(net.forward(gates, ids, np.array([len(part) for part in parts])).max(), abs=1e-5)
    assert len(set(found.round(4))) > 5
    for n in (32, 57, 90):
        starts = set(toxicity.window_starts(n))
        assert all(any(s <= k and k + m <= s + toxicity.WINDOW for s in starts) for m in range(1, 33) for k in range(n - m + 1))


def test_features_of_many_words_are_those_of_each():
    words = ["a", "ab", "abc", "hello", "stra\u00dfe", "\u65e5\u672c\u8a9e", "x" * toxicity.LONG_WORD, ""]
    rows, sizes, grams = toxicity.features_of(words)
    for word, row, mine in zip(words, rows, np.split(grams, np.cumsum(sizes)[:-1]), strict=True):
        one_row, one_grams = toxicity.features(word)
        assert row == one_row and mine.tolist() == one_grams.tolist()


def test_new_words_are_not_looked_up_one_by_one(prose, monkeypatch):
    net, texts = toxicity.Network(3), [prose(n) for n in (0, 1, 40, 90)]
    words = sorted({w for text in texts for w in toxicity.words_of(text)})
    each = dict(zip(words, np.concatenate(net.projected(net.inputs([toxicity.features(w) for w in words])), axis=1), strict=True))
    monkeypatch.setattr(toxicity, "features", None)
    scorer = toxicity.Scorer(net)
    scorer(texts[:2])
    scorer(texts)
    gates = np.concatenate(scorer.gates, axis=1)
    assert set(scorer.number) == set(words) and all((gates[k] == each[w]).all() for w, k in scorer.number.items())


def test_every_letter_of_a_long_run_counts():
    long = "".join(chr(0x4E00 + k) for k in range(500))
    for n in (62, 63, 64, 65, 72, 124, 125, 500):
        run, words = long[:n], toxicity.words_of(f"a {long[:n]} b")
        assert words[0] == "a" and words[-1] == "b" and max(map(len, words)) <= 64
        assert all(any(run[k : k + 5] in w for w in words) for k in range(n - 4)) and all(w in run for w in words[1:-1])
        assert len(words) == 3 or n > 64
    gram_rows = lambda text: {int(c) for w in toxicity.words_of(text) for c in toxicity.features(w)[1]}
    assert gram_rows(long[:72] + "scumbag") != gram_rows(long[:72] + "friend")


def test_toxic_documents_are_told(spark, make, prose, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 4)
    rng, rows, marks = random.Random(0), [], []
    for i in range(500):
        words, toxic = prose(rng.randint(5, 120)).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["scumbag", "idiotic", "moronic"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    rows += [(1000, None), (None, "you scumbag"), (1001, "")]
    labels = spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.judged(make(rows, clashing=True), labels).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 500 and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum((r["doc_id"] % 4 == 0) == (r["predicted"] == 1) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.judged(odd, labels).collect()} == {0.0}
    assert toxicity.judged(none, labels).collect() == []


# --- decontamination -------------------------------------------------------------------------------

QUESTION = "Now Tom has 12 apples and gives 5 apples to Mary, then Tom walks 3 km home with Mary."


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_with_other_values_are_found(spark, make, prose):
    rows = [
        (1, f"{prose(40)} {QUESTION} {prose(30)}"),
        (2, "Well, so Bob has 7 apples and gives 1,200.5 apples to Sue, then Bob walks 9 miles home with Sue. Good."),
        (3, "Well, so Bob has 7 apples and gives 2 apples to Sue, then Ann walks 9 miles home with Kim. Good."),
        (4, QUESTION.lower()),
        (5, prose(300)),
        (6, None),
        (None, QUESTION),
        (7, QUESTION),
        (7, prose(20)),
        (8, "Tom has 12 apples and that is all of it."),
        (9, ""),
    ]
    found = decontaminate.judged(make(rows, clashing=True), items(spark, QUESTION, None, "", "too few words", prose(25, 77))).collect()
    kept = defaultdict(list)
    for r in found:
        assert r["kept"] == (r["item_ids"] == []) and r["n_items"] == len(r["item_ids"])
        kept[r["doc_id"]].append(r["kept"])
    assert {i: sorted(k) for i, k in kept.items()} == {1: [False], 2: [False], 3: [True], 4: [True], 5: [True], 6: [True], None: [False], 7: [False, True], 8: [True], 9: [True]}
    clean = decontaminate.clean(make(rows, clashing=True), items(spark, QUESTION))
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_exact_leaks_as_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    found = rows_by_id(decontaminate.op3_decontamination(spark, sf).collect())
    texts = base.documents(spark, sf).select("doc_id", "text").collect()
    benchmark = base.table(spark, sf, "benchmark").collect()
    leaked = {(d["doc_id"], b["item_id"]) for d in texts for b in benchmark if b["text"] in (d["text"] or "")}
    assert leaked and all(item in found[doc]["item_ids"] for doc, item in leaked)


def test_items_without_template_windows_leak_by_their_tokens(spark, make, prose):
    short = ["Compute 12 + 7 * 5 - 8 / 4 = ?", "Blue whales", "小明有十二个苹果他又买了五个", "日本語 7 個"]
    rows = [(k, f"{prose(30)} {t} {prose(30)}") for k, t in enumerate(short)]
    rows += [(10, "Compute 12 + 7 * 5 - 9 / 4 = ?"), (11, "Whales are blue"), (12, f"前の{short[2]}後の"), (13, "小明有三个梨他又卖了"), (14, "12 7 5 8 4")]
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.judged(make(rows), items(spark, *short)).collect()}
    assert found == {0: [0], 1: [1], 2: [2], 3: [3], 10: [], 11: [], 12: [2], 13: [], 14: []}


def test_long_runs_of_long_items_leak(spark, make, prose):
    words = prose(55, 8).split()
    names = "Then {} met {} and {} saw {} and {} told {} of it while {} and {} sat there"
    torn, other = names.format(*["Tom", "Ann"] * 4), names.format("Bob", "Kim", "Kim", "Bob", "Lea", "Sue", "Sue", "Bob")
    rows = [(n, " ".join([prose(20, 40 + n), *words[10 : 10 + n], prose(20, 80 + n)])) for n in (9, 12, 13, 29)]
    # two pieces of nine words with another word between them are no run
    rows += [(1, " ".join([*words[:9], "other", *words[10:19]])), (2, f"{other} {prose(20, 9)}"), (3, f"{other} {prose(25)}")]
    found = {r["doc_id"]: r["kept"] for r in decontaminate.judged(make(rows), items(spark, " ".join(words), f"{torn} {prose(20, 9)}")).collect()}
    assert found == {9: True, 12: True, 13: False, 29: False, 1: True, 2: False, 3: True}


def test_names_that_begin_sentences_are_names(spark, make, prose):
    said = "{} has {} apples. {} gives {} {} apples. {} walks {} km. How many apples has {}?"
    rows = [
        (1, f"{prose(30)}. {said.format('Bob', 7, 'Kim', 'Bob', 4, 'Ann', 9, 'Bob')} {prose(30)}"),
        (2, said.format("Tom", 12, "Mary", "Tom", 5, "Sue", 3, "Tom")),
        (5, prose(200)),
        (6, "There Bob has 7 red apples and sees Kim, Kim has 9 red apples and sees Bob."),
    ]
    other = "Tom has 12 red apples and sees Ann. Ann has 5 red apples and sees Tom."
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.judged(make(rows), items(spark, said.format("Tom", 12, "Mary", "Tom", 5, "Sue", 3, "Tom"), other)).collect()}
    assert found == {1: [0], 2: [0], 5: [], 6: [1]}


def test_an_empty_benchmark_leaves_all(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r["kept"] for r in decontaminate.judged(odd, empty).collect())
    assert decontaminate.judged(none, items(spark, QUESTION)).collect() == []


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_of_a_whole_table(spark):
    out = corpus_pipeline.run(spark, SMALL)
    docs = {r["doc_id"] for r in base.documents(spark, SMALL).collect()}
    found = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(found) == len({r["doc_id"] for r in found}) and {r["doc_id"] for r in found} < docs
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns_of_odd_and_empty_documents(spark, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns
            docs.collect()


def test_counts_and_bitmaps_come_to_the_driver_as_columns(make, prose, spark, monkeypatch):
    docs = make([(i, prose(60, seed=i)) for i in range(40)])
    items = spark.createDataFrame([(i, prose(40, seed=100 + i)) for i in range(20)], "item_id long, text string")
    windows = decontaminate.benchmark_windows(items)
    kind, found = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: found.append(collect(self)) or found[-1])
    langs, matrix = language_id.learn(docs)
    words = decontaminate.window_filter(windows)
    assert langs == ["en"] and np.isfinite(matrix).all() and words.any()
    assert max(map(len, found), default=0) <= 1  # a row a language; n-grams and words of the bitmap are many more
