"""Operators that judge each row alone: language, quality, pieces, token counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import langid, pieces, quality, tokencount
from offerlens.llm.common import held_out, table
from offerlens.llm.queries import load

ODD = ["", None, " ", "\n", "a", "  a  b ", "▁x▁ y", "日本語🤖 tätä\x00", "x" * 9000, "ab " * 4000 + "  ", "1234 -- !!", "a\n\nb\tc"]


def odd_rows():
    return [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "repeated"), (3, "repeated")]


# ------------------------------------------------------------------ language


def test_suffix_automaton_accepts_exactly_the_substrings(rng):
    for _ in range(30):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        go = langid.suffix_automaton(data)
        for _ in range(40):
            probe = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 6)))
            node = 0
            for c in probe:
                node = go[node].get(c) if node is not None else None
            assert (node is not None) == (probe in data)


def test_phrase_counts_equal_a_greedy_parse(rng):
    samples = (b"the cat sat on the mat ", b"der hund und die katze ")
    texts = ["".join(rng.choice("theca dunkz\n,é") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    got, lengths = langid.phrase_counts(texts, samples, block=16)
    data, sizes = langid.normalised(texts)
    assert lengths.tolist() == sizes.tolist()
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        raw = data[end - size : end].tobytes()
        for k, sample in enumerate(samples):
            n = 0
            for at in range(0, len(raw), 16):
                block = raw[at : at + 16]
                while block:
                    size_ = max((j for j in range(1, len(block) + 1) if block[:j] in sample), default=1)
                    block, n = block[size_:], n + 1
            assert got[i, k] == n


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = load()["op3_language_id"][0](spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    rows = got.join(docs, "doc_id").filter("held_out AND chars >= 50").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows) > 100


def test_language_of_odd_rows(spark, documents):
    docs = documents(odd_rows())
    model = langid.fit(documents([(1, "the cat and the dog"), (2, "some more of it")]), F.col("doc_id"))
    rows = langid.predict(docs, model, [F.col("doc_id")]).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] != 3}
    assert [by[k]["lang_pred"] for k in (0, 1, 2, 10)] == ["und"] * 4 and by[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.fit(docs.limit(0), F.col("doc_id"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, [F.col("doc_id")]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, [F.col("doc_id")]).count() == 0


def test_foreign_text_is_rejected(spark, documents):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(langid.learnable(docs), F.col("doc_id"))
    rnd = random.Random(1)
    noise = " ".join("".join(rnd.choice("qwxzkjvbpyfg") for _ in range(7)) for _ in range(60))
    some = documents([(1, noise), (2, None), (3, "123 !!"), (4, "The and of thing.")])
    assert {r["doc_id"] for r in langid.predict(some, model, [F.col("doc_id")]).filter(~langid.rejected()).collect()} == {4}
    kept = langid.predict(docs, model, [F.col("doc_id")]).filter(~langid.rejected()).count()
    assert kept == docs.count()


# ------------------------------------------------------------------ quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    model = quality.fit(docs, table(spark, sf, "labels"), ~held_out(F.col("doc_id"), 3, 1), sample_rows=1500)
    got = quality.score(docs.filter(held_out(F.col("doc_id"), 3, 1)), model, [F.col("doc_id")])
    rows = got.join(table(spark, sf, "labels"), "doc_id").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) >= 0.97 * len(right) > 500
    p = np.array([r["score"] if r["quality"] else 1 - r["score"] for r in rows])
    assert -np.log(np.maximum(p, 1e-9)).mean() < 0.1  # the probabilities are honest


def test_quality_of_odd_rows(spark, documents):
    train = [(k, f"good words of text number {k} and so on") for k in range(30)] + [(100 + k, f"BUY NOW!! $$$ CHEAP {k} !!!") for k in range(30)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in train] + [(7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(documents(train), labels, F.lit(True))
    rows = quality.score(documents(odd_rows()), model, [F.col("doc_id")]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    blank = quality.fit(documents(train).limit(0), labels, F.lit(True))
    assert {r["score"] for r in quality.score(documents(odd_rows()), blank, [F.col("doc_id")]).collect()} == {0.5}
    assert quality.score(documents(train).limit(0), model, [F.col("doc_id")]).count() == 0


# ------------------------------------------------------------------ pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_pieces(pieces.MODEL)


@pytest.fixture(scope="module")
def lattice(vocabulary):
    return pieces.Lattice(vocabulary, pieces.TEMPERATURE)


def test_pieces_round_trip_and_repeat(spark, documents, vocabulary):
    docs = documents(odd_rows())
    a = pieces.encoded(docs, vocabulary, [F.col("doc_id"), F.col("text")]).collect()
    b = pieces.encoded(docs.repartition(5), vocabulary, [F.col("doc_id"), F.col("text")]).collect()
    assert all(r["lossless"] for r in a) and len(a) == docs.count()
    assert sorted(map(repr, a)) == sorted(map(repr, b))  # neither batch nor partition changes a draw
    assert [r["ids"] for r in a if r["text"] is None] == [None] and [r["n_pieces"] for r in a if r["text"] == ""] == [0]
    assert pieces.encoded(docs.limit(0), vocabulary, [F.col("doc_id")]).count() == 0


def test_side_by_side_equals_one_at_a_time(lattice, monkeypatch, rng):
    texts = ["".join(rng.choice("thean dor é\n日") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    keys = np.arange(40)
    a = lattice.encode(texts, keys)
    monkeypatch.setattr(pieces, "LATTICE", 7)
    b = lattice.encode(texts, keys)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    c = lattice.encode(texts, keys)
    assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(a, b, c))
    assert [lattice.decode(x) for x in a] == texts


def test_draws_follow_the_lattice(lattice):
    word = "there"
    weights: dict[tuple, float] = {}

    def walk(at, path, w):
        if at == len(word) + 1:
            weights[path] = w
            return
        for size in range(1, lattice.longest + 1):
            i = lattice.ids.get((" " + word)[at : at + size])
            if i is not None and at + size <= len(word) + 1:
                walk(at + size, (*path, i), w * np.exp(lattice.weight[i]))

    walk(0, (), 1.0)
    total, n = sum(weights.values()), 20_000
    got: dict[tuple, int] = {}
    for ids in lattice.encode([word] * n, np.arange(n)):
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
    for path, w in weights.items():
        p = w / total
        assert abs(got.get(path, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


# ------------------------------------------------------------------ token counts


def brute_count(text, vocabulary):
    s, i, n = " " + text, 0, 0
    longest = max(map(len, vocabulary), default=0)
    while i < len(s):
        size = next((k for k in range(min(longest, len(s) - i), 0, -1) if s[i : i + k] in vocabulary), 0)
        n += 1 if size else len(s[i].encode())
        i += size or 1
    return n


def test_token_counts_equal_brute_force(rng):
    for _ in range(400):
        vocab = {"".join(rng.choice("ab " if k == 0 else "abc") for k in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        vocab = tokencount.usable(tuple(vocab))
        count = tokencount.Counter(vocab).__getitem__
        text = "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 14)))
        assert sum(map(count, tokencount.words(text))) == brute_count(text, set(vocab))


def test_token_counts_of_tables(spark, documents, vocabulary):
    vocab = tokencount.usable(vocabulary.texts)
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(40).select("doc_id", "text").union(documents(odd_rows()).select("doc_id", "text"))
    rows = tokencount.token_counts(docs, vocab, [F.col("text")]).collect()
    assert len(rows) == docs.count()
    assert all(r["n_tokens"] == (brute_count(r["text"], set(vocab)) if r["text"] else 0) for r in rows)
    assert tokencount.token_counts(docs.limit(0), vocab, [F.col("doc_id")]).count() == 0
