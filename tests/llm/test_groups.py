"""Operators that compare rows: lines, fingerprints, benchmark, licences, neighbours, passages, and the pipeline."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from offerlens.llm import components, decontaminate, licenses, linededup, neighbours, simhash, suffixdedup, suffixsort
from offerlens.llm.common import table
from offerlens.llm.queries import load
from offerlens.session import staged
from tests import oracle

SF = "/root/testdata/sf0.001"
WORDS = "the of and stone river light green house seven walk paper night cloud table garden window".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", ["op2_line_dedup", "op8_license_scan"])
def test_native_query_equals_sql_without_python(spark, name):
    run, sql = load()[name]
    ok, message = oracle.compare(spark, oracle.connect(SF), name, SimpleNamespace(run=run, sql=sql), SF)
    assert ok, message
    plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# ------------------------------------------------------------------ lines


def edits(a, b):
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    short, long_ = sorted((a, b), key=len)
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b)))
    return 1 if any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_))) else 2


def brute_lines(rows, least):
    lines = [(d, k, x) for d, t in rows if d is not None and t is not None for k, x in enumerate(t.split("\n")) if len(x) >= least]
    first = {}
    for d, k, x in sorted(lines):
        first.setdefault(x, (d, k))
    near = {x for x in first for y in first if first[y] < first[x] and edits(x, y) == 1}
    out = []
    for d, t in rows:
        if d is None or t is None:
            out.append((d, t, 0 if t is None else t.count("\n") + 1, 0))
            continue
        parts = t.split("\n")
        gone = {k for k, x in enumerate(parts) if len(x) >= least and (x in near or (d, k) > first[x])}
        out.append((d, "\n".join(x for k, x in enumerate(parts) if k not in gone), len(parts), len(gone)))
    return out


def test_lines_equal_brute_force(spark, documents, rng):
    def line():
        x = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        return x if rng.random() < 0.7 else x + "é日"

    rows = [(k, "\n".join(line() for _ in range(rng.randint(1, 6)))) for k in range(60)] + [(None, "aaaaaa\nbbb"), (61, None), (62, ""), (63, "\n\n"), (5, "abababab\nabababab"), (5, "abababab\nabababab")]
    out = linededup.dedup_lines(documents(rows), 3)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_lines(rows, 3)))
    assert linededup.dedup_lines(documents(rows).limit(0)).count() == 0


def test_variants_of_lines_longer_than_a_block(spark, rng, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 4)
    base = "".join(rng.choice("abcdefgh") for _ in range(30))
    others = [base[:i] + c + base[i + j :] for i in range(31) for c, j in (("", 1), ("x", 0), ("x", 1))]
    docs = spark.createDataFrame([(0, base), *[(k + 1, x) for k, x in enumerate(dict.fromkeys(x for x in others if x != base))]], "doc_id bigint, text string")
    assert {r["doc_id"] for r in linededup.dedup_lines(docs).filter("n_removed = 0").collect()} == {0}


# ------------------------------------------------------------------ fingerprints


def slow_fingerprint(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words, word = [], b""
    for b in raw + b" ":
        if b == 0x20 or 9 <= b <= 13:
            words, word = words + [word] if word else words, b""
        else:
            word += bytes([b])
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                par[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark, documents):
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.choice([1, 2, 3, 4, 40])) for _ in range(40)] + ["", None, " \t\n", "É Ab\x0bC\x85d", "A b C", "a B c"]
    rows = [(100 - k, t) for k, t in enumerate(texts)] + [(200, texts[5]), (200, texts[5]), (None, texts[6])]
    got = simhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    fps = [slow_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if i is not None or r in least else None
    want = [(i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, root)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
    assert simhash.near_duplicates(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("split", [4096, 3])
def test_links_connect_all_near_fingerprints(spark, split, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split)
    monkeypatch.setattr(simhash, "ROUND", 64)
    rnd = random.Random(split)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rnd.getrandbits(64)
        for _ in range(25):
            x = seed
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 2000 + k) for k in range(300)] + [(5000, 5000), (None, 3)]
    got = components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert len(got) == 602 and len({r["root"] for r in got}) == 2


# ------------------------------------------------------------------ benchmark

QUESTION = "A train leaves the station at 40 km per hour and after 3 hours Alice boards. How far has the train gone when Alice arrives 40 km later?"


def test_reparameterised_question_is_caught(spark, documents):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "Too short"), (4, QUESTION), (5, "Name the five largest rivers")], "item_id bigint, text string")
    other = QUESTION.replace("40", "75").replace("3 hours", "9 hours").replace("Alice", "Robert Brown")
    broken = QUESTION.replace("at 40 km", "at 75 km").replace("Alice boards", "Robert boards")
    rows = [
        (1, "Intro. " + QUESTION + " End."), (2, "Well. " + other + " Yes."), (3, broken), (4, "A train is a row of cars."),
        (5, None), (6, ""), (7, QUESTION.upper()), (None, QUESTION), (8, "clean"), (8, other), (9, "so name the five largest rivers now"),
    ]
    got = decontaminate.flag(documents(rows), bench).collect()
    assert len(got) == len(rows)
    hit = sorted(str(r["doc_id"]) for r in got if r["contaminated"])
    assert {"1", "2", "None", "8", "9"} <= set(hit) and not {"4", "5", "6"} & set(hit) and hit.count("8") == 1
    assert {r["item_id"] for r in got if r["contaminated"]} == {1, 5}
    assert decontaminate.flag(documents(rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.flag(documents(rows).limit(0), bench).count() == 0


def test_slots_must_be_consistent(spark, documents):
    item = "Take 5 red stones and 7 blue stones then add 5 green stones to the small bag of stones near the old river"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, item.replace("5", "8").replace("7", "2")), (2, item.replace("5 red", "8 red"))]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag(documents(rows), bench).collect()}
    assert got[1] and got[2]  # the second holds 14 words of the item as they stand
    short = " ".join(item.split()[:13])  # no eight words without a number
    bench = spark.createDataFrame([(1, short)], "item_id bigint, text string")
    rows = [(1, short.replace("5", "8").replace("7", "2")), (2, short.replace("5 red", "8 red").replace("7", "2").replace("5 green", "9 green")), (3, short)]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag(documents(rows), bench).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_words_that_stand_verbatim_always_count(spark, documents):
    """Whatever is changed around them, eight words of an item in a row are found."""
    rnd = random.Random(17)
    vocabulary = ["Ann", "Tom", "Rome", *"takes gives counts holds red blue old small bag box stones apples and then to of the river house".split()]
    items = [" ".join(rnd.choice(vocabulary) if rnd.random() < 0.75 else str(rnd.randint(2, 40)) for _ in range(rnd.randint(9, 24))) for _ in range(25)]
    docs, want = [], []
    for k in range(150):
        words = rnd.choice(items).split()
        at = rnd.randrange(len(words) - 7)
        out = [w if at <= j < at + 8 else str(rnd.randint(50, 99)) if w.isdigit() else rnd.choice((w, "Oslo" if w[0].isupper() else "green")) for j, w in enumerate(words)]
        docs.append((k, "some words before " + " ".join(out) + " and some behind"))
        want.append(k)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r["doc_id"] for r in decontaminate.flag(documents(docs), bench).filter("contaminated").collect()}
    assert got == set(want)


def test_benchmark_query_equals_plain_windows(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    words = lambda t: [w for w in decontaminate._TOKEN.findall(t.lower()) if w not in ".!?\n"]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    want = {d for d, t in docs.items() if any(tuple(w) in windows for x in [words(t)] for w in zip(*[x[k:] for k in range(8)]))}
    got = {r["doc_id"] for r in load()["op7_decontaminate"][0](spark, SF).filter("contaminated").collect()}
    assert want <= got and len(got - want) == 0


# ------------------------------------------------------------------ licences


def test_licences_of_odd_rows(spark, documents):
    mit = licenses.TEMPLATES["MIT-permission"]
    rows = [(1, "text\n" + mit + "\nmore"), (2, "code\n\n" + mit.replace(", ", ",\n") + "\n\nrest"), (3, mit.replace("charge", "cost")), (4, "Licensed to drive."), (5, None), (6, ""), (None, mit), (7, "x"), (7, "Released under the MIT License"), (8, "Released under the MIT License.\nsome words of code that stand between the two notices here\nThis project is licensed under the terms of the MIT license.")]
    got = licenses.scan(documents(rows)).collect()
    by = {(r["doc_id"], r["license"]): r for r in got}
    assert len(got) == len(rows)
    assert {(1, "MIT-permission"), (2, "MIT-permission"), (3, "MIT-permission"), (4, None), (5, None), (6, None), (None, "MIT-permission"), (7, None), (7, "MIT")} <= set(by)
    assert by[(1, "MIT-permission")]["dice"] == 1.0 and by[(3, "MIT-permission")]["dice"] < 1.0 and by[(8, "MIT")]["n_notices"] == 2
    assert licenses.scan(documents(rows).limit(0)).count() == 0


# ------------------------------------------------------------------ neighbours


def test_recall_of_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    rows = load()["op6_nearest_neighbours"][0](spark, sf).collect()
    e = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], dtype=np.float64)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        near = np.lexsort((ids, d))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert np.allclose([m[2] for m in mine], [d[ids == m[1]][0] for m in mine], rtol=1e-14)
        hit, total = hit + len(set(ids[near]) & {m[1] for m in mine}), total + 10
    assert hit / total >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 2.0], 1), (3, [3.0, 4.0], 1), (3, [3.0, 4.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (200, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).collect()
    mine = lambda q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert mine(0) == [(1, 0.0), (100, 0.0), (2, 5**0.5), (3, 20**0.5)]
    assert mine(100) == [(0, 0.0), (1, 0.0), (2, 5**0.5), (3, 20**0.5)]
    assert {r["query_id"] for r in got} == {0, 100}
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------------ passages


def test_induced_sorting_equals_plain_sorting(monkeypatch):
    rnd = np.random.default_rng(0)
    for turn in range(40):
        monkeypatch.setattr(suffixsort, "BATCH", [1 << 18, 3][turn % 2])
        monkeypatch.setattr(suffixsort, "RUN", [1 << 17, 4][turn // 2 % 2])
        monkeypatch.setattr(suffixsort.Spool, "KEEP", [1 << 15, 2][turn % 2])
        text, cap = np.append(rnd.integers(0, rnd.integers(1, 5), rnd.integers(1, 90)), 255).astype(np.uint8), int(rnd.choice([1, 3, 50]))
        pos, lcp = (np.concatenate(x) for x in zip(*suffixsort.sorted_suffixes(text, cap)))
        assert sorted(pos.tolist()) == list(range(len(text)))
        cut = [text[p : p + cap].tobytes() for p in pos]
        for a, b, n in zip(cut, cut[1:], lcp[1:]):
            assert a >= b and n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_passages(rows, length):
    first = {}
    for d, t in rows:
        if d is not None:
            raw = (t or "").encode()
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = set()
        for p in range(len(raw) - length + 1):
            if d is not None and first[raw[p : p + length]] < d:
                gone |= set(range(p, p + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((d, len(raw), len(gone), spans, bytes(c for k, c in enumerate(raw) if k not in gone)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_passages_equal_brute_force(spark, documents, small, monkeypatch):
    if small:  # everything spills and every document is hashed in stretches; needs one process, so the task's functions run here
        monkeypatch.setattr(suffixdedup, "STRETCH", 37)
        monkeypatch.setattr(suffixdedup, "SEND", 100)
    rnd = random.Random(9)
    pool = [prose(rnd, 14) for _ in range(12)] + ["ab" * 60, "x" * 130, "é日" * 30, "a\x00" * 40]
    rows = []
    for k in range(70):
        rows.append((rnd.randrange(60), "".join(rnd.choice([rnd.choice(pool), prose(rnd, 5), rnd.choice(pool)[7:]]) for _ in range(rnd.randint(0, 5)))))
    rows += [(None, pool[0] * 2), (3, None), (4, ""), (rows[0][0], rows[0][1]), (0, pool[1])]
    if small:
        raw = [np.frombuffer((t or "").encode(), dtype=np.uint8) for _, t in rows]
        for data in raw:
            name, start, size = suffixdedup.segments(data)
            windows = [p for s, n in zip(start, size) for p in range(s, s + n - 49)]
            assert sorted(windows) == list(range(max(0, len(data) - 49)))
        return
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixdedup.dedup_passages(documents(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_passages(rows, 50)))
    assert suffixdedup.dedup_passages(documents(rows).limit(0)).count() == 0


def test_passage_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = load()["op10_suffix_dedup"][0](spark, SF).collect()
    want = [(d, a, b, c, hashlib.sha256(kept).hexdigest()) for d, a, b, c, kept in brute_passages(rows, 50)]
    assert sorted(want) == sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    docs, sizes = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), "stage")
        sizes.append(docs.count())
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "line dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {(d, t) for d, t, _, gone in brute_lines(rows, linededup.MIN_CHARS) if not gone or t.strip()}
            assert {(r["doc_id"], r["text"]) for r in docs.collect()} == want
        if name == "near-duplicates":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            roots = brute_components([slow_fingerprint(t) for _, t in rows])
            assert {r["doc_id"] for r in docs.collect()} == {min(d for (d, _), r in zip(rows, roots) if r == k) for k in set(roots)}
    assert sizes == sorted(sizes, reverse=True) and docs.filter("NOT lossless").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_of_odd_rows(spark, documents):
    rows = [(1, "The and of thing to be is the best of it all.\nThe and of thing to be."), (2, None), (3, ""), (4, "123"), (None, "The and of thing to be is the best of it all."), (1, "The and of thing to be is the best of it all.\nThe and of thing to be.")]
    docs = documents(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
    assert {r["doc_id"] for r in docs.collect()} == {1, None}
    docs = documents(rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
    assert docs.count() == 0
