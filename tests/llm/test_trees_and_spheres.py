"""Merkle manifest, byte-pair encoding and centroid clustering against brute force."""

import hashlib
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from offerlens.llm import bytepairs, centroids, merkle, suffixdedup
from offerlens.llm.queries import load
from tests import oracle

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a table where a query looks for it."""

    def write(rows, name):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_merkle_manifest"])
def test_query_equals_sql(spark, name):
    run, sql = load()[name]
    ok, message = oracle.compare(spark, oracle.connect(SF), name, SimpleNamespace(run=run, sql=sql), SF)
    assert ok, message


# ------------------------------------------------------------------ manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(hashes, fanout=16):
    """(root, path of (before, after) by leaf)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k : k + fanout] for k in range(0, len(hashes), fanout)]
        for leaf, place in enumerate(at):
            run, slot = runs[place // fanout], place % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        hashes, at = [sha("".join(r)) for r in runs], [p // fanout for p in at]
    return hashes[0], paths


def slow_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    trees, out = {}, []
    for source, docs in by_source.items():
        docs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, slow_leaf(r, r["text"])))
        trees[source] = slow_tree([slow_leaf(r, r["text"]) for r in docs])
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = slow_tree([trees[s][0] for s in order])
    for s, top in zip(order, tops):
        for r, path in zip(by_source[s], trees[s][1]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c in merkle.UPPER else c for c in text)
            node = slow_leaf(r, text)
            for before, after in path + top:
                node = sha(before + node + after)
            proof = sha("".join(b + a for b, a in path + top))
            out.append((r["doc_id"], slow_leaf(r, r["text"]), trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows(spark, folder, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{DOCUMENTS}, leaf string, place bigint, total int")
    got = load()["op12_merkle_manifest"][0](spark, folder(docs, "documents"))
    assert got.columns == COLUMNS
    return sorted([tuple(r) for r in got.collect()], key=repr)


def test_manifest_equals_brute_force(spark, folder):
    rnd = random.Random(4)
    texts = ["Some Text", "", None, "lower only", "ÄÖ Über", "x" * 1_000_000 + "Y"]
    sizes = {None: 17, "": 1, "b": 300, "B": 16, "é": 2, "z": 33}
    rows = [(rnd.randrange(400), rnd.choice(texts[:5]), rnd.choice(["en", None]), s, rnd.choice([7, None])) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, "No id", None, "b", 1), (None, "No id", None, "b", 1), (5, "Twice", "en", "z", 5), (5, "Twice", "en", "z", 5), (6, texts[5], "en", "z", 9)]
    rows += [(k, f"Alone {k}", "en", f"s{k}", 1) for k in range(20)]
    want = slow_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert manifest_rows(spark, folder, rows) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17])
def test_manifest_of_one_source(spark, folder, count):
    rows = [(k, f"T{k}", "en", "s", 2) for k in range(count)]
    assert manifest_rows(spark, folder, rows) == (slow_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]) if rows else [])


def test_manifest_of_other_fanout_and_key(spark):
    rows = [(f"g{k % 3}", f"{k:03}", sha(str(k)), k) for k in range(50)]
    got = merkle.manifest(spark.createDataFrame(rows, "grp string, key string, leaf string, kept int"), 3)
    got = got.withColumn("folded", merkle.fold(F.col("path"), F.col("leaf"))).collect()
    assert len(got) == 50 and all(r["folded"] == r["root"] for r in got)
    trees = {g: slow_tree([leaf for x, _, leaf, _ in rows if x == g], 3)[0] for g in ("g0", "g1", "g2")}
    assert {r["root"] for r in got} == {slow_tree(list(trees.values()), 3)[0]}


# ------------------------------------------------------------------ byte pairs


@pytest.fixture(scope="module")
def vocabulary():
    return bytepairs.Vocabulary(bytepairs.read_ranks())


@pytest.fixture(scope="module")
def library():
    ranks = {t: k for k, t in enumerate(bytepairs.read_ranks()) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(vocabulary, text):
    return np.frombuffer(vocabulary.encode(text), dtype="<u4").tolist()


def test_tokens_equal_the_library(vocabulary, library):
    rnd = random.Random(8)
    letters = "aaabcdeé日本語 ñ1 \n\t'sst!?— 한국어абв՘֋\U0001f600\x1c\x85　"
    for k in range(4000):
        text = "".join(rnd.choice(letters[: rnd.randint(2, len(letters))]) for _ in range(rnd.choice((1, 3, 10, 40, 200))))
        got = ids(vocabulary, text)
        assert got == library.encode_ordinary(text)
        assert vocabulary.decode(np.array(got)) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "abc", "=", "ha", "日本", "xyzzy"])
def test_long_runs_equal_the_library(vocabulary, library, unit):
    text = unit * (30_001 // len(unit)) + "q"
    assert ids(vocabulary, text) == library.encode_ordinary(text)


def test_joins_of_any_cut_equal_the_whole(vocabulary):
    rnd = random.Random(9)
    for _ in range(1500):
        data = bytes(rnd.choice(b"abcdehinorst") for _ in range(rnd.randint(2, 70)))
        cut = rnd.randrange(1, len(data))
        assert vocabulary.join(vocabulary.merged(data[:cut]), vocabulary.merged(data[cut:])) == vocabulary.merged(data)
        assert vocabulary.window(data) == vocabulary.tree(data) == vocabulary.merged(data)


def test_every_code_point_splits_as_in_the_library():
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    split = bytepairs.Splitter(public_tokenizers.PATTERN)
    for lead in "a1\n":
        ranks = {bytes([k]): k for k in range(256)} | {(lead + c).encode(): 256 + k for k, c in enumerate(points)}
        whole = tiktoken.Encoding("split", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in points if (len(whole.encode_ordinary(lead + c)) == 1) != (len([m for b in split(lead + c) for m in b]) == 1)] == []


def test_byte_pair_query(spark, folder, library):
    texts = ["Hello world's end", "", None, "naïve  日本語\n\n x", "word " * 200_000, "Hello world's end"]
    rows = [(k if k < 5 else None, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], f"{DOCUMENTS}, ids string, n_tokens int")
    got = load()["op13_byte_pairs"][0](spark, folder(docs, "documents"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for k, t, *_ in rows:
        tokens = library.encode_ordinary(t or "")
        want.append((k, len(tokens), hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_byte_pairs_of_no_rows_and_clashing_names(spark):
    tokens = bytepairs.read_ranks()
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bytepairs.decode(bytepairs.encode(empty, tokens, [F.col("doc_id")]), tokens, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        bytepairs.encode(empty.withColumn("ids", F.lit(1)), tokens, [F.col("ids")])
    rows = spark.createDataFrame([(1, [0, 5]), (2, None)], "doc_id bigint, ids array<int>")
    assert [bytes(r["coded"]["decoded"]) for r in bytepairs.decode(rows, tokens, ["doc_id"]).orderBy("doc_id").collect()] == [tokens[0] + tokens[5], b""]


# ------------------------------------------------------------------ clusters


def slow_clusters(points, seeds, rounds):
    """[(cluster, squared distance)], centroids."""
    centres = [list(c) for c in seeds]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(x)[0] for x in points]
        for c in range(len(centres)):
            mine = [x for x, o in zip(points, own) if o == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [nearest(x) for x in points], centres


def clumps(rnd, n, dim, spread):
    heads = [[rnd.randint(-500, 500) for _ in range(dim)] for _ in range(6)]
    return [[c + rnd.randint(-spread, spread) for c in rnd.choice(heads)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0, 3, 200])
def test_clusters_equal_brute_force(spark, spread):
    rnd = random.Random(spread)
    points = clumps(rnd, 400, 3, spread)
    seeds = points[:5]
    got, centres = centroids.cluster(spark.createDataFrame(list(enumerate(points)), "vec_id bigint, vec array<int>"), seeds, 6)
    want, slow = slow_clusters(points, seeds, 6)
    assert centres.tolist() == slow
    assert [(r["cluster"], r["distance"]) for r in got.orderBy("vec_id").collect()] == want


def test_bounds_hold_and_leave_vectors_unscanned():
    rnd = random.Random(2)
    points = np.array(clumps(rnd, 3000, 8, 60))
    centres = points[:6].copy()
    move = centroids.Move(centres, np.zeros(6), np.zeros(6), first=True)
    own, upper, lower = np.full(len(points), -1), np.zeros(len(points)), np.zeros(len(points))
    scanned, tighter = [], 0
    for _ in range(8):
        own, upper, lower, n = centroids.settle(points, own, upper, lower, move)
        scanned.append(n)
        d = np.sqrt(centroids.scan(points, move.centroids).astype(float))
        assert (own == d.argmin(axis=1)).all()
        assert (d[np.arange(len(points)), own] <= upper).all()
        d[np.arange(len(points)), own] = math.inf
        assert (d.min(axis=1) >= lower).all()
        new = np.array([points[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else move.centroids[c] for c in range(6)])
        radius = np.array([upper[own == c].max(initial=0) for c in range(6)])
        drift = np.linalg.norm((new - move.centroids).astype(float), axis=1)
        move = centroids.moved(move.centroids, new, radius)
        tighter += int((move.loosening < [max(np.delete(drift, c)) - 1e-3 for c in range(6)]).sum())
    assert scanned[0] == len(points) and scanned[-1] < len(points) // 2
    assert tighter > 6


def test_loosening_bounds_all_vectors_of_the_sphere():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        old, new = rnd.integers(-40, 40, (3, 2)), rnd.integers(-40, 40, (3, 2))
        radius = rnd.uniform(0, 30, 3)
        bound = centroids.loosening(old, new, radius)
        for own in range(3):
            angle, size = rnd.uniform(0, 2 * math.pi, 500), np.sqrt(rnd.uniform(0, 1, 500)) * radius[own]
            x = old[own] + np.stack([np.cos(angle) * size, np.sin(angle) * size], axis=1)
            for other in range(3):
                if other != own:
                    loss = np.linalg.norm(x - old[other], axis=1) - np.linalg.norm(x - new[other], axis=1)
                    assert loss.max() <= bound[own]


def test_cluster_query_on_odd_rows(spark, folder):
    rnd = random.Random(6)
    rows = [(k % 30, [rnd.uniform(-1, 1) for _ in range(64)], 1) for k in range(40)]
    rows += [rows[0], rows[0], (None, [0.5] * 64, 1), (50, [0.0] * 64, 1)]
    odd = [(60, None, 1), (61, [], 1), (62, [1.0] * 63, 1), (63, [None] + [1.0] * 63, 1), (64, [math.nan] + [1.0] * 63, 1), (65, [math.inf] + [1.0] * 63, 1)]
    table = spark.createDataFrame([(*r, 5, "c") for r in rows + odd], "vec_id bigint, embedding array<float>, label int, row int, cluster string")
    got = load()["op11_centroid_clusters"][0](spark, folder(table, "embeddings"))
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    key = lambda p: (p[0] is None, sha(f"3:{p[0]}"), p[1])
    want, centres = slow_clusters([v for _, v in ints], [v for _, v in sorted(ints, key=key)[:8]], 10)
    total = {c: sum(d for o, d in want if o == c) for c in range(8)}
    digest = [sha(",".join(map(str, c))) for c in centres]
    wanted = [(i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (c, d) in zip(ints, want)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("count", [0, 3])
def test_fewer_vectors_than_clusters(spark, folder, count):
    table = spark.createDataFrame([(k, [float(k)] * 64) for k in range(count)], "vec_id bigint, embedding array<double>")
    got = load()["op11_centroid_clusters"][0](spark, folder(table, "embeddings")).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(count)) and {r["distance"] for r in got} <= {0}


def test_too_large_components_are_an_error(spark):
    vectors = spark.createDataFrame([(1, [2e5] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.integers(vectors).collect()


# ------------------------------------------------------------------ passages


def test_documents_hashed_together_have_the_segments_of_each_alone(monkeypatch):
    rnd = random.Random(21)
    for _ in range(150):
        monkeypatch.setattr(suffixdedup, "TOGETHER", rnd.choice((100, 1000, 1 << 15)))
        values = [None if rnd.random() < 0.1 else bytes(rnd.choice(b"ab") for _ in range(rnd.choice((0, 3, 49, 50, 51, 99, 300, 900)))) for _ in range(rnd.randint(1, 40))]
        for got, value in zip(list(suffixdedup.segments_of(values)), values, strict=True):
            for a, b in zip(got, suffixdedup.segments(suffixdedup._bytes(value))):
                assert np.array_equal(a, b)


def test_a_piece_in_many_surroundings_has_many_names():
    rnd = np.random.default_rng(5)
    tries = rnd.integers(97, 123, (4000, 24)).astype(np.uint8)  # longer than a piece, shorter than what a name stands for
    piece = min(tries, key=lambda x: int(suffixdedup._hashes(x).min()))
    count = {}
    for _ in range(300):
        text = np.concatenate([rnd.integers(97, 123, 60), piece, rnd.integers(97, 123, 60)]).astype(np.uint8)
        for name in suffixdedup.segments(text)[0].tolist():
            count[name] = count.get(name, 0) + 1
    assert max(count.values()) == 1  # 300 where the piece alone is the name
    period = np.tile(np.frombuffer(b"abcdefg", np.uint8), 5000)
    assert len(suffixdedup.segments(period)[0]) == 1


def test_windows_of_equal_bytes_have_equal_names():
    rnd = random.Random(22)
    for _ in range(60):
        pool = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 90))) for _ in range(4)]
        name_of = {}
        for _ in range(8):
            value = b"".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))
            for name, start, size in zip(*(x.tolist() for x in suffixdedup.segments(suffixdedup._bytes(value)))):
                for p in range(start, start + size - 49):
                    assert name_of.setdefault(value[p : p + 50], name) == name


def test_each_partition_of_segments_gets_one_part(spark, documents):
    plan = suffixdedup.dedup_passages(documents([(1, "a" * 60)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "direct_shuffle_partition_id(part" in plan  # a hash of the part gives some partitions several parts and others none


def test_shards_sorted_as_one_answer_like_each_alone(monkeypatch):
    rnd = random.Random(23)
    pool = ["".join(rnd.choices("abcd ", k=70)).encode() for _ in range(6)]
    values = [b"".join(rnd.choice(pool)[rnd.randint(0, 20) :] for _ in range(6)) for _ in range(30)]
    names = sorted({int(x) for v in values for x in suffixdedup._short(suffixdedup.segments(suffixdedup._bytes(v))[0]).view(np.int32)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([1] * 30), pa.array(values), pa.array([names] * 30, pa.list_(pa.int32()))], names=["doc_id", "row", "data", "wanted"])
    answers = []
    for join in (0, 2000, 4 << 20):
        monkeypatch.setattr(suffixdedup, "JOIN", join)
        monkeypatch.setattr(suffixdedup, "SEND", 1 if join else 16 << 20)
        packs = pa.Table.from_batches(suffixdedup._send(iter([batch]), 3)).sort_by("part").to_batches()
        answers.append(sorted(tuple(r.values()) for out in suffixdedup._solve(iter(packs)) for r in out.to_pylist()))
    assert answers[0] and answers[0] == answers[1] == answers[2]
