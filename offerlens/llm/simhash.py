"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most two of 64 bits agree on at least two of four 16-bit blocks, so each distinct
fingerprint goes to six groups, one for every pair of blocks. A group is sorted by Gray rank, which puts fingerprints
of few differing bits side by side; every eight neighbours share a node that holds the bits they have in common, and so
on up to a root. A search adds up the differences from the root down, counting each bit where a node first fixes it, and
leaves a whole subtree as soon as they exceed the limit. A group passes on a star of links for each of its clusters,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, map_texts, op, table
from offerlens.llm.components import components
from offerlens.session import staged

WORDS, SEED, LIMIT = 3, 42, 2
FAN = 8
#: Groups of more fingerprints are split by a pair of the other bytes as well; 48 common bits bound a group by 65 536.
SPLIT_ABOVE = 4096
#: Leaves that one round of searches may visit at most.
ROUND = 1 << 21
_CHUNK = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of one UTF-8 text, unsigned; 0 if it has no word."""
    words = text.translate(_LOWER).split() if text else []  # splits at blanks and \\x09-\\x0d, as the words are defined
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(WORDS, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())]
        bits += np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` with ``fp``, the fingerprint of the whole ``text`` as a signed long."""
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def derive(texts: list) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())}

    return map_texts(rows, derive, columns_of(rows, "_text", "fp bigint"), "_text", binary=True)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _search(fps: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the same group at most ``limit`` bits apart; groups lie one after another in Gray order."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(np.full(len(fps), ones), fps, np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), np.int64))]
    low, high, last, count = fps, fps, np.arange(len(fps)), sizes
    while count.max() > 1:
        up = -(-count // FAN)
        group = np.repeat(np.arange(len(up)), up)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(up) - up, up)
        first = (np.cumsum(count) - count)[group] + nth * FAN
        width = np.minimum(FAN, count[group] - nth * FAN)
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        last, count = last[first + width - 1], up
        shared = ~(low ^ high)
        levels.append((shared, low & shared, last, first, width))
    root_of = np.repeat(np.arange(len(sizes)), sizes)
    work = np.cumsum(np.repeat(sizes, sizes))
    begin = 0
    while begin < len(fps):
        end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + ROUND, side="right")))
        query = np.arange(begin, end)
        node, begin = root_of[begin:end], end
        parent = np.zeros(len(query), dtype=np.uint64)
        seen = np.zeros(len(query), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            shared, value, last, first, width = levels[k]
            seen = seen + np.bitwise_count((fps[query] ^ value[node]) & shared[node] & ~parent)
            stay = (seen <= limit) & (last[node] > query)
            query, node, seen = query[stay], node[stay], seen[stay]
            if k:
                n = width[node]
                parent = np.repeat(shared[node], n)
                child = np.repeat(first[node], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                query, node, seen = np.repeat(query, n), child, np.repeat(seen, n)
        if len(query):
            yield query, node


def _clusters(fps: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """The first position of each position's cluster within its group."""
    label = np.arange(len(fps))
    for a, b in _search(fps, sizes, limit):
        while len(a):
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not np.array_equal(up := label[label], label):
                label = up
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    return label


def near_links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) that connect all fingerprints ``fp`` of ``fps`` (distinct) that differ in at most two bits."""
    if not 0 <= limit <= 2:
        raise ValueError("the block pairs find at most two differing bits")
    block = [F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), (F.shiftleft(block[a], 16) + block[b]).alias("bits")) for i, (a, b) in enumerate(_PAIRS)]))
    rows = fps.select("fp", keyed.alias("k")).select("k.way", "k.bits", "fp")
    sizes = rows.groupBy("way", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["way", "bits"])
    rest = [F.element_at(F.array(*[block[next(x for x in range(4) if x not in p and (x > min(set(range(4)) - set(p))) == bool(h))] for p in _PAIRS]), F.col("way") + 1) for h in (0, 1)]
    byte = [F.shiftrightunsigned(rest[k // 2], 8 * (k % 2)).bitwiseAND(0xFF) for k in range(4)]
    finer = F.array(*[F.struct(F.lit(i + 1).alias("way2"), (byte[a] * 256 + byte[b]).alias("bits2")) for i, (a, b) in enumerate(_PAIRS)])
    whole = F.array(F.struct(F.lit(0).alias("way2"), F.lit(0).cast("bigint").alias("bits2")))
    rows = rows.select("way", "bits", "fp", F.explode(F.when(F.col("n") > SPLIT_ABOVE, finer).otherwise(whole)).alias("f"))
    rows = rows.select("way", "bits", "f.way2", "f.bits2", gray_rank(F.col("fp")).alias("rank"), "fp")
    group = ["way", "bits", "way2", "bits2"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            key = np.stack(cols[:4])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate(([0], cut, [key.shape[1]]))
            root = _clusters(cols[4].view(np.uint64), np.diff(bounds), limit)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(cols[4][at]), pa.array(cols[4][root[at]])], names=["u", "v"])

        for batch in batches:
            new = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*group, "fp"]]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            same = np.ones(len(held[0]), dtype=bool)
            for c in held[:4]:
                same &= c == c[-1]
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end >= _CHUNK // 4:  # whole groups; the last one may go on in the next batch
                yield solve([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield solve(held)

    return rows.repartition(parts, *group).sortWithinPartitions(*group, "rank").mapInArrow(link, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``fingerprint`` as 16 hex digits; ``component_id``: the smallest id of all documents reachable by links, itself
    included. Null and empty texts and texts of blanks have fingerprint zero and are linked like any other. Rows with a
    null id are linked too and get their component's smallest id, null if it has none. Repeated ids stay repeated.
    """
    prints = staged(fingerprints(docs, [F.col("doc_id")]), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp"), limit)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@op("op9_simhash_neardup")
def op9_simhash_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
