"""Similarity join of titles on the matching-block ratio, lossless for every alphabet.

Two titles of ``s`` characters together that reach a ratio ``t`` match at least ``t s / 2`` characters in blocks, and every
gap between blocks holds an unmatched one. So they share at least ``s (1.5 t - 1) - 1`` bigrams, and one of their rarest
ones: all but as many as they must share, plus one. Titles meet under (provider, length band, rarest bigram); bands are
as wide as lengths of similar titles may differ, so these lie in one band or in two next to each other. Titles too short
to be sure of a bigram meet under single characters by the same rule.

A key that holds more than ``LARGEST_KEY`` titles is split by the second rarest shared gram, then by the third, as far
as the titles of its band must share so many; what is still larger is dealt as pairs of blocks. Where titles would meet
more often under such keys than if all of a (provider, band) met once, as in prose of one language, these all meet in
pairs of blocks and no key is made. Two upper bounds of the matched characters, those that both titles hold and the longest
common subsequence, are computed for thousands of pairs at a time in the bits of machine words. Few pairs pass; each
of them is scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.functions.text import let
from offerlens.session import staged

RATIO = 0.78
#: Titles that meet under one key at most, before it is split; grams that a key is split by at most.
LARGEST_KEY, DEPTH = 4096, 3
#: Characters of the bit pattern of a title; those behind it count as matched. Pairs that are bounded at a time.
PATTERN, PAIRS = 512, 1 << 14
#: Characters fall into so many classes for the bounds; equal ones always into the same. Repeats of a class that have a bit.
CLASSES, REPEATS = 127, 16


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two titles, as the standard library defines it; 1 for two empty ones, null beside a null."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def bands(ratio: float, longest: int = 1 << 24) -> list[int]:
    """First lengths of the length bands: a title similar to one of a band is in it or in a neighbouring one."""
    out = [1]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, math.floor((out[-1] - 1) * (2 - ratio) / ratio + 1e-9) + 1))
    return out


def shared_grams(length: int, low: int, ratio: float, width: int) -> int:
    """Grams of ``width`` 1 or 2 that a title shares with any similar one of at least ``low`` characters, counted with repeats."""
    both = max(length + low, 2 * length / (2 - ratio))
    return math.ceil((both * ratio / 2 if width == 1 else both * (1.5 * ratio - 1) - 1) - 1e-9)


def _widths(lows: list[int], ratio: float) -> list[int]:
    return [2 if shared_grams(low, low, ratio, 2) >= 1 else 1 for low in lows]


def _grams(text: Column, width: int) -> Column:
    """Grams numbered by occurrence, so that set overlap equals multiset overlap."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, width))
    run = F.array_sort(F.when(F.length(text) >= width, grams).otherwise(F.array().cast("array<string>")))
    return let(run, lambda g: F.transform(g, lambda c, i: F.concat(c, F.lit("#"), (i - F.array_position(g, c).cast("int") + 1).cast("string"))))


def _keyed(titles: DataFrame, ratio: float) -> DataFrame:
    """(id, provider_id, band, own, must, grams): titles by band, with their grams, rarest first, as far as any key may need them."""
    lows = bands(ratio)
    widths = _widths(lows, ratio)
    at = lambda values, place: F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)
    size = F.length("norm")
    band = F.size(F.filter(F.array(*[F.lit(v) for v in lows]), lambda low: low <= size)) - 1
    rows = titles.select("id", "provider_id", "norm", size.alias("size"), band.alias("home"))
    both = F.array(F.struct(F.col("home").alias("band"), F.lit(True).alias("own")), F.struct((F.col("home") - 1).alias("band"), F.lit(False).alias("own")))
    rows = rows.select("*", F.explode(both).alias("b")).filter("b.band >= 0").select("id", "provider_id", "norm", "size", "b.band", "b.own")
    rows = rows.withColumns({"width": at(widths, F.col("band")), "low": at(lows, F.col("band"))})
    both_sizes = F.greatest(F.col("size") + F.col("low"), F.col("size") * (2 / (2 - ratio)))
    must = F.ceil(F.when(F.col("width") == 1, both_sizes * (ratio / 2)).otherwise(both_sizes * (1.5 * ratio - 1) - 1) - 1e-9).cast("int")
    grams = titles.join(rows.select("id", "width").distinct(), "id")
    grams = grams.select("id", "width", F.explode(F.when(F.col("width") == 1, _grams(F.col("norm"), 1)).otherwise(_grams(F.col("norm"), 2))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(often, "gram").groupBy("id", "width").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    rows = rows.withColumn("must", must).drop("norm", "low").join(ranked, ["id", "width"])
    sure = F.element_at(F.array(*[F.lit(shared_grams(low, low, ratio, w)) for low, w in zip(lows, widths)]), F.col("band") + 1)
    needed = F.size("grams") - F.col("must") + F.least(sure, F.lit(DEPTH))
    return rows.select("id", "provider_id", "band", "own", "must", sure.alias("sure"), F.slice(F.transform("grams", lambda g: g["gram"]), F.lit(1), needed).alias("grams"))


def _key_spots() -> Column:
    """(last, key) of the grams under which a title meets others, with the place of the gram in ``grams``."""
    return F.posexplode(F.slice("grams", F.lit(1), F.greatest(F.size("grams") - F.least(F.col("sure"), F.lit(DEPTH)) + 1, F.lit(0)))).alias("last", "key")


def title_keys(titles: DataFrame, ratio: float = RATIO, largest: int = LARGEST_KEY) -> DataFrame:
    """(provider_id, band, key, pair, id, own, side): where titles (id, provider_id, norm) meet; ``pair`` is a pair of blocks of a key.

    ``side`` tells the two blocks of a pair apart (0 and 1); 2 stands for a block paired with itself.
    """
    return _split_keys(staged(_keyed(titles, ratio), "title-grams"), largest)


def _split_keys(rows: DataFrame, largest: int) -> DataFrame:
    keys = rows.select("*", _key_spots())
    group = ["provider_id", "band", "key"]
    done = None
    for depth in range(1, DEPTH + 1):
        keys = staged(keys, "title-keys")
        large = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
        marked = keys.join(large, group, "left")
        split = F.col("n").isNotNull() & (F.col("sure") > depth) if depth < DEPTH else F.lit(False)
        here = marked.filter(~split).select(*group, F.ceil(F.coalesce("n", F.lit(1)) / largest).cast("int").alias("blocks"), "id", "own")
        done = here if done is None else done.unionByName(here)
        if depth == DEPTH or large.isEmpty():
            break
        # The next shared gram lies behind this one, within the grams that hold one more shared one.
        more = F.size("grams") - F.least(F.col("sure"), F.lit(DEPTH)) + depth + 1
        tail = F.slice("grams", F.col("last") + 2, F.greatest(more - F.col("last") - 1, F.lit(0)))
        keys = marked.filter(split).select(*rows.columns, F.col("key").alias("head"), F.col("last").alias("past"), F.posexplode(tail).alias("step", "gram"))
        keys = keys.select(*rows.columns, (F.col("past") + F.col("step") + 1).alias("last"), F.concat_ws(" ", "head", "gram").alias("key"))
    return _dealt(done)


def _dealt(keys: DataFrame) -> DataFrame:
    """Titles of keys of several blocks in every pair of blocks that holds their own."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    side = lambda k: F.when(k == own, 2).when(own < k, 0).otherwise(1)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct((F.least(k, own) * F.col("blocks") + F.greatest(k, own)).alias("pair"), side(k).alias("side")),
    )
    return keys.select("provider_id", "band", "key", F.explode(pairs).alias("p"), "id", "own").select("provider_id", "band", "key", "p.pair", "id", "own", "p.side")


def _meetings(rows: DataFrame, largest: int) -> DataFrame:
    """The keys of titles by grams, or, where that makes fewer pairs, one key for all titles of a (provider, band)."""
    group = ["provider_id", "band"]
    met = rows.select(*group, _key_spots()).groupBy(*group, "key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = met.groupBy(*group).agg(F.sum(F.col("n") * F.col("n")).alias("met"))
    crowded = rows.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("n")).join(met, group).filter(F.col("met") >= F.col("n") * F.col("n"))
    crowded = staged(crowded.select(*group, F.ceil(F.col("n") / largest).cast("int").alias("blocks")), "crowded")
    together = rows.join(crowded, group).select(*group, F.lit("").alias("key"), "blocks", "id", "own")
    return _split_keys(rows.join(crowded.select(*group), group, "left_anti").select(*rows.columns), largest).unionByName(_dealt(together))


class _Batch:
    """Titles of some keys: their bit patterns by character class, and what decides whether two of them may be similar."""

    def __init__(self, titles: list[str], ratio: float) -> None:
        self.ratio = ratio
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") % CLASSES for t in titles]
        self.size = np.array([len(p) for p in points])
        self.text = np.full((len(points), max(1, self.size.max(initial=0))), CLASSES, dtype=np.uint8)
        for k, p in enumerate(points):
            self.text[k, : len(p)] = p
        cut = self.text[:, :PATTERN]
        self.words = -(-cut.shape[1] // 64)
        self.masks = np.zeros((len(points), CLASSES + 1, self.words), dtype=np.uint64)
        row, place = np.nonzero(cut < CLASSES)
        np.bitwise_or.at(self.masks, (row, cut[row, place], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        self._hold()

    def _hold(self) -> None:
        """A bit per class and repeat that a title holds, in as many words as the titles need; further repeats are only counted."""
        counts = np.zeros((len(self.text), CLASSES + 1), dtype=np.int64)
        for at in range(self.text.shape[1]):
            counts[np.arange(len(self.text)), self.text[:, at]] += 1
        counts = counts[:, :CLASSES]
        kept = np.minimum(counts, REPEATS)
        self.more = (counts - kept).sum(axis=1)
        first = np.concatenate([[0], np.cumsum(kept.max(axis=0, initial=0))])
        self.held = np.zeros((-(-int(first[-1]) // 64), len(self.text)), dtype=np.uint64)
        for c in np.flatnonzero(np.diff(first)):
            for bit in range(first[c], first[c + 1]):
                self.held[bit // 64] |= (kept[:, c] > bit - first[c]).astype(np.uint64) << np.uint64(bit % 64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the characters that the pairs of rows both hold, in any order, let them reach the ratio; no similar pair fails."""
        both = np.minimum(self.more[a], self.more[b])
        for word in self.held:
            both += np.bitwise_count(word[a] & word[b])
        return 2 * both >= self.ratio * (self.size[a] + self.size[b]) - 1e-9

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs of rows may reach the ratio by lengths alone."""
        x, y = self.size[a], self.size[b]
        return 2 * np.minimum(x, y) >= self.ratio * (x + y) - 1e-9

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the longest common subsequence lets the pairs of rows reach the ratio; no similar pair fails."""
        a, b = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        order = np.argsort(-self.size[b], kind="stable")
        size_a, size_b = self.size[a[order]], self.size[b[order]]
        words = -(-min(PATTERN, int(size_a.max(initial=1))) // 64)
        flat = self.masks.reshape(-1, self.words)
        base, text = a[order] * (CLASSES + 1), self.text[b[order]]
        free = np.full((words, len(a)), ~np.uint64(0))
        live = len(a)
        for place in range(int(size_b.max(initial=0))):
            while live and size_b[live - 1] <= place:
                live -= 1
            mask = flat[base[:live] + text[:live, place]]
            carry = np.zeros(live, dtype=np.uint64)
            for w in range(words):
                v = free[w, :live]
                u = v & mask[:, w]
                total = v + u
                over = total < v
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                free[w, :live] = total | (v - u)
        used = np.minimum(size_a, PATTERN)
        taken = np.zeros(len(a), dtype=np.int64)
        for w in range(words):
            bits = np.clip(used - 64 * w, 0, 64)
            window = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
            taken += np.bitwise_count(~free[w] & window)
        taken += size_a - used
        out = np.empty(len(a), dtype=bool)
        out[order] = 2 * taken >= self.ratio * (size_a + size_b) - 1e-9
        return out


def _candidates(batches: Iterator[pa.RecordBatch], ratio: float) -> Iterator[pa.RecordBatch]:
    """Pairs under equal keys that pass the bound; rows (key columns ..., own, a, n, norm, side) come sorted by key."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.array([0, *np.cumsum([x[:4] != y[:4] for x, y in zip(rows, rows[1:])])])
        own, is_a, is_n, side = (np.array([r[c] for r in rows]) for c in (4, 5, 6, 8))
        batch = _Batch([r[7] for r in rows], ratio)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        found: list[tuple[int, int]] = []
        waiting = 0

        def flush() -> None:
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                ok = batch.close(a, b)
                found.extend(zip(a[ok].tolist(), b[ok].tolist()))
                left.clear()
                right.clear()

        for step in range(1, len(rows)):
            same = np.flatnonzero(keys[step:] == keys[:-step])
            if not len(same):
                break
            a, b = same, same + step
            # Two titles of one block meet where the block is paired with itself.
            ok = (own[a] | own[b]) & ((side[a] != side[b]) | (side[a] == 2)) & ((is_a[a] & is_n[b]) | (is_n[a] & is_a[b])) & batch.near(a, b)
            a, b = a[ok], b[ok]
            ok = batch.common(a, b)
            left.append(a[ok])
            right.append(b[ok])
            waiting += len(left[-1])
            if waiting >= PAIRS:
                flush()
                waiting = 0
        flush()
        out = {(rows[x][0], rows[p][7], rows[q][7]) for x, y in found for p, q in ((x, y), (y, x)) if is_a[p] and is_n[q]}
        if out:
            yield pa.RecordBatch.from_pylist([{"provider_id": p, "a_norm": a, "n_norm": n} for p, a, n in sorted(out, key=lambda r: (r[0] or "", *r[1:]))], pa.schema([("provider_id", pa.string()), ("a_norm", pa.string()), ("n_norm", pa.string())]))

    for batch in batches:
        held += zip(*[batch.column(c).to_pylist() for c in range(9)])
        if len(held) > 2048 and held[0][:4] != held[-1][:4]:  # whole keys; the last one may go on
            end = next(k for k in range(len(held) - 1, 0, -1) if held[k - 1][:4] != held[-1][:4])
            yield from solve(held[:end])
            held = held[end:]
    if held:
        yield from solve(held)


def similar_titles(left: DataFrame, right: DataFrame, ratio: float = RATIO, largest: int = LARGEST_KEY) -> DataFrame:
    """(provider_id, a_norm, n_norm, score): pairs of a left and a right title of one provider whose ratio reaches ``ratio``.

    Expects ``provider_id, norm`` on either side. Repeated titles count once; null providers and null or empty titles
    meet nobody; a title on both sides meets itself.
    """
    if not 2 / 3 < ratio <= 1:
        raise ValueError("titles of a ratio of two thirds or less need not share any gram")
    sides = left.select("provider_id", "norm", F.lit(True).alias("is_a"), F.lit(False).alias("is_n")).unionByName(
        right.select("provider_id", "norm", F.lit(False).alias("is_a"), F.lit(True).alias("is_n"))
    )
    titles = sides.filter("provider_id IS NOT NULL AND norm <> ''").groupBy("provider_id", "norm").agg(F.max("is_a").alias("is_a"), F.max("is_n").alias("is_n"))
    titles = staged(titles.withColumn("id", F.monotonically_increasing_id()), "titles")
    keys = _meetings(staged(_keyed(titles.select("id", "provider_id", "norm"), ratio), "title-grams"), largest)
    rows = keys.join(titles.select("id", "norm", "is_a", "is_n"), "id").select("provider_id", "band", "key", "pair", "own", "is_a", "is_n", "norm", "side")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["provider_id", "band", "key", "pair"]
    rows = rows.repartition(parts, *group).sortWithinPartitions(*group)
    pairs = rows.mapInArrow(lambda batches: _candidates(batches, ratio), "provider_id string, a_norm string, n_norm string").distinct()
    same = titles.filter("is_a AND is_n").select("provider_id", F.col("norm").alias("a_norm"), F.col("norm").alias("n_norm"))
    scored = staged(pairs, "similar").withColumn("score", sequence_ratio("a_norm", "n_norm")).filter(F.col("score") >= ratio)
    return scored.unionByName(same.withColumn("score", F.lit(1.0)))
