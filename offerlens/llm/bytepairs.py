"""Byte-level BPE by a monoid tree reduction.

Tokens of neighbouring byte strings form a monoid under *joining*: the tokens of a concatenation follow from the tokens of
its parts. A piece is halved down to leaves of a few bytes and joined up again. Unless the two tokens at the boundary are
stable side by side, a join re-encodes a window there and widens each side until its outermost token comes out as it
went in.

That proves the tokens outside the window stable. Merging by rank gives ``t1 .. tn`` exactly if each token encodes to
itself and each two neighbours encode to these two: the merges inside two neighbours are the same and in the same order
whether the rest is there or not, up to the first merge across a boundary, which would then happen to the two alone as
well. The neighbours outside the window stood side by side before; those inside come from one encoding; and the pair at
the edge is an old pair, as the edge token is an old one.

Decoding concatenates the tokens' bytes up a tree of halves. A text is split by the pattern first; no token crosses a match.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, op, table, utf8

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Matches, leaves and pairs of tokens that a worker remembers each; characters of a match that is remembered; bytes of a leaf.
REMEMBERED, REMEMBERED_CHARS, LEAF_BYTES = 600_000, 32, 8
#: Matches of a text that are in memory at a time; bytes of tokens that leave as one batch; ids of a leaf when decoding.
MATCHES, BATCH_BYTES, LEAF = 1 << 16, 1 << 25, 1 << 12

#: Code points that are letters or numbers since a later Unicode version than 16, which the tokenizer's
#: splitter knows; to it they are neither.
NEWER = (
    "\\u0558 \\u058B-\\u058C \\u088F \\u0C5C \\u0CDC \\u208F \\u209D-\\u209F \\uA7CE-\\uA7CF \\uA7D2 \\uA7D4 \\uA7DD \\uA7E2 \\uA7F1 \\uAB6C-\\uAB6D "
    "\\U000107BB-\\U000107BF \\U00010940-\\U00010959 \\U00010EC5-\\U00010EC7 \\U00010ED9-\\U00010EEE \\U00011B0A \\U00011DB0-\\U00011DDB "
    "\\U00011DE0-\\U00011DE9 \\U00011DF1 \\U0001246F \\U00012475-\\U0001247F \\U00012550-\\U00012686 \\U00016EA0-\\U00016EB8 \\U00016EBB-\\U00016ED3 "
    "\\U00016FF2-\\U00016FF6 \\U000187F8-\\U000187FF \\U00018CD6-\\U00018CDA \\U00018D09-\\U00018D20 \\U00018D80-\\U00018DF2 "
    "\\U00018E00-\\U00019191 \\U000191A0-\\U000191D2 \\U0001B123-\\U0001B128 \\U0001B168 \\U0001D6A6 \\U0001DF1F-\\U0001DF24 \\U0001DF2B-\\U0001DF81 "
    "\\U0001DF90-\\U0001DF96 \\U0001DFCD-\\U0001DFFF \\U0001E6C0-\\U0001E6DE \\U0001E6E0-\\U0001E6E2 \\U0001E6E4-\\U0001E6E5 \\U0001E6E7-\\U0001E6ED "
    "\\U0001E6F0-\\U0001E6F4 \\U0001E6FE-\\U0001E6FF \\U0002B73A-\\U0002B73F \\U0002B81E \\U0002CEA2-\\U0002CEAD \\U000323B0-\\U00033479 "
    "\\U0003D000-\\U0003FC3F"
)


def read_ranks(path: str = RANKS) -> tuple[bytes, ...]:
    """Token bytes by id, from a file of base64 tokens and their ranks."""
    with open(path, "rb") as lines:
        pairs = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    tokens = tuple(pairs.get(k, b"") for k in range(max(pairs) + 1))
    if len({t for t in tokens if len(t) == 1}) < 256:
        raise ValueError("the vocabulary lacks single bytes")
    return tokens


class Splitter:
    """Matches of the pattern in a text, in order; together they are the whole text."""

    def __init__(self, pattern: str) -> None:
        newer = "[" + NEWER.replace(" ", "") + "]"
        self.newer = regex.compile(newer)
        self.plain = regex.compile(pattern)
        strict = pattern
        for kind in ("\\p{L}", "\\p{N}"):
            strict = strict.replace(kind, f"[{kind}--{newer}]")
        self.strict = regex.compile(f"(?V1){strict}")

    def __call__(self, text: str) -> Iterator[list[str]]:
        use = self.strict if self._newer(text) else self.plain
        if len(text) <= MATCHES:
            yield use.findall(text)
            return
        found = use.finditer(text)
        while block := [m[0] for m in islice(found, MATCHES)]:
            yield block

    def _newer(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.newer.search(text) is not None
        return False


class _Known(dict):
    """Match -> its packed ids, as far as remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        ids = self.vocabulary.packed(match)
        if len(match) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids


class Vocabulary:
    """Encodes and decodes; ``tokens``: bytes by id."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str = public_tokenizers.PATTERN) -> None:
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens) if t}
        self.split = Splitter(pattern)
        self.longest = max(map(len, tokens))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.leaves: dict[bytes, list[bytes]] = {}
        self.known = _Known(self)

    def merged(self, window: bytes) -> list[bytes]:
        """Tokens of a string by the definition: from single bytes by the least rank, leftmost first."""
        rank = self.rank
        parts = [window[k : k + 1] for k in range(len(window))]
        none = len(self.tokens)
        pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at : at + 2] = [self.tokens[best]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank.get(parts[at] + parts[at + 1], none)
        return parts

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether two tokens side by side encode to themselves."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging two tokens side by side never crosses from one to the other, and rebuilds both."""
        rank, both, edge = self.rank, a + b, len(a) - 1
        parts = [both[k : k + 1] for k in range(len(both))]
        none = len(self.tokens)
        ranks = [rank.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while (best := min(ranks)) < none:
            at = ranks.index(best)
            if at == edge:
                return False
            parts[at : at + 2] = [self.tokens[best]]
            del ranks[at]
            edge -= at < edge
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], none)
        return len(parts) == 2

    def _alone(self, token: bytes) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merged(token) == [token]
        return found

    def window(self, data: bytes) -> list[bytes]:
        """Tokens of a window: the one sequence of tokens that are all stable beside each other.

        The longest token is tried first. The tokens in front of a place are the encoding of the bytes in front of it, so
        they are the only ones there; a place from which nothing leads on is no boundary and is not tried again.
        """
        rank, out, place, size, dead = self.rank, [], 0, self.longest, set()
        while place < len(data):
            size = min(size, len(data) - place)
            while size:
                token = data[place : place + size]
                if token in rank and place + size not in dead and (self.stable(out[-1], token) if out else self._alone(token)):
                    break
                size -= 1
            if size:
                out.append(token)
                place, size = place + size, self.longest
            else:
                dead.add(place)
                size = len(out[-1]) - 1
                place -= len(out.pop())
        return out

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """Tokens of two neighbouring strings from the tokens of each."""
        if self.stable(a[-1], b[0]):
            return a + b
        i, j = min(2, len(a)), min(2, len(b))  # one token a side cannot come out as it went in
        while True:
            window = self.window(b"".join(a[len(a) - i :]) + b"".join(b[:j]))
            left = i == len(a) or window[0] == a[-i]
            right = j == len(b) or window[-1] == b[j - 1]
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i = i if left else min(2 * i, len(a))
            j = j if right else min(2 * j, len(b))

    def tree(self, data: bytes) -> list[bytes]:
        """Tokens of a string, joined up from its halves; the first half is a power of two, a leaf one window."""
        if len(data) > LEAF_BYTES:
            middle = 1 << (len(data) - 1).bit_length() - 1
            return self.join(self.tree(data[:middle]), self.tree(data[middle:]))
        out = self.leaves.get(data)
        if out is None:
            out = self.leaves[data] = self.window(data)
        return out

    def packed(self, match: str) -> bytes:
        """Ids of one match: of itself if it is a token, else of its tree."""
        data = match.encode("utf-8", "replace")
        whole = self.rank.get(data)
        ids = [self.rank[t] for t in self.tree(data)] if whole is None else [whole]
        for memory in (self.pairs, self.leaves):
            if len(memory) >= REMEMBERED:
                memory.clear()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null is empty."""
        known = self.known.__getitem__
        return b"".join([b"".join(map(known, block)) for block in self.split(text)]) if text else b""

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a row of ids."""
        if len(ids) <= LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def _vocabulary(tokens: tuple[bytes, ...], pattern: str) -> Vocabulary:
    return Vocabulary(tokens, pattern)


def _map(rows: DataFrame, name: str, fn, schema: str) -> DataFrame:
    """Replace the last column of ``rows`` by ``name``; ``fn``: its values -> (array, bytes taken) piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at = batch.columns[:-1], 0
            for column in fn(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(column)) for c in kept], column], names=[*batch.schema.names[:-1], name])
                at += len(column)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, tokens: tuple[bytes, ...], keep: list[Column], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``ids`` (array of int), the tokens of the whole ``text``; null and empty texts have none.

    ``tokens``: the vocabulary by id (``read_ranks``). Row by row: repeated rows repeat, an empty table stays empty. A text
    is split in blocks of matches, so a very long one needs memory for itself and its ids only. ``keep`` must not
    hold a column ``ids``.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    if "ids" in rows.columns[:-1]:
        raise ValueError("a kept column is named ids")
    shipped = docs.sparkSession.sparkContext.broadcast((tokens, pattern))  # as large as the vocabulary

    def arrays(packed: list[bytes]) -> pa.Array:
        ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))

    def derive(texts: pa.Array) -> Iterator[pa.Array]:
        work, held, size = _vocabulary(*shipped.value), [], 0
        for text in texts:
            held.append(work.encode(text.as_py()))
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield arrays(held)
                held, size = [], 0
        if held:
            yield arrays(held)

    return _map(rows, "ids", derive, columns_of(rows, "_text", "ids array<int>"))


def decode(rows: DataFrame, tokens: tuple[bytes, ...], keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``rows`` with ``coded``: the ids of column ``ids`` as little-endian unsigned 32-bit integers (``packed``) and the
    bytes of their tokens (``decoded``). Null ids are none; an unknown id is an error. ``keep`` must not hold a column ``coded``.
    """
    if "coded" in keep:
        raise ValueError("a kept column is named coded")
    chosen = rows.select(*keep, F.coalesce(ids, F.expr("cast(array() as array<int>)")).alias("_ids"))
    shipped = rows.sparkSession.sparkContext.broadcast((tokens, public_tokenizers.PATTERN))  # as large as the vocabulary

    def structs(held: list[tuple[bytes, bytes]]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([h[k] for h in held], pa.binary()) for k in (0, 1)], names=["packed", "decoded"])

    def derive(column: pa.Array) -> Iterator[pa.Array]:
        work, held, size = _vocabulary(*shipped.value), [], 0
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for a, b in zip(ends, ends[1:]):
            held.append((values[a:b].astype("<u4").tobytes(), work.decode(values[a:b])))
            size += len(held[-1][0]) + len(held[-1][1])
            if size >= BATCH_BYTES:
                yield structs(held)
                held, size = [], 0
        if held:
            yield structs(held)

    return _map(chosen, "coded", derive, columns_of(chosen, "_ids", "coded struct<packed:binary,decoded:binary>"))


@op("op13_byte_pairs")
def op13_byte_pairs(spark, sf_dir):
    """Per row of ``documents``: doc_id, number of tokens, digests of the ids and of the bytes they decode to.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows and null ids stay; other
    columns play no part; an empty table gives no rows. Every row is encoded on its own.
    """
    tokens = read_ranks()
    ids = encode(table(spark, sf_dir, "documents"), tokens, [F.col("doc_id")])
    out = decode(ids.withColumn("n_tokens", F.size("ids").cast("bigint")), tokens, ["doc_id", "n_tokens"])
    return out.select("doc_id", "n_tokens", F.sha2("coded.packed", 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256"))
