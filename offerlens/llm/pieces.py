"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

All segmentations of a text into vocabulary pieces form a lattice. A piece's weight is 1 / (2 + rank), raised to
1 / temperature, and a segmentation's probability is proportional to the product of its weights. The forward pass sums
the weights of all ways to reach each character; the backward pass then draws the last piece, the one before it, and so
on. Each draw's random number is a hash of seed, row key, word and step, so a row gets the same pieces whatever its
batch, partition or retry.

No piece has a blank behind its first other character, nor a line break if the vocabulary has none, so the lattice
falls apart at words; each distinct word of a batch is filtered once, all side by side. Characters without a piece become
their UTF-8 bytes. A blank is put before the text and taken off again in decoding, as usual; decoding gives back every
text exactly.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, op, table

SEED, TEMPERATURE = 17, 0.5
#: Vocabulary of the queries; ``read_pieces`` takes any other path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words above this many characters are filtered one at a time in little memory; others side by side.
LONG_WORD = 4096
#: Characters of text whose words are told apart at a time, and of distinct words whose lattice is held at a time.
SLICE, LATTICE = 1 << 20, 1 << 17
_ONE = 1 << 31
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Pieces:
    """Pieces as text (None: control and unknown), their ranks, and the id of each byte."""

    texts: tuple[str | None, ...]
    ranks: tuple[float, ...]
    bytes_: tuple[int, ...]


def read_pieces(path: str) -> Pieces:
    """Read a SentencePiece model with byte pieces, on the driver; tasks get its pieces, not the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts: list[str | None] = []
    by_byte: dict[int, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
        special = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        texts.append(None if special else piece.replace("▁", " "))
    if len(by_byte) < 256:
        raise ValueError("a vocabulary without byte pieces cannot encode every text")
    ranks = tuple(abs(model.get_score(i)) for i in range(len(texts)))
    return Pieces(tuple(texts), ranks, tuple(by_byte[b] for b in range(256)))


class Lattice:
    """Lookup tables of a vocabulary and the sampler."""

    def __init__(self, pieces: Pieces, temperature: float) -> None:
        self.pieces, n = pieces, len(pieces.texts)
        usable = {t: i for i, t in reversed(list(enumerate(pieces.texts))) if t and " " not in t.lstrip(" ")}
        self.ids = usable
        self.weight = np.array([-math.log(2 + r) / temperature for r in pieces.ranks])
        self.byte_weight = -math.log(2 + n) / temperature
        self.longest = max(map(len, usable))
        breaks = "\n" if not any("\n" in t for t in usable) else ""
        self.words = re.compile(rf"{breaks}| *[^ {breaks}]+| +" if breaks else r" *[^ ]+| +")
        chars = sorted(set("".join(usable)))
        self.symbol = np.zeros(0x110000, dtype=np.int64)
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        child: dict[int, int] = {}
        piece_at = [-1]
        for text, i in usable.items():
            node = 0
            for c in text:
                key = node * self.width + int(self.symbol[ord(c)])
                node = child.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        self.piece_at = np.array(piece_at)
        self.shift = np.uint64(64 - max(8, (4 * len(child)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        keys, values = np.array(list(child), dtype=np.int64), np.array(list(child.values()), dtype=np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = np.flatnonzero(self.keys[slot] != keys)
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (size - 1)
        table_ = [b"" if t is None else t.encode() for t in pieces.texts]
        for b, i in enumerate(pieces.bytes_):
            table_[i] = bytes([b])
        self.table = table_

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_MIX[0])) >> self.shift).astype(np.int64)

    def _child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * self.width + symbol
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], -1)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def _edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces at all characters; piece -1: a character as bytes. ``end``: of each character's word."""
        symbol = self.symbol[codes]
        at, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        single = np.zeros(len(codes), dtype=bool)
        found = []
        for size in range(1, self.longest + 1):
            ok = np.flatnonzero(at + size <= end[at])
            at, node = at[ok], node[ok]
            node = self._child(node, symbol[at + (size - 1)])
            ok = np.flatnonzero(node >= 0)
            at, node = at[ok], node[ok]
            if not len(at):
                break
            piece = self.piece_at[node]
            ok = np.flatnonzero(piece >= 0)
            found.append((at[ok], np.full(len(ok), size), piece[ok]))
            if size == 1:
                single[at[ok]] = True
        bare = np.flatnonzero(~single)
        found.append((bare, np.ones(len(bare), dtype=np.int64), np.full(len(bare), -1)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def filter_words(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Forward pass over words.

        (place of each word's end, first edge of each place, edges' thresholds keyed by place, lengths, pieces, codes).
        A word of n characters has n + 1 places. An edge's threshold is its cumulative probability among the edges that
        end at the same place, in 2**-31; an edge of piece -1 - c stands for the bytes of character c.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes)
        start, length, piece = self._edges(codes, last[word])
        code = codes[start]
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        weight = np.where(piece >= 0, self.weight[piece], self.byte_weight * n_bytes)
        piece = np.where(piece >= 0, piece, -1 - code.astype(np.int64))
        place = start + word[start]  # of the edge's start
        order = np.argsort((place + length) * (self.longest + 1) + length)
        place, length, piece, weight = place[order], length[order], piece[order], weight[order]
        places = len(codes) + len(words)
        first = np.searchsorted(place + length, np.arange(places + 1))
        base = last - sizes + np.arange(len(words))
        alpha = np.zeros(places)
        by_size = np.argsort(-sizes, kind="stable")
        base_by_size, long_ = base[by_size], np.searchsorted(-sizes[by_size], -np.arange(int(sizes.max()) + 1), side="right")
        for t in range(1, int(sizes.max()) + 1):
            here = base_by_size[: long_[t]] + t
            counts = first[here + 1] - first[here]
            begin = np.cumsum(counts) - counts
            edge = np.repeat(first[here] - begin, counts) + np.arange(int(counts.sum()))
            alpha[here] = np.logaddexp.reduceat(alpha[place[edge]] + weight[edge], begin)
        to = place + length
        share = np.cumsum(np.exp(alpha[place] + weight - alpha[to]))
        before = np.concatenate(([0.0], share))
        lead, total = before[first[to]], before[first[to + 1]]
        threshold = np.floor((share - lead) / (total - lead) * _ONE).astype(np.int64)
        threshold[first[to + 1] - 1 == np.arange(len(to))] = _ONE
        return base + sizes, first, (to << 32) + threshold, length, piece

    def _long_word(self, word: str, draw: Iterator[int]) -> list[int]:
        """Pieces of one long word, by the same passes; keeps one number a character."""
        n = len(word)
        alpha = array("d", bytes(8 * (n + 1)))
        edges = lambda e: self._into(word, e)
        for e in range(1, n + 1):
            terms = [alpha[e - size] + w for size, _, w in edges(e)]
            top = max(terms)
            alpha[e] = top + math.log(sum(math.exp(t - top) for t in terms))
        out, e = [], n
        while e:
            options = edges(e)
            probs = [math.exp(alpha[e - size] + w - alpha[e]) for size, _, w in options]
            total, u, acc = sum(probs), next(draw), 0.0
            for (size, piece, _), p in zip(options, probs):
                acc += p
                if math.floor(acc / total * _ONE) > u:
                    break
            out.append(piece)
            e -= size
        return out[::-1]

    def _into(self, word: str, e: int) -> list[tuple[int, int, float]]:
        """(length, piece, weight) of the edges that end before character ``e``."""
        out = []
        for size in range(1, min(self.longest, e) + 1):
            i = self.ids.get(word[e - size : e])
            if i is not None:
                out.append((size, i, float(self.weight[i])))
            elif size == 1:
                out.append((1, -1 - ord(word[e - 1]), self.byte_weight * len(word[e - 1].encode())))
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray | None]:
        """Sampled piece ids of each text; None for null, none for an empty text."""
        lists = [self.words.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(x) for x in lists], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = [w for x in lists for w in x]
        del lists
        sizes = np.cumsum(np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        begin = 0
        while begin < len(flat):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, side="right")))
            seeds = _mix(keys[row[begin:end]].astype(np.uint64) + np.uint64(seed * _MIX[1] % (1 << 64))) + nth[begin:end].astype(np.uint64) * np.uint64(_MIX[2])
            done.append(self._sample(flat[begin:end], seeds))
            begin = end
        pieces = np.concatenate([p for p, _ in done]) if done else np.zeros(0, dtype=np.int64)
        per_word = np.concatenate([n for _, n in done]) if done else np.zeros(0, dtype=np.int64)
        per_text = np.bincount(row, weights=per_word, minlength=len(texts)).astype(np.int64)
        bare = np.flatnonzero(pieces < 0)
        if len(bare):
            codes, place = np.unique(-1 - pieces[bare], return_inverse=True)
            encoded = [[self.pieces.bytes_[b] for b in chr(c).encode("utf-8", "replace")] for c in codes.tolist()]
            width = np.ones(len(pieces), dtype=np.int64)
            width[bare] = np.array([len(x) for x in encoded])[place]
            per_text = np.bincount(np.repeat(np.arange(len(texts)), per_text), weights=width, minlength=len(texts)).astype(np.int64)
            at = np.cumsum(width) - width
            out = np.repeat(pieces, width)
            for k in range(4):
                ok = np.flatnonzero(width[bare] > k)
                out[at[bare[ok]] + k] = np.array([x[k] if k < len(x) else 0 for x in encoded])[place[ok]]
            pieces = out
        parts = np.split(pieces.astype(np.int32), np.cumsum(per_text)[:-1])
        return [None if t is None else p for t, p in zip(texts, parts)]

    def _sample(self, words: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words, number of each word's)."""
        index: dict[str, int] = {}
        which = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
        distinct = list(index)
        is_long = np.array([len(w) > LONG_WORD for w in distinct], dtype=bool)
        counts = np.zeros(len(words), dtype=np.int64)
        drawn: list[tuple[np.ndarray, int, np.ndarray]] = []
        size = np.array([len(w) for w in distinct], dtype=np.int64)
        part = np.where(is_long, -1, np.cumsum(size * ~is_long) // LATTICE)
        lane_part = part[which]
        by_part = np.argsort(lane_part, kind="stable")
        bounds = np.searchsorted(lane_part[by_part], np.arange(int(part.max(initial=-1)) + 2))
        for k in range(len(bounds) - 1):
            lane = by_part[bounds[k] : bounds[k + 1]]
            if not len(lane):
                continue
            mine = np.flatnonzero(part == k)
            end, first, threshold, length, piece = self.filter_words([distinct[j] for j in mine.tolist()])
            at = end[np.searchsorted(mine, which[lane])]
            start = at - size[which[lane]]
            step = 0
            while len(lane):
                u = (_mix(seeds[lane] + np.uint64(step * _MIX[0] % (1 << 64))) >> np.uint64(33)).astype(np.int64)
                edge = np.searchsorted(threshold, (at << 32) + u, side="right")
                drawn.append((lane, step, piece[edge].astype(np.int32)))
                at = at - length[edge]
                more = np.flatnonzero(at > start)
                counts[lane] = step + 1
                lane, at, start, step = lane[more], at[more], start[more], step + 1
        by_hand = {}
        for k in np.flatnonzero(is_long[which]).tolist():
            draw = (int(_mix(seeds[k : k + 1] + np.uint64(s * _MIX[0] % (1 << 64)))[0] >> np.uint64(33)) for s in range(len(words[k])))
            by_hand[k] = self._long_word(words[k], draw)
            counts[k] = len(by_hand[k])
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), dtype=np.int64)
        for lane, step, piece in drawn:
            out[ends[lane] - 1 - step] = piece
        for k, got in by_hand.items():
            out[ends[k] - len(got) : ends[k]] = got
        return out, counts

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = b"".join([self.table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _lattice(pieces: Pieces, temperature: float) -> Lattice:
    return Lattice(pieces, temperature)


def encode(docs: DataFrame, pieces: Pieces, key: Column, keep: list[Column], seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``ids``, sampled piece ids of the whole ``text``, and ``decoded``, the text they give back.

    A row's ids depend on text, key, seed and temperature alone; equal rows get equal ids. Null text: null ids; empty
    text: no ids. A null key is a key like any other.
    """
    rows = docs.select(*keep, F.xxhash64(key).alias("_key"), F.col("text").alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shipped.value, temperature)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).to_pylist()
            keys = batch.column(batch.num_columns - 2).to_numpy()
            ids = lattice.encode(texts, keys, seed)
            sizes = np.array([0 if p is None else len(p) for p in ids])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([p is None for p in ids] + [False]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for p in ids if p is not None] or [np.zeros(0, np.int32)]), pa.int32()))
            decoded = pa.array([lattice.decode(p) for p in ids], pa.string())
            kept = batch.columns[: batch.num_columns - 2]
            yield pa.RecordBatch.from_arrays([*kept, lists, decoded], names=[*batch.schema.names[: batch.num_columns - 2], "ids", "decoded"])

    return rows.mapInArrow(run, columns_of(rows.drop("_key"), "_text", "ids array<int>", "decoded string"))


def encoded(docs: DataFrame, pieces: Pieces, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` with the ids sampled by ``doc_id``, their number, and whether decoding gives the text back."""
    rows = encode(docs, pieces, F.col("doc_id"), [*keep, F.col("text").alias("_original")])
    return rows.select(*[c for c in rows.columns if c not in ("_original", "decoded")], F.array_size("ids").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("_original")).alias("lossless"))


@op("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), read_pieces(MODEL), [F.col("doc_id")])
