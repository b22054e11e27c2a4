"""Removal of repeated passages: every byte that a 50-byte string of an earlier document covers goes.

Equal strings have to meet, and only those. Each 50-byte window takes the 16-byte piece of smallest hash in it. Windows
that take the same piece and lie similarly about it have 33 bytes or more in common; these bytes and the way they lie are
the name of the window. Neighbouring windows mostly share a name, and such a run of windows is a segment.

1. Names that occur in one document only are dropped: tasks send the distinct names of many documents together.
2. Segments of the others go to shards by name, so all windows of equal bytes are in one shard; a task sends equal
   segments of neighbouring documents once, whatever number of these hold them. A piece that many documents hold in other
   surroundings has as many names, which lie in as many shards.
3. A shard, which may be far larger than memory, sorts the suffixes of its segments by external induced sorting
   (``suffixsort``). Windows that share 50 bytes lie side by side, and the smallest id among their documents decides for
   all of them. A name with a single segment text needs no order.
4. The runs of bytes to remove go back to their documents.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import op, spans, table
from offerlens.llm.suffixsort import Spool, sorted_suffixes

LENGTH, PIECE = 50, 16
#: Windows whose piece is so many bytes from their start have the same bytes in common; the last is out of reach.
SIDES = (0, 18, LENGTH - PIECE + 1)
#: Bytes of a document that are hashed at a time (their arrays fit a core's cache), and of segments that a task holds
#: before it sends them.
STRETCH, SEND = 1 << 16, 32 << 20
#: Bytes of short documents that are hashed together.
TOGETHER = 1 << 15
#: Shards into which a task parts what it gets; it sorts one at a time, so more of them need less scratch space at once.
#: Shards that have no more than so many bytes of segments together are sorted as one.
SHARDS, JOIN = 16, 4 << 20
#: Names that a task holds before it sends them: with few names to a part at a time, the number of rows sent would grow
#: with the square of the input.
HOLD = 2 << 20
_MULT = 0x9E3779B97F4A7C15
#: Bits of a hash that give way to the place of its piece, of which ``STRETCH`` and ``TOGETHER`` stay far below.
_PLACE = np.uint64((1 << 20) - 1)
_OCCURRENCE = np.dtype([("segment", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i8")])
_SEGMENT = np.dtype([("name", "<u8"), ("size", "<i8"), ("least", "<i8")])


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each piece of ``PIECE`` bytes (a power of two)."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < PIECE:
        h = h[:-size] * np.uint64(pow(_MULT, size, 1 << 64)) + h[size:]
        size *= 2
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, bytes) of the runs of windows of equal name, in order; nothing below ``LENGTH`` bytes."""
    out = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), STRETCH):
        m = _window_names(data[begin : begin + STRETCH + LENGTH - 1])
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        out.append((m[first], first + begin, np.diff(np.append(first, len(m))) + LENGTH - 1))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _window_names(data: np.ndarray) -> np.ndarray:
    """Name of each window of ``LENGTH`` bytes, from nothing but its bytes.

    A window takes the piece of smallest hash, the first of several. By the side on which that piece lies, the bytes that
    all windows of this piece and side have in common make the name.
    """
    h = _hashes(data)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, reach = 1, LENGTH - PIECE + 1
    while 2 * width <= reach:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (reach - width)], m[reach - width :]) if width < reach else m
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    piece, end = (m[first] & _PLACE).astype(np.int64), np.append(first[1:], len(m))
    turns = [piece - side + 1 for side in SIDES[1:-1]]
    first = np.sort(np.concatenate([first, *[t[(first < t) & (t < end)] for t in turns]]))
    piece, sides = (m[first] & _PLACE).astype(np.int64), np.array(SIDES)
    side = sum((piece - first >= s).astype(np.int64) for s in SIDES[1:-1])
    begin, last = piece - sides[side], piece - sides[side + 1] + 1 + LENGTH - PIECE  # of the pieces that cover what is common
    name = h[begin] * np.uint64(_MULT) + h[begin + PIECE] * np.uint64(pow(_MULT, 2, 1 << 64)) + h[last] * np.uint64(pow(_MULT, 3, 1 << 64))
    return np.repeat(_mixed(name + side.astype(np.uint64)), np.diff(np.append(first, len(m))))


def segments_of(values: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``segments`` of each value, in order; short values next to each other are hashed together."""
    begin = 0
    while begin < len(values):
        end, size = begin + 1, len(values[begin] or b"")
        while end < len(values) and size + len(values[end] or b"") <= TOGETHER:
            size += len(values[end] or b"")
            end += 1
        if end == begin + 1 or size < LENGTH:
            yield from (segments(_bytes(v)) for v in values[begin:end])
        else:
            yield from _together(values[begin:end])
        begin = end


def _together(values: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    sizes = np.array([len(v or b"") for v in values], dtype=np.int64)
    ends = np.cumsum(sizes)
    m = _window_names(_bytes(b"".join(v or b"" for v in values)))
    inside = np.ones(len(m) + 1, dtype=bool)  # windows that lie in one value; one more closes the last run
    inside[-1] = False
    for e in ends[:-1].tolist():
        inside[max(e - LENGTH + 1, 0) : e] = False
    fresh = np.flatnonzero(inside[:-1] & np.concatenate(([True], (m[1:] != m[:-1]) | ~inside[:-2])))
    stop = np.flatnonzero(~inside)
    close = stop[np.searchsorted(stop, fresh)]
    length = np.minimum(np.append(fresh[1:], len(m)), close) - fresh + LENGTH - 1
    names, cuts = m[fresh], np.searchsorted(fresh, ends)
    for a, b, base in zip([0, *cuts[:-1].tolist()], cuts.tolist(), (ends - sizes).tolist()):
        yield names[a:b], fresh[a:b] - base, length[a:b]


def _short(name: np.ndarray) -> np.ndarray:
    """The leading 32 bits of names, which tell names of one part apart; names that agree only let more segments through."""
    return (name >> np.uint64(32)).astype(np.uint32)


def _part(name: np.ndarray, parts: int) -> np.ndarray:
    """Part of a name, from the bits that are not in ``_short``."""
    return ((name & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)  # 16 bits sort faster


def _bytes(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=np.uint8)


def _distinct(name: np.ndarray) -> np.ndarray:
    name = np.sort(name)
    return name[np.concatenate((name[1:] != name[:-1], [True]))] if len(name) else name


def _names(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, names, docs, counts): by part of the name space the distinct names of each document."""
    names: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        name, row, ids = np.concatenate(names), np.repeat(np.arange(len(names)), [len(x) for x in names]), np.concatenate(docs)
        part = _part(name, parts)
        order = np.argsort(part, kind="stable")
        name, row, part = _short(name[order]).astype("<u4"), row[order], part[order]
        rows = []
        for a, b in _cuts(part):
            first = np.flatnonzero(np.concatenate(([True], row[a + 1 : b] != row[a : b - 1])))
            rows.append((int(part[a]), name[a:b].tobytes(), _planes(ids[row[a:b][first]]), _planes(np.diff(np.append(first, b - a)))))
        names.clear()
        docs.clear()
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "names", "docs", "counts"])

    for batch in batches:
        found = [_distinct(name) for name, _, _ in segments_of(batch.column(1).to_pylist())]
        names += found
        docs.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        held += sum(len(x) for x in found)
        if held >= HOLD:
            yield flush()
            held = 0
    if held:
        yield flush()


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return [(a, b) for a, b in zip(at, at[1:]) if b > a]


def _shared(part: pa.Table) -> pa.Table:
    """(doc_id, name) of the names of one part that occur in more than one document."""
    name = np.frombuffer(b"".join(part["names"].to_pylist()), dtype="<u4")
    doc = np.concatenate([np.repeat(_numbers(d), _numbers(c)) for d, c in zip(part["docs"].to_pylist(), part["counts"].to_pylist())])
    order = np.sort((name.astype(np.uint64) << np.uint64(32)) | np.arange(len(name), dtype=np.uint64))  # far fewer than 2 ** 32
    name, doc = (order >> np.uint64(32)).astype(np.uint32), doc[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    size = np.diff(np.append(first, len(name)))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    keep = np.repeat(several, size)
    return pa.table({"doc_id": pa.array(doc[keep]), "name": pa.array(name[keep].view(np.int32))})


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte, all lowest bytes first, which compresses better."""
    return np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes, n: int | None = None, at: int = 0) -> np.ndarray:
    n = len(raw) // 8 if n is None else n
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, pack): the segments of shared names, packed with their occurrences."""
    texts: dict[bytes, int] = defaultdict(count().__next__)
    names: list[np.ndarray] = []
    occ: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        name, found = np.concatenate(names), np.concatenate(occ)
        pieces = list(texts)
        of = _part(name, parts)[found["segment"]]
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
        rows = []
        for a, b in _cuts(of):
            mine, found["segment"][a:b] = np.unique(found["segment"][a:b], return_inverse=True)
            own = [pieces[j] for j in mine.tolist()]
            head = struct.pack("<qq", len(own), b - a)
            sizes = np.array([len(p) for p in own], dtype=np.int64)
            pack = b"".join([head, _short(name[mine]).astype("<u4").tobytes(), _planes(sizes), *[_planes(found[f][a:b]) for f in _OCCURRENCE.names], *own])
            rows.append((int(of[a]), zstandard.ZstdCompressor(level=3).compress(pack)))
        texts.clear()
        texts.default_factory = count().__next__
        names.clear()
        occ.clear()
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["part", "pack"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows = batch.column(1).to_numpy(zero_copy_only=False)
        values = batch.column(2).to_pylist()
        for r, (value, wanted, (name, start, size)) in enumerate(zip(values, batch.column(3), segments_of(values))):
            some, short = np.sort(wanted.values.to_numpy().view(np.uint32)), _short(name)
            at = np.flatnonzero(some[np.minimum(np.searchsorted(some, short), len(some) - 1)] == short)
            if not len(at):
                continue
            begin, stretches = len(texts), map(slice, start[at].tolist(), (start[at] + size[at]).tolist())
            index = np.fromiter(map(texts.__getitem__, map(value.__getitem__, stretches)), np.int64, len(at))
            held += int(size[at].sum())
            names.append(name[at[index > np.maximum.accumulate(np.append(begin - 1, index[:-1]))]])  # of new texts, numbered as they come
            out = np.empty(len(at), dtype=_OCCURRENCE)
            out["segment"], out["doc"], out["row"], out["start"] = index, ids[r], rows[r], start[at]
            occ.append(out)
            if held >= SEND:
                yield flush()
                held = 0
    if occ:
        yield flush()


def _portions(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of items of about ``most`` bytes together, an item at least."""
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right")))
        yield begin, end
        begin = end


def _equal(text: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (one at least) at both places are equal."""
    out = np.empty(len(size), dtype=bool)
    for a, b in _portions(size):
        run, at = spans(size[a:b])
        same = text[first[a:b][run] + at] == text[second[a:b][run] + at]
        out[a:b] = np.logical_and.reduceat(same, np.cumsum(size[a:b]) - size[a:b])
    return out


class _Shard:
    """The segments of one shard, on disk, and their answer."""

    def __init__(self) -> None:
        self.segments, self.found, self.text = Spool(_SEGMENT), Spool(_OCCURRENCE), Spool(np.uint8)
        self.keys = Spool(np.uint64)

    def add(self, segments_: np.ndarray, texts: list[bytes], found: np.ndarray) -> None:
        found = found.copy()
        found["segment"] += len(self.segments)
        self.found.append(found)
        self.segments.append(segments_)
        self.keys.append(np.array([xxhash.xxh3_64_intdigest(x) for x in texts], dtype=np.uint64))
        self.text.append(np.frombuffer(b"".join(texts), np.uint8))

    def take(self, other: _Shard) -> None:
        """Move what another shard holds here."""
        base = len(self.segments)
        for mine, its in ((self.found, other.found), (self.segments, other.segments), (self.keys, other.keys), (self.text, other.text)):
            for begin in range(0, len(its), 1 << 20):
                x = its.read(begin, begin + (1 << 20))
                if mine is self.found:
                    x = x.copy()
                    x["segment"] += base
                mine.append(x)
            its.close()

    def answer(self) -> Iterator[pa.RecordBatch]:
        """(doc, row, from, to): the bytes to remove, a run for each stretch of covered windows of an occurrence."""
        if not len(self.segments):
            return
        seg, keys, text = self.segments.mapped(), np.asarray(self.keys.mapped()), np.asarray(self.text.mapped())
        name, size, least = np.asarray(seg["name"]), np.asarray(seg["size"]), np.asarray(seg["least"])
        offset = np.cumsum(size) - size
        # equal texts of different packs are one: the first stands for all
        order = np.lexsort((keys, name))
        n_of, k_of, s_of = name[order], keys[order], size[order]
        same = np.concatenate(([False], (n_of[1:] == n_of[:-1]) & (k_of[1:] == k_of[:-1]) & (s_of[1:] == s_of[:-1])))
        alike = np.flatnonzero(same)  # equal hashes are compared
        same[alike] = _equal(text, offset[order[alike - 1]], offset[order[alike]], s_of[alike])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        stands = np.empty(len(order), dtype=np.int64)
        stands[order] = order[lead]
        joint = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(joint, stands, least)
        heads = order[~same]
        n_of = name[heads]
        alone = np.concatenate(([True], n_of[1:] != n_of[:-1])) & np.concatenate((n_of[1:] != n_of[:-1], [True])) if len(n_of) else np.zeros(0, bool)
        mixed = np.sort(heads[~alone])
        place = np.full(len(name), -1, dtype=np.int64)  # in the sorted text
        lowest = None
        if len(mixed):
            place[mixed] = np.cumsum(size[mixed] + 1) - size[mixed] - 1
            lowest = self._lowest(mixed, place[mixed], size, offset, joint, text)
        found = self.found
        for begin in range(0, len(found), 1 << 16):
            x = found.read(begin, begin + (1 << 16))
            head = stands[x["segment"]]
            single = place[head] < 0
            y = x[single & (joint[head] < x["doc"])]
            parts = [(y["doc"], y["row"], y["start"], y["start"] + size[y["segment"]])]
            y, head = x[~single], head[~single]
            if len(y):
                windows = size[head] - LENGTH + 1
                of = np.repeat(np.arange(len(y)), windows)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                gone = lowest[place[head][of] + nth] < y["doc"][of]
                edge = gone & np.concatenate(([True], ~gone[:-1] | (of[1:] != of[:-1])))
                end = gone & np.concatenate((~gone[1:] | (of[1:] != of[:-1]), [True]))
                a, b = np.flatnonzero(edge), np.flatnonzero(end)
                parts.append((y["doc"][of[a]], y["row"][of[a]], y["start"][of[a]] + nth[a], y["start"][of[a]] + nth[b] + LENGTH))
            cols = [np.concatenate(c) for c in zip(*parts)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "row", "from", "to"])
        for s in (self.segments, self.found, self.text, self.keys):
            s.close()

    def _lowest(self, mixed, place, size, offset, joint, text) -> np.ndarray:
        """For each place of the joined texts the smallest document that holds the window there."""
        joined = Spool(np.uint8)
        for a, b in _portions(size[mixed] + 1):
            run, at = spans(size[mixed[a:b]] + 1)
            piece = text[np.minimum(offset[mixed[a:b]][run] + at, len(text) - 1)]
            piece[np.cumsum(size[mixed[a:b]] + 1) - 1] = 0
            joined.append(piece)
        joined.append(np.array([255], dtype=np.uint8))
        whole = np.asarray(joined.mapped())
        out = Spool(np.int64)
        for begin in range(0, len(whole), 1 << 20):
            out.append(np.full(min(1 << 20, len(whole) - begin), np.iinfo(np.int64).max))
        if out.file is None:
            lowest = out.read(0, len(out)).copy()
        else:
            out.mapped()
            lowest = np.memmap(out.file, dtype=np.int64, mode="r+", shape=(len(out),))
        ends = place + size[mixed]
        open_, least = Spool(np.int64), None
        for pos, lcp in sorted_suffixes(whole, LENGTH):
            at = np.searchsorted(ends, pos, side="right")
            at = np.minimum(at, len(ends) - 1)
            full = (pos + LENGTH <= ends[at]) & (pos >= place[at])
            group = np.cumsum(lcp < LENGTH)
            pos, group, doc = pos[full], group[full], joint[mixed[at[full]]]
            if least is not None and (lcp < LENGTH).any():  # the open group may end here
                carry = group == 0
                self._close(open_, min([least, *doc[carry].tolist()]), pos[carry], lowest)
                pos, group, doc = pos[~carry], group[~carry], doc[~carry]
                open_, least = Spool(np.int64), None
            if not len(pos):
                continue
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            low = np.minimum.reduceat(doc, first)
            tail = first[-1]
            lowest[pos[:tail]] = np.repeat(low[:-1], np.diff(first))
            least = int(low[-1]) if least is None else min(least, int(low[-1]))
            open_.append(pos[tail:])
        if least is not None:
            self._close(open_, least, np.zeros(0, np.int64), lowest)
        joined.close()
        return lowest

    @staticmethod
    def _close(open_: Spool, least: int, more: np.ndarray, lowest: np.ndarray) -> None:
        for begin in range(0, len(open_), 1 << 20):
            lowest[open_.read(begin, begin + (1 << 20))] = least
        lowest[more] = least
        open_.close()


def _unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(segments, occurrences, texts) of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(pack)
    n, m = struct.unpack_from("<qq", raw)
    at = 16
    new, found = np.empty(n, dtype=_SEGMENT), np.empty(m, dtype=_OCCURRENCE)
    new["name"], new["size"] = np.frombuffer(raw, "<u4", n, at), _numbers(raw, n, at + 4 * n)
    at += 12 * n
    for f in _OCCURRENCE.names:
        found[f] = _numbers(raw, m, at)
        at += 8 * m
    new["least"] = np.iinfo(np.int64).max
    np.minimum.at(new["least"], found["segment"], found["doc"])
    return new, found, raw[at:]


def _into(shards: list[_Shard], packs: list[tuple[np.ndarray, np.ndarray, bytes]]) -> None:
    """Add packs to the shards, by name."""
    if not packs:
        return
    base = np.cumsum([0] + [len(new) for new, _, _ in packs])
    for (_, found, _), b in zip(packs, base.tolist()):
        found["segment"] += b
    new, found, raw = np.concatenate([p[0] for p in packs]), np.concatenate([p[1] for p in packs]), b"".join(p[2] for p in packs)
    ends = np.cumsum(new["size"])
    shard = (new["name"] % np.uint64(len(shards))).astype(np.uint8)
    of = shard[found["segment"]]
    place = np.empty(len(new), dtype=np.int64)
    for k, to in enumerate(shards):
        mine = np.flatnonzero(shard == k)
        place[mine] = np.arange(len(mine))
        own = found[of == k]
        own["segment"] = place[own["segment"]]
        stretches = map(slice, (ends[mine] - new["size"][mine]).tolist(), ends[mine].tolist())
        to.add(new[mine], list(map(raw.__getitem__, stretches)), own)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of all shards of the parts in a partition; packs come sorted by part."""
    now, shards, packs, held = None, [], [], 0
    for batch in batches:
        for k, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != now:
                _into(shards, packs)
                yield from _answers(shards)
                now, shards, packs, held = k, [_Shard() for _ in range(SHARDS)], [], 0
            packs.append(_unpack(pack.as_py()))
            held += len(packs[-1][2])
            if held >= JOIN:  # dealt to the shards together
                _into(shards, packs)
                packs, held = [], 0
    _into(shards, packs)
    yield from _answers(shards)


def _answers(shards: list[_Shard]) -> Iterator[pa.RecordBatch]:
    held = _Shard()
    for shard in shards:
        if len(held.text) + len(shard.text) > JOIN:
            yield from held.answer()
            held = shard
        else:
            held.take(shard)
    yield from held.answer()


def _cut(data: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed); ``runs`` as rows (from, to)."""
    if not len(runs):
        return data, 0, 0
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.concatenate(([True], runs[1:, 0] > reach[:-1])))
    a, b = runs[first, 0], reach[np.append(first[1:], len(runs)) - 1]
    kept = b"".join([data[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(data)])])
    return kept, len(data) - len(kept), len(a)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes of ``text``.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller ``doc_id``; strings
    lie within one document and are those of the input. Null text counts as empty. Rows with a null id keep everything
    and count for no other row; rows of equal id are not smaller than each other. One row per row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    rows = all_rows.filter("doc_id IS NOT NULL")
    named = rows.filter(F.octet_length("data") >= LENGTH)
    parted = named.mapInArrow(lambda it: _names(it, parts), "part int, names binary, docs binary, counts binary")
    shared = parted.groupBy("part").applyInArrow(_shared, "doc_id bigint, name int")
    wanted = shared.groupBy("doc_id").agg(F.collect_list("name").alias("wanted")).withColumnRenamed("doc_id", "id")
    same_id = Window.partitionBy("doc_id").orderBy(F.xxhash64("data"))
    dealt = rows.repartition(parts, "doc_id").withColumn("row", F.dense_rank().over(same_id).cast("bigint"))  # used twice, moved once
    some = dealt.join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "row", "data", "wanted")
    packs = some.mapInArrow(lambda it: _send(it, parts), "part int, pack binary")
    runs = packs.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(_solve, "doc bigint, row bigint, `from` bigint, to bigint")
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("row", "from", "to")).alias("runs"))
    both = dealt.join(runs, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "row", "data", "runs")
    rest = all_rows.filter("doc_id IS NULL").select("doc_id", F.lit(0).cast("bigint").alias("row"), "data", F.lit(None).cast(both.schema["runs"].dataType).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, data, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                data, pairs = data or b"", np.zeros((0, 2), np.int64)
                if own.is_valid:  # runs of all rows of this id
                    whose, begin, end = (own.values.field(k).to_numpy() for k in range(3))
                    pairs = np.stack([begin, end], axis=1)[whose == row]
                kept, removed, spans = _cut(data, pairs)
                out.append((len(data), removed, spans, kept))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.union(rest).mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


@op("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    out = dedup_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
