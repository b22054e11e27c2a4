"""External induced sorting of the suffixes of one shard, with common-prefix values.

The steps are those of induced sorting in external memory. The S*-suffixes are sorted as tuples of their place and first
bytes, dealt out to disk by leading byte and again by the next one until a bucket fits in memory. From them the
L-suffixes are induced in ascending order and from these the S-suffixes in descending order: a suffix that comes off the
priority queue puts its predecessor back in under the predecessor's first byte. Entries of one first byte arrive in their
final order, so the queue is one disk-backed first-in-first-out file per byte, and all entries that are in the lowest
(highest) file are taken out together. Each entry carries the length of its common prefix with the entry before it in
its file: one more than the smallest value passed since then.

Only the first ``cap`` bytes of a suffix count. The tuples hold more than that, and inducing adds bytes in front, so the
tuples decide every order that matters and the recursion on S*-names ends at its first level.

Memory is bounded by ``RUN`` tuples or ``BATCH`` queue entries; everything else is in temporary files of the task that
vanish with it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 50
#: Bytes that a tuple holds, tuples sorted in memory at once, queue entries taken out at once.
WORDS, RUN, BATCH = 7, 1 << 17, 1 << 18
_ENTRY = np.dtype([("pos", "<i8"), ("lcp", "u1")])
_TUPLE = np.dtype([("pos", "<i8"), ("key", "<u8", (WORDS,))])
_NONE = 256  # no byte: the predecessor of the text's first suffix


class Spool:
    """Records appended at the end and read anywhere; kept in memory while small, then in a temporary file."""

    KEEP = 1 << 15

    def __init__(self, dtype) -> None:
        self.dtype, self.held, self.count, self.stored, self.file = np.dtype(dtype), [], 0, 0, None

    def __len__(self) -> int:
        return self.count

    def append(self, items: np.ndarray) -> None:
        if not len(items):
            return
        self.held.append(np.ascontiguousarray(items, dtype=self.dtype))
        self.count += len(items)
        if self.count - self.stored >= self.KEEP:
            self._store()

    def _store(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed by close()
        self.file.seek(0, 2)
        for x in self.held:
            self.file.write(x.tobytes())
        self.held, self.stored = [], self.count

    def read(self, begin: int, end: int) -> np.ndarray:
        """Records from ``begin`` up to ``end``."""
        if self.file is None:
            whole = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
            self.held = [whole] if len(whole) else []
            return whole[begin:end]
        if end > self.stored:
            self._store()
        self.file.seek(begin * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - begin) * self.dtype.itemsize), dtype=self.dtype)

    def mapped(self) -> np.ndarray:
        """All records as one array, memory-mapped if they are in a file."""
        if self.file is None:
            return self.read(0, self.count)
        self._store()
        self.file.flush()
        return np.memmap(self.file, dtype=self.dtype, mode="r", shape=(self.count,))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.held, self.file = [], None


def _star_places(text: np.ndarray, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of the S*-suffixes, chunk by chunk from the right: smaller than their successor, their predecessor not."""
    n = len(text)
    next_byte, next_small = -1, False  # behind the end comes a byte below all others
    right: int | None = None  # first place of the chunk on the right, if that suffix is S
    for begin in range((n - 1) // chunk * chunk, -1, -chunk):
        t = text[begin : begin + chunk].astype(np.int16)
        d = np.sign(np.append(t[1:], next_byte) - t)
        where = np.where(d != 0, np.arange(len(t)), len(t))
        decides = np.minimum.accumulate(where[::-1])[::-1]
        small = np.append(d, 1 if next_small else -1)[decides] > 0
        at = np.flatnonzero(small[1:] & ~small[:-1]) + 1 + begin
        if right is not None and not small[-1]:
            at = np.append(at, right)
        right = begin if small[0] else None
        next_byte, next_small = int(t[0]), bool(small[0])
        yield at


def _keys(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of the suffixes as big-endian words, zeros behind the end."""
    width = 8 * WORDS
    raw = np.zeros((len(at), width), dtype=np.uint8)
    whole = at <= len(text) - width
    if whole.any():
        raw[whole] = np.lib.stride_tricks.sliding_window_view(text, width)[at[whole]]
    for k in np.flatnonzero(~whole).tolist():  # at most ``width`` places
        raw[k, : len(text) - at[k]] = text[at[k] :]
    return raw.view(">u8").astype(np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common leading bytes of rows of keys."""
    diff = a ^ b
    word = np.argmax(diff != 0, axis=1)
    first = diff[np.arange(len(diff)), word]
    zero_bytes = np.zeros(len(diff), dtype=np.int64)
    for k in range(1, 8):
        zero_bytes += first < np.uint64(1) << np.uint64(64 - 8 * k)
    return np.where(first == 0, 8 * WORDS, 8 * word + zero_bytes)


def _sorted_tuples(spool: Spool, depth: int = 1) -> Iterator[np.ndarray]:
    """Tuples in order; a bucket beyond ``RUN`` is dealt out by its next byte first."""
    if len(spool) <= RUN or depth == 8 * WORDS:
        for begin in range(0, len(spool), max(RUN, 1)):  # at full depth all keys are equal
            x = spool.read(begin, begin + RUN) if len(spool) > RUN else spool.read(0, len(spool))
            yield x[np.lexsort(x["key"].T[::-1])]
    else:
        parts: dict[int, Spool] = {}
        for begin in range(0, len(spool), RUN):
            x = spool.read(begin, begin + RUN)
            _deal(x, (x["key"][:, depth // 8] >> np.uint64(56 - 8 * (depth % 8))) & np.uint64(255), parts)
        spool.close()
        for byte in sorted(parts):
            yield from _sorted_tuples(parts[byte], depth + 1)
    spool.close()


def _deal(items: np.ndarray, byte: np.ndarray, to: dict[int, Spool]) -> None:
    order = np.argsort(byte.astype(np.uint8), kind="stable")
    items, byte = items[order], byte[order]
    cuts = [0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(byte)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            to.setdefault(int(byte[a]), Spool(items.dtype)).append(items[a:b])


class _Queue:
    """The priority queue of one pass: a file per first byte, and what common prefixes have passed since its last entry."""

    def __init__(self, text: np.ndarray, cap: int) -> None:
        self.text, self.cap = text, cap
        self.files: dict[int, Spool] = {}
        self.least = np.zeros(257, dtype=np.uint8)  # nothing in common with an entry that never was
        self.known = np.zeros(257, dtype=bool)  # bytes that have had entries

    def put(self, byte: int, pos: int) -> None:
        self.files.setdefault(byte, Spool(_ENTRY)).append(np.array([(pos, 0)], dtype=_ENTRY))
        self.least[byte] = 255
        self.known[byte] = True

    def length(self, byte: int) -> int:
        return len(self.files[byte]) if byte in self.files else 0

    def induce(self, pos: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        """Pass suffixes in order, each with its common prefix with the one before; predecessors with first bytes low..high go in."""
        before = np.where(pos > 0, self.text[np.maximum(pos - 1, 0)].astype(np.uint16), np.uint16(_NONE))
        m = len(pos)
        levels = [lcp.astype(np.uint8)]
        while 2 << (len(levels) - 1) <= m:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        flat = np.concatenate(levels)
        offset = np.cumsum([0] + [len(x) for x in levels[:-1]])

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # over a..b, which is not empty
            k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            return np.minimum(flat[offset[k] + a], flat[offset[k] + b + 1 - (1 << k)])

        order = np.argsort(before, kind="stable")
        byte = before[order]
        first = np.concatenate(([True], byte[1:] != byte[:-1]))
        start = np.where(first, 0, np.concatenate(([0], order[:-1] + 1)))
        common = least(start, order)
        common[first] = np.minimum(common[first], self.least[byte[first]])
        value = np.minimum(self.cap, common.astype(np.int16) + 1)
        value[first & ~self.known[byte]] = 0
        last = np.flatnonzero(np.append(first[1:], True))
        present = byte[last]
        rest = np.full(len(last), 255, dtype=np.uint8)
        open_ = order[last] < m - 1
        rest[open_] = least(order[last][open_] + 1, np.full(int(open_.sum()), m - 1))
        self.least = np.minimum(self.least, lcp.min().astype(np.uint8))
        self.least[present] = rest
        cuts = np.flatnonzero(first).tolist() + [m]
        for a, b in zip(cuts, cuts[1:]):
            if low <= byte[a] <= high:
                out = np.empty(b - a, dtype=_ENTRY)
                out["pos"], out["lcp"] = pos[order[a:b]] - 1, value[a:b]
                self.files.setdefault(int(byte[a]), Spool(_ENTRY)).append(out)
                self.known[byte[a]] = True


def _prefix(text: np.ndarray, a: int, b: int, cap: int) -> int:
    n = min(cap, len(text) - max(a, b))
    same = text[a : a + n] == text[b : b + n]
    return n if same.all() else int(np.argmin(same))


def sorted_suffixes(text: np.ndarray, cap: int = CAP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes) of all suffixes of ``text`` (bytes) in descending order of their first ``cap`` bytes.

    A common prefix is that with the suffix before it in the stream, at most ``cap``. Suffixes equal in ``cap`` bytes
    come in any order. The text must end in a byte that occurs nowhere else in it (255 in UTF-8 text), so that no suffix
    is another's prefix.
    """
    if not 0 < cap <= min(254, 8 * WORDS):
        raise ValueError("a tuple must hold the bytes that count")
    n = len(text)
    if not n:
        return
    stars: dict[int, Spool] = {}
    for at in _star_places(text):
        for begin in range(0, len(at), RUN):
            x = np.empty(len(at[begin : begin + RUN]), dtype=_TUPLE)
            x["pos"] = at[begin : begin + RUN]
            x["key"] = _keys(text, x["pos"])
            _deal(x, x["key"][:, 0] >> np.uint64(56), stars)
    up = _Queue(text, cap)
    up.put(int(text[n - 1]), n - 1)
    for c in range(256):
        done, last = 0, None
        while done < up.length(c):
            x = up.files[c].read(done, min(up.length(c), done + BATCH))
            done += len(x)
            up.induce(x["pos"], x["lcp"], c, 255)
            last = int(x["pos"][-1])
        if c in stars:
            key = None
            for x in _sorted_tuples(stars.pop(c)):
                head = _common(x["key"][:1], key[None])[0] if key is not None else _prefix(text, last, int(x["pos"][0]), cap) if last is not None else 0
                lcp = np.concatenate(([head], _common(x["key"][1:], x["key"][:-1])))
                up.induce(x["pos"], np.minimum(lcp, cap), c + 1, 255)
                key = x["key"][-1]
    down = _Queue(text, cap)
    for c in range(255, -1, -1):
        done, last = 0, None
        while done < down.length(c):
            x = down.files[c].read(done, min(down.length(c), done + BATCH))
            done += len(x)
            down.induce(x["pos"], x["lcp"], 0, c)
            last = int(x["pos"][-1])
            yield x["pos"], x["lcp"]
        if c in down.files:
            down.files[c].close()
            down.files[c].held = [np.zeros(1, _ENTRY)]  # its length still tells that it had entries
        rest, follow = up.length(c), None
        while rest > 0:
            x = up.files[c].read(max(0, rest - BATCH), rest)[::-1]
            rest -= len(x)
            head = follow if follow is not None else _prefix(text, last, int(x["pos"][0]), cap) if last is not None else 0
            lcp = np.concatenate(([head], x["lcp"][:-1]))
            follow = int(x["lcp"][-1])
            down.induce(x["pos"], lcp, 0, c - 1)
            yield x["pos"], lcp
        if c in up.files:
            up.files[c].close()
