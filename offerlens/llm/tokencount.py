"""Word-piece counts by a linear longest-match automaton.

Greedy segmentation takes the longest vocabulary piece at each place. The pieces form a trie. Each node has a failure
link to the node of what remains of its string once greedy has taken its pieces off the front, and the number of these
pieces. Reading a text then moves down the trie or follows a failure link and adds its count: every character is read
once and no piece is built.

Pieces that start a word begin with a blank. No piece has a blank behind another character, so words count alone and
frequent ones are remembered. A character at which no piece matches counts its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, map_texts, op, table
from offerlens.llm.pieces import MODEL, read_pieces

#: Words remembered by a worker, and their greatest length.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "replace"))


class Counter(dict):
    """Word -> number of greedy pieces."""

    def __init__(self, pieces: tuple[str, ...]) -> None:
        super().__init__()
        self.go: list[dict[str, int]] = [{}]
        ends = {0: False}
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                    ends[nxt] = False
                node = nxt
            ends[node] = True
        self.fail, self.pops = [0] * len(self.go), [0] * len(self.go)
        level = [0]
        while level:  # by depth: links lead to shorter strings
            below = []
            for u in level:
                for c, v in self.go[u].items():
                    below.append(v)
                    if ends[v]:
                        self.pops[v] = 1
                    elif u == 0:
                        self.pops[v] = _bytes(c)
                    else:
                        self.fail[v], self.pops[v] = self._read(self.fail[u], self.pops[u], c)
            level = below

    def _read(self, node: int, count: int, c: str) -> tuple[int, int]:
        """(node, pieces so far) after one more character."""
        go = self.go
        while c not in go[node]:
            if node == 0:
                return 0, count + _bytes(c)
            count += self.pops[node]
            node = self.fail[node]
        return go[node][c], count

    def __missing__(self, word: str) -> int:
        node, count, go = 0, 0, self.go
        for c in word:
            nxt = go[node].get(c)
            if nxt is None:
                node, count = self._read(node, count, c)
            else:
                node = nxt
        while node:
            count += self.pops[node]
            node = self.fail[node]
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count


def usable(texts: tuple[str | None, ...]) -> tuple[str, ...]:
    """The pieces that ordinary text can meet: no control or byte pieces, blanks only in front."""
    return tuple(sorted({t for t in texts if t and " " not in t.lstrip(" ")}))


@lru_cache(maxsize=2)
def _counter(pieces: tuple[str, ...]) -> Counter:
    return Counter(pieces)


def words(text: str) -> list[str]:
    """Words of a text with the blanks before each; the text gets one blank in front."""
    out, held = [], ""
    for part in (" " + text).split(" ")[1:]:
        held += " "
        if part:
            out.append(held + part)
            held = ""
    return out + [held] if held else out


def token_counts(docs: DataFrame, pieces: tuple[str, ...], keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_tokens``, the greedy pieces of the whole ``text``; null and empty texts have none.

    ``pieces``: the vocabulary, words starting with a blank (``usable``). Row by row; repeated rows repeat.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

    def derive(texts: list) -> dict[str, pa.Array]:
        count = _counter(shipped.value).__getitem__
        return {"n_tokens": pa.array([sum(map(count, words(t))) if t else 0 for t in texts], pa.int64())}

    return map_texts(rows, derive, columns_of(rows, "_text", "n_tokens bigint"), "_text")


@op("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), usable(read_pieces(MODEL).texts), [F.col("doc_id"), F.length("text").alias("text_chars")])
