"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text of each language. A text is parsed greedily into
the longest pieces that occur in the sample; the language that needs the fewest pieces, each priced at the logarithm of
the sample's size, wins.

Texts are compared as UTF-8 bytes of their lower-cased letters, runs of anything else in ASCII count as one blank. They
are parsed in blocks of ``BLOCK`` bytes, so that a long text is many short parses that run side by side; a block's end
costs every language alike. Whole texts are parsed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, held_out, map_texts, op, table, utf8

UNKNOWN = "und"
#: Bounds of the training sample, per language: documents, and bytes of normalised text.
SAMPLE_ROWS, SAMPLE_BYTES = 96, 24_000
BLOCK = 512
#: The score is the posterior that a piece of text of so many bytes gives, all languages being equally likely before.
VOTE_BYTES = 8
#: A text of at least so many bytes at a higher price is in none of the languages.
REJECT_BYTES, REJECT_BITS = 100, 6.0

_LETTER = re.compile(r"[^\W\d_]")
_BLANK = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else _BLANK for c in range(128)]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in alphabetical order, each with its sample of normalised text."""

    languages: tuple[str, ...]
    samples: tuple[bytes, ...]


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each text's length."""
    raw = [utf8(t.lower()) if t else b"" for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    lengths = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(lengths)
    keep = data != _BLANK
    keep[1:] |= data[:-1] != _BLANK
    starts = (ends - lengths)[lengths > 0]
    keep[starts] |= True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], kept[ends] - kept[ends - lengths]


def fit(labelled: DataFrame, key: Column, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn from columns ``text`` and ``lang``; rows where either is null take no part.

    The sample is chosen by a hash of ``key``. Per language it holds at most ``sample_rows`` documents and
    ``sample_bytes`` bytes, whatever the table's size; documents within the bound are preferred to longer ones, of
    which a piece is taken. A hash threshold from the language's row count keeps the ranking small before it shuffles.
    """
    rows = labelled.select(F.col("lang").alias("_lang"), F.xxhash64(key).alias("_h"), F.col("text").alias("_text")).filter("_lang IS NOT NULL")
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not counts:
        return LanguageModel((), ())
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * sample_rows / n)))])
    few = rows.filter(F.pmod("_h", F.lit(1 << 20)) < share[F.col("_lang")] * (1 << 20)).filter(F.col("_text").rlike(r"\p{L}"))
    order = Window.partitionBy("_lang").orderBy(F.length("_text") > sample_bytes, "_h", "_text")
    few = few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample_rows)
    texts: dict[str, list[str]] = {}
    for r in few.select("_lang", "_n", F.substring("_text", 1, sample_bytes).alias("_text")).orderBy("_lang", "_n").collect():
        texts.setdefault(r["_lang"], []).append(r["_text"])
    samples = {}
    for lang in sorted(texts):
        data, lengths = normalised([t + " " for t in texts[lang]])
        samples[lang] = data.tobytes()[:sample_bytes]
    return LanguageModel(tuple(samples), tuple(samples.values()))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts exactly the substrings of ``data``; state 0 is the empty string."""
    go: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in data:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = new
    return go


@lru_cache(maxsize=2)
def _tables(samples: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One transition table for all languages: (byte -> symbol, table, roots, symbols).

    An entry is four times the next state, plus the pieces that the byte completes: the one it cannot prolong, and
    itself if no sample has it.
    """
    used = sorted(set(b"".join(samples)))
    symbol = np.zeros(256, dtype=np.int64)  # symbol 0: a byte that no sample has
    symbol[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    parts, roots, base = [], [], 0
    for sample in samples:
        go = suffix_automaton(sample)
        start = np.full(width, base * 4 + 2, dtype=np.int32)
        for c, q in go[0].items():
            start[symbol[c]] = (base + q) * 4 + 1
        t = np.tile(start, (len(go), 1))
        t[0] = base * 4 + 1
        at = [(p, symbol[c], q) for p, row in enumerate(go) for c, q in row.items()]
        p, c, q = (np.array(x, dtype=np.int64) for x in zip(*at))
        t[p, c] = (base + q) * 4
        parts.append(t)
        roots.append(base)
        base += len(go)
    return symbol, np.concatenate(parts).ravel(), np.array(roots), width


def phrase_counts(texts: list[str | None], samples: tuple[bytes, ...], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(pieces by text and language, normalised bytes by text)."""
    symbol, step, roots, width = _tables(samples)
    data, lengths = normalised(texts)
    data = symbol[data]
    blocks = -(-lengths // block)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(lengths) - lengths)[owner] + nth * block
    size = np.minimum(block, lengths[owner] - nth * block)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    active = np.searchsorted(-size, -np.arange(block), side="left")  # lanes longer than t
    state = np.repeat(roots[:, None] * 4, len(start), axis=1)
    pieces = np.zeros(state.shape, dtype=np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        n = active[t]
        now = step[(state[:, :n] >> 2) * width + data[start[:n] + t]]
        state[:, :n] = now
        pieces[:, :n] += now & 3
    pieces += (state >> 2) != roots[:, None]  # the piece that the end cuts off
    out = np.zeros((len(samples), len(texts)), dtype=np.int64)
    for k in range(len(samples)):
        out[k] = np.bincount(owner, weights=pieces[k], minlength=len(texts)).astype(np.int64)
    return out.T, lengths


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, price in bits per byte and normalised bytes of each text."""
    n, k = len(texts), len(model.languages)
    letters = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], dtype=bool)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n), normalised(texts)[1]
    pieces, lengths = phrase_counts(texts, model.samples)
    price = np.array([math.log2(max(2, len(s))) for s in model.samples])
    bits = pieces * price / np.maximum(lengths, 1)[:, None]
    best = bits.argmin(axis=1)  # ties: the first in alphabetical order
    least = bits[np.arange(n), best]
    score = 1.0 / np.exp2(-VOTE_BYTES * (bits - least[:, None])).sum(axis=1)
    langs = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
    return langs, np.where(letters, score, 0.0), np.where(letters, least, 0.0), lengths


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score, bits (price per byte) and n_bytes (normalised) of the whole ``text``.

    One row per row, repeated rows included. ``und`` with score 0: text null, empty or without a letter, or nothing
    was learned. No other column of ``docs`` is read.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most sample_bytes per language

    def derive(texts: list) -> dict[str, pa.Array]:
        langs, score, bits, size = classify(texts, shipped.value)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "bits": pa.array(bits, pa.float64()), "n_bytes": pa.array(size, pa.int64())}

    schema = columns_of(rows, "_text", "lang_pred string", "score double", "bits double", "n_bytes bigint")
    return map_texts(rows, derive, schema, "_text")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that the operator's query and the pipeline learn from: three of four folds by id."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))


def rejected() -> Column:
    """Over the columns of ``predict``: no language, or a text long enough to judge that no learned language explains.

    Text in a sampled language costs two to four bits a byte, one that mixes several of them up to five and a half, random letters seven and more.
    """
    return (F.col("lang_pred") == UNKNOWN) | ((F.col("n_bytes") >= REJECT_BYTES) & (F.col("bits") > REJECT_BITS))


@op("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs), F.col("doc_id"))
    return predict(docs, model, [F.col("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out")])
