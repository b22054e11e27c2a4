"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, units after a number and names (capitalised words inside a sentence) become typed
placeholders. Windows of ``WINDOW`` template tokens of the benchmark are hash-joined with those of the documents, so a
question whose numbers or names were replaced still meets its template. The replaced values must be consistent: within a
connected run of windows every value of the item stands for one value of the document; two values of the item may become
one. This is compared for every item that has the windows. Items of one template and one equality pattern throughout are
kin and cost one row.

A text is read up to three times: with the capitalised words inside sentences as names, with all capitalised words as
names, and as plain lower-cased words, which finds copies in other case. A plain window is a verbatim copy and always
counts, whatever stands around it; values decide between template windows only.

A fixed-size bitmap of the benchmark's window hashes goes to all tasks and keeps nearly all other windows from being
shuffled; the join decides. A larger benchmark makes it pass more, never less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, op, probe, spare, table
from offerlens.session import staged

#: Tokens of a window. Shorter items are one window; below ``LEAST`` tokens a template says too little, and only plain words are compared.
WINDOW, LEAST = 8, 5
#: Words that must be literal in a template window; plain windows need none.
LITERAL_SHARE = 0.5
BITS = 24

# Words for units and for small numbers.
UNITS = (
    "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "inch", "inches", "foot", "feet", "yard", "yards",
    "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups", "second", "seconds", "minute", "minutes", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees",
)
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million")

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_WORD, _NUMBER, _UNIT, _NAME, _STOP = range(5)
_INSIDE, _ANYWHERE, _PLAIN = range(3)
_PLACE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], dtype=np.uint64)
_MULT = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


class _Codes(dict):
    """Token -> hash with its kind in the low three bits; cleared when full, as it can be rebuilt."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        low = token.lower()
        if low in ".!?\n":
            kind = _STOP
        elif low[0].isdigit() or low in NUMBER_WORDS:
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif token != low and token[1:] == low[1:]:
            kind = _NAME
        else:
            kind = _WORD
        self[token] = code = (xxhash.xxh64_intdigest(low) & ~7) | kind
        return code


_CODES = _Codes()


def readings(text: str | None) -> tuple[list[str], list[tuple]]:
    """The tokens of a text, and (reading, hashes, kinds, first token of each) of its templates and of its plain words.

    The first word of a sentence may be a name or not: ``_INSIDE`` takes it as a word, ``_ANYWHERE`` takes every
    capitalised word as a name and is left out if it would be the same.
    """
    tokens = _TOKEN.findall(text) if text else []
    codes = np.array([_CODES[t] for t in tokens], dtype=np.uint64)
    kind = (codes & np.uint64(7)).astype(np.int8)
    if not len(codes):
        return tokens, []
    low = codes & ~np.uint64(7)
    before = np.concatenate(([_STOP], kind[:-1]))
    kind[(kind == _UNIT) & (before != _NUMBER)] = _WORD
    first = (kind == _NAME) & (before == _STOP)
    at = np.flatnonzero(kind != _STOP)
    out = [(_PLAIN, low[at] * _PLACE[_NUMBER], kind[at], at)]
    for reading in (_INSIDE, _ANYWHERE) if first.any() else (_INSIDE,):
        kinds = np.where(first, _WORD, kind) if reading == _INSIDE else kind
        keep = kinds != _STOP
        keep[1:] &= ~((kinds[1:] == _NAME) & (kinds[:-1] == _NAME))  # a name of several words is one slot
        at = np.flatnonzero(keep)
        kinds = kinds[at]
        out.append((reading, np.where(kinds == _WORD, low[at], _PLACE[kinds]), kinds, at))
    return tokens, out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + len(total)] * _MULT[k]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def _slots(kind: np.ndarray, at: np.ndarray, tokens: list[str], begin: int, size: int) -> list[str]:
    """Lower-cased values of a window's placeholders, in order."""
    out = []
    for k in range(begin, begin + size):
        if kind[k] != _WORD:
            end = int(at[k]) + 1
            while kind[k] == _NAME and end < len(tokens) and _CODES[tokens[end]] & 7 == _NAME:
                end += 1
            out.append(" ".join(tokens[int(at[k]) : end]).lower())
    return out


def _pattern(slots: list[str]) -> str:
    """Which slots are equal: the place of each value's first occurrence."""
    return ",".join(str(slots.index(s)) for s in slots)


def _kin(tokens: list[str], read: list[tuple]) -> int:
    """Equal for texts of equal templates whose slots are equal at the same places."""
    parts = [h.tobytes() + _pattern(_slots(kind, at, tokens, 0, len(kind))).encode() for reading, h, kind, at in read if reading != _PLAIN]
    return xxhash.xxh64_intdigest(b"|".join(parts)) - (1 << 63)


_NEW = pa.schema([(n, pa.int32()) for n in ("reading", "pos", "begin", "end", "size")] + [("kin", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])
_WINDOW_COLUMNS = ("reading int", "pos int", "begin int", "end int", "size int", "kin bigint", "hash bigint", "slots array<string>")


def _windows(df: DataFrame, sizes: dict[bool, tuple[int, ...]] | None, sieve=None) -> DataFrame:
    """Columns of ``df`` without ``_text`` and one row per window; with ``sizes`` None the benchmark's own windows.

    ``sizes`` are those of plain windows (True) and of template windows (False). ``begin`` and ``end`` are the first and
    last token of a window in the text, ``pos`` its place in the reading.
    """
    names = [c for c in df.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None if sieve is None else np.unpackbits(np.frombuffer(sieve.value, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            rows: list[tuple] = []
            for r, text in enumerate(batch.column(batch.schema.get_field_index("_text")).to_pylist()):
                tokens, read = readings(text)
                kin = _kin(tokens, read) if sizes is None else 0
                for reading, hashes, kind, at in read:
                    own = (min(len(hashes), WINDOW),) if sizes is None else sizes[reading == _PLAIN]
                    for size in own:
                        if size < (1 if reading == _PLAIN else LEAST) or size > len(hashes):
                            continue
                        h = window_hashes(hashes, size)
                        if mask is None and reading == _PLAIN:
                            hits = np.arange(len(h))
                        elif mask is None:
                            literal = np.convolve(kind == _WORD, np.ones(size, dtype=np.int64), "valid")
                            hits = np.flatnonzero(literal >= LITERAL_SHARE * size)
                        else:
                            hits = np.flatnonzero(mask[h >> np.uint64(64 - BITS)])
                        for k in hits.tolist():
                            end = int(at[k + size]) if k + size < len(at) else len(tokens)
                            slots = [] if reading == _PLAIN else _slots(kind, at, tokens, k, size)
                            rows.append((r, reading, k, int(at[k]), end - 1, size, kin, int(h[k].view(np.int64)), slots))
            if rows:
                r, *new = zip(*rows)
                take = pa.array(r, pa.int64())
                kept = [batch.column(batch.schema.get_field_index(c)).take(take) for c in names]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, f.type) for c, f in zip(new, _NEW)], names=names + _NEW.names)

    return df.mapInArrow(run, columns_of(df, "_text", *_WINDOW_COLUMNS))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, n_windows) of the rows of ``docs`` whose text holds part of an item of ``benchmark``.

    ``row`` is ``xxhash64(doc_id, text)``, which tells rows of one id apart; equal rows are one. ``item_id`` is the item
    that most windows match, the smallest of such, ``n_windows`` the distinct windows of the text that match. Items of under ``LEAST`` tokens are
    found word for word only. Items without a token take no part; nor do null and empty texts.
    """
    spark = docs.sparkSession
    items = _windows(benchmark.select("item_id", F.col("text").alias("_text")), None)
    key = ["size", "hash"]
    items = items.groupBy(*key, "kin", F.col("reading").alias("ireading"), F.col("pos").alias("ipos")).agg(F.min(F.struct("item_id", F.col("slots").alias("islots"))).alias("item"))
    items = staged(items, "benchmark")
    some = items.select((F.col("ireading") == _PLAIN).alias("plain"), "size").distinct().collect()  # at most 2 * WINDOW rows
    sizes = {plain: tuple(sorted(r["size"] for r in some if r["plain"] == plain)) for plain in (True, False)}
    place = F.shiftrightunsigned("hash", 64 - BITS)
    words = items.groupBy(F.shiftrightunsigned(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) % 64 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for r in words.collect():  # at most 2 ** (BITS - 6) rows
        bitmap[r["w"]] = r["bits"]
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("_text"))
    hits = _windows(rows, sizes, spark.sparkContext.broadcast(bitmap.tobytes())).drop("kin")
    found = hits.join(items, key).select(*hits.columns, "kin", "ireading", (F.col("pos") - F.col("ipos")).alias("start"), "item.*")
    occurrence = ["doc_id", "row", "kin", "reading", "ireading", "start"]
    along = Window.partitionBy(*occurrence).orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(along) >= F.col("size"), F.lit(True))
    found = found.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(along.rangeBetween(Window.unboundedPreceding, 0)))
    pair = F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d"))
    found = found.groupBy(*occurrence, "run").agg(F.min("item_id").alias("item_id"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"), F.collect_set(F.struct("begin", "end")).alias("at"))
    good = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs")  # plain windows have no pairs
    found = found.filter(good).select("doc_id", "row", "item_id", F.inline("at")).select("doc_id", "row", "item_id", "begin").distinct()
    found = staged(found, "matches")
    most = found.groupBy("doc_id", "row", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "row").agg(F.min(F.struct(-F.col("n"), "item_id"))["item_id"].alias("item_id"))
    count = found.groupBy("doc_id", "row").agg(F.count_distinct("begin").cast("int").alias("n_windows"))
    count = count.withColumnsRenamed({"doc_id": "id", "row": "of"})
    return most.join(count, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("of"))).select("doc_id", "row", "item_id", "n_windows")


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_id, n_windows) for every row of ``docs``; item_id null and n_windows 0 if clean."""
    found = staged(contaminated(docs, benchmark), "contaminated").withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    rows = rows.join(probe(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return rows.select("doc_id", F.col("_row").isNotNull().alias("contaminated"), "item_id", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold benchmark text; columns pass, whatever their names.

    Equal rows stay or go together. Null and empty texts stay, long ones are read whole, and empty tables change nothing.
    """
    whose, which = spare(docs, "_id", "_row")
    found = staged(contaminated(docs, benchmark), "contaminated").select(F.col("doc_id").alias(whose), F.col("row").alias(which))
    return docs.join(probe(found), F.col("doc_id").eqNullSafe(F.col(whose)) & (F.xxhash64("doc_id", "text") == F.col(which)), "left_anti")


@op("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
