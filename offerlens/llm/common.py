"""Small helpers of the training-data operators: table readers, hold-outs, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import prepare

#: A written table of hashes or ids is broadcast up to so many rows (tens of MB); a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000

OPS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def op(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query of this subpackage."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        OPS[name] = (run, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, pa.Array]], schema: str, text: str = "text", binary: bool = False) -> DataFrame:
    """Replace the text column by the columns that ``fn`` derives from a batch of texts.

    ``schema`` lists the columns of the result: those of ``df`` without the text
    keep their place, those that ``fn`` returns follow. One Arrow batch at a
    time is in memory. ``binary``: texts come as UTF-8 bytes.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(at)
            new = fn((column.cast(pa.binary()) if binary else column).to_pylist())
            kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if i != at]
            arrays = [c for _, c in kept] + list(new.values())
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kept] + list(new))

    return df.mapInArrow(run, schema)


def probe(keys: DataFrame) -> DataFrame:
    """``keys``, a written table of a few narrow columns, to be broadcast if its counted size is within the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, without: str, *more: str) -> str:
    """Schema text of ``df`` without one column and with ``more``."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != without] + list(more))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates (not valid in Spark) become '?'."""
    return text.encode("utf-8", "replace") if text else b""


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For concatenated runs of these lengths: the run of every element and its place in the run."""
    lengths = np.asarray(lengths, dtype=np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(int(lengths.sum()), dtype=np.int64) - first[run]
