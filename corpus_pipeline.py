"""From raw documents to sampled training pieces: five stages, each of them one operator of ``offerlens.llm``.

A stage is (spark, docs, sf_dir) -> DataFrame. Between stages the rows are written as Parquet in the shared folder and
read again, so a lost executor repeats part of one stage only. Each stage pins the session's settings itself (batches
of 256 texts to Python), as it may run on its own. Columns: doc_id, text, lang, source, n_chars; the last
stage adds the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, langid, linededup, pieces, simhash
from offerlens.llm.common import probe, table
from offerlens.session import prepare, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; others, and those without a letter, go."""
    prepare(spark)
    model = langid.fit(langid.learnable(docs), F.col("doc_id"))
    return langid.predict(docs, model, [F.col(c) for c in COLUMNS]).filter(~langid.rejected()).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines go, except the earliest; so do documents of which nothing but blanks stays."""
    prepare(spark)
    out = linededup.dedup_lines(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints the document of the smallest id stays, with all rows of that id; rows without an id stay."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = simhash.near_duplicates(docs)
    gone = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return docs.join(probe(gone), F.col("doc_id") == F.col("_id"), "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, re-parameterised ones included, go."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, with their number and the proof that they decode to the text."""
    prepare(spark)
    return pieces.encoded(docs, pieces.read_pieces(pieces.MODEL), [F.col(c) for c in COLUMNS])


STAGES = [
    ("language identification", language),
    ("line dedup", lines),
    ("near-duplicates", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("piece encoding", encode),
]

#: Stages sample from a lattice and train on text, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
