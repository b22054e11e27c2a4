"""Capture scan: raw responses with a size gate; oversized ones are quarantined, not dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens import schemas

MAX_BYTES = 8_000_000


def gate_captures(captures: DataFrame, body: str = "body", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by body size; the hash of the body is filled in where missing."""
    size = F.octet_length(body)
    hashed = captures if "content_hash" in captures.columns else captures.withColumn("content_hash", F.lit(None).cast("string"))
    hashed = hashed.withColumn("body_bytes", size).withColumn(
        "content_hash", F.coalesce("content_hash", F.sha2(F.col(body).cast("binary"), 256))
    )
    small = F.coalesce(F.col("body_bytes") <= max_bytes, F.lit(False))
    return hashed.filter(small), hashed.filter(~small)


def read_captures(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    return gate_captures(spark.read.schema(schemas.CAPTURES).parquet(path), "body", max_bytes)
