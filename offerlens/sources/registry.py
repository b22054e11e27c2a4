"""Registry and supplement scans: nested JSON files to small relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens import schemas


@dataclass(frozen=True)
class Registry:
    providers: DataFrame
    domains: DataFrame
    sources: DataFrame
    seeds: DataFrame


def read_registry(spark: SparkSession, path: str) -> Registry:
    """Provider, domain, source and seed tables; any other schema version is refused."""
    raw = spark.read.schema(schemas.REGISTRY_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = raw.filter("schema_version IS NULL OR schema_version <> 1 OR providers IS NULL").limit(1)
    if raw.isEmpty() or not bad.isEmpty():
        raise ValueError("unsupported or invalid source registry")
    p = raw.select(F.posexplode("providers").alias("provider_seq", "p"))
    providers = p.select(
        F.col("p.id").alias("provider_id"),
        "p.name",
        F.coalesce("p.public_status_scope", F.lit("unknown")).alias("public_status_scope"),
        F.coalesce("p.public_status_coverage", F.lit("unknown")).alias("public_status_coverage"),
        F.col("provider_seq").alias("seq"),
    )
    domains = p.select(F.col("p.id").alias("provider_id"), F.explode("p.official_domains").alias("domain"))
    # A position that orders across providers and within one.
    seq = (F.col("provider_seq").cast("bigint") * 1_000_000 + F.col("pos")).alias("seq")
    sources = p.select("provider_seq", F.col("p.id").alias("provider_id"), F.posexplode("p.sources").alias("pos", "s"))
    seeds = p.select("provider_seq", F.col("p.id").alias("provider_id"), F.posexplode("p.seeds").alias("pos", "s"))
    return Registry(
        providers,
        domains,
        sources.select("provider_id", seq, "s.*"),
        seeds.select("provider_id", seq, "s.*"),
    )


def read_supplement(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Curated highlights and offers, each with its position."""
    raw = spark.read.schema(schemas.SUPPLEMENT_JSON).option("multiLine", True).json(path)
    highlights = raw.select(F.posexplode("highlights").alias("seq", "h")).select(F.col("seq").cast("bigint"), "h.*")
    offers = raw.select("generated_at", F.posexplode("supplemental_activities").alias("seq", "a")).select(
        F.col("seq").cast("bigint"), F.col("generated_at").alias("fetched_at"), "a.*"
    )
    return highlights, offers
