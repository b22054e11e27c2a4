"""URL, identity and key operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import urls


def with_canonical_url(df: DataFrame, col: str, base: str | None = None, out: str = "canonical_url") -> DataFrame:
    return df.withColumn(out, urls.canonical_url(F.col(col), F.col(base) if base else None))


def filter_allowed(
    df: DataFrame, url: str, domains: DataFrame, https_only: bool = False, provider: str | None = "provider_id"
) -> DataFrame:
    """Rows whose host is an official domain of their provider, or below one.

    The suffix test becomes array overlap: each host carries its own dot
    suffixes and each provider its domains, so the join is a plain equality on
    the provider and no row is duplicated. ``domains`` is a registry table
    (provider_id, domain); Spark broadcasts it only while it is small.
    """
    norm = F.lower(F.regexp_replace("domain", r"\.+$", ""))
    schemes = ["https"] if https_only else ["http", "https"]
    rows = df.filter(urls.url_scheme(F.col(url)).isin(*schemes))
    overlap = F.arrays_overlap(urls.host_suffixes(urls.url_host(F.col(url))), F.col("__domains"))
    if provider is None:
        known = domains.filter(norm != "").agg(F.collect_set(norm)).scalar()
        return rows.withColumn("__domains", known).filter(overlap).drop("__domains")
    known = domains.filter(norm != "").groupBy(F.col("provider_id").alias(provider)).agg(
        F.collect_set(norm).alias("__domains")
    )
    return rows.join(known, provider).filter(overlap).drop("__domains").select(*df.columns)


def with_external_id(df: DataFrame, col: str, out: str = "external_id") -> DataFrame:
    return df.withColumn(out, urls.external_id(F.col(col)))


def with_event_id(df: DataFrame, col: str, host: str, path: str, out: str = "event_id") -> DataFrame:
    return df.withColumn(out, urls.strict_event_id(F.col(col), host, path))


def event_identifiers(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """One row per (key, identifier); distinct within the row, so no shuffle."""
    return df.select(key, F.explode(urls.event_identifiers(F.col(url), F.col(text))).alias("identifier"))


def with_activity_id(df: DataFrame, policy: str = "store", out: str = "activity_id") -> DataFrame:
    c = {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in ("provider_id", "provider_name", "external_id", "url", "title")}
    provider = c["provider_id"]
    if policy == "digest":
        provider = F.coalesce(F.nullif(c["provider_id"], F.lit("")), F.nullif(c["provider_name"], F.lit("")), F.lit("unknown"))
    identity = urls.identity_text(policy, provider, c["provider_name"], c["external_id"], c["url"], c["title"])
    return df.withColumn(out, urls.activity_id(provider, identity))


def with_content_hash(df: DataFrame, cols: list[str], out: str = "content_hash") -> DataFrame:
    return df.withColumn(out, urls.content_hash(*[F.col(c) for c in cols]))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key. The rank filter is pushed below the shuffle (group limit),
    so a key that holds a third of the rows sends one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def limit_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group in the given order; also limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def reconcile_aliases(history: DataFrame, provider: str, alias_prefix: str, policy: str = "store") -> DataFrame:
    """Rewrite route-prefixed ids of one provider to the bare id; a canonical row beats its alias."""
    bare = F.regexp_replace("external_id", f"(?i)^(?:{alias_prefix})-", "")
    is_alias = (
        (F.col("provider_id") == provider)
        & (bare != F.col("external_id"))
        & (bare != "")
    )
    marked = history.withColumn("__alias", F.coalesce(is_alias, F.lit(False))).withColumn(
        "external_id", F.when(F.col("__alias"), bare).otherwise(F.col("external_id"))
    )
    keyed = with_activity_id(marked, policy)
    return first_by(keyed, ["activity_id"], [F.col("__alias"), F.col("seq")]).drop("__alias")
