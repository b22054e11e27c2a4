"""In-run de-duplication, report sections and their counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.functions import dates, urls
from offerlens.operators.keys import first_by
from offerlens.operators.ranking import with_rank

FAR_FUTURE = "9999-12-31"


def dedupe_activities(acts: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """First row of an identity wins, unless it needs review and a clean one exists: then the first clean one."""
    if keys is None:
        identity = urls.identity_text(
            "store", F.col("provider_id"), F.col("provider_name"), F.col("external_id"), F.col("url"), F.col("title")
        )
        acts, keys = acts.withColumn("__identity", identity), ["provider_id", "__identity"]
    out = first_by(acts, keys, [F.col("review_required"), F.col(seq)])
    return out.drop("__identity")


def section() -> Column:
    """Review outranks everything, then app-only, sold out, upcoming; the rest is active."""
    return (
        F.when(
            F.col("review_required")
            | (F.col("lifecycle") == "unknown")
            | (F.col("quota_status") == "unknown_source_failure"),
            "review_required",
        )
        .when(F.col("quota_status") == "unknown_app_only", "app_only_unknown")
        .when(F.col("quota_status").isin("partial_sold_out", "sold_out"), "sold_out")
        .when(F.col("lifecycle") == "upcoming", "upcoming")
        .otherwise("active_public")
    )


def with_section(acts: DataFrame) -> DataFrame:
    return acts.withColumn("section", section())


def section_report(acts: DataFrame, as_of: dt.date | str, cancelled: str | None = None) -> DataFrame:
    """Lifecycle as of the day, ended and cancelled offers out, section assigned."""
    flag = F.col(cancelled) if cancelled else None
    live = acts.withColumn("lifecycle", dates.lifecycle(F.col("start_date"), F.col("end_date"), as_of, flag))
    return with_section(live.filter(~F.col("lifecycle").isin("ended", "cancelled")))


def section_order() -> list[Column]:
    """Within a section: start date (none last), provider, title — binary collation."""
    return [
        F.coalesce("start_date", F.lit(FAR_FUTURE).cast("date")).asc(),
        F.col("provider_name").asc(),
        F.col("title").asc(),
    ]


def order_sections(report: DataFrame) -> DataFrame:
    """Globally sorted report: a range-partitioned sort, not a single-task window."""
    return report.orderBy(section_rank(schemas.SECTIONS), *section_order())


def rank_sections(report: DataFrame, tie: str = "seq") -> DataFrame:
    """The sorted report with each row's ``rank`` (from 1); ``tie`` decides between equal rows."""
    return with_rank(report, [section_rank(schemas.SECTIONS), *section_order(), F.col(tie)])


def section_rank(order: tuple[str, ...] = schemas.PUBLISH_SECTION_ORDER) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section"))


def section_summary(acts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """One row of counts over the whole store."""
    life = dates.lifecycle(F.col("start_date"), F.col("end_date"), as_of)
    staged = acts.withColumn("lifecycle", life).withColumn("section", section())
    live = ~F.col("lifecycle").isin("ended", "cancelled")
    n = lambda name: F.count_if(live & (F.col("section") == name))
    return staged.agg(
        F.count_if(live).alias("included_non_expired"),
        F.count_if(~live).alias("expired_excluded"),
        n("active_public").alias("active_public"),
        n("sold_out").alias("sold_out_or_partial"),
        n("upcoming").alias("upcoming"),
        n("app_only_unknown").alias("app_only_unknown"),
        n("review_required").alias("review_required"),
    )


def flatten_sections(report: DataFrame) -> DataFrame:
    """One row per published identity: the section that publishes first wins, then report order."""
    identity = urls.identity_text(
        "publish", F.col("provider_id"), F.col("provider_name"), F.col("external_id"), F.col("url"), F.col("title")
    )
    live = report.filter(~F.col("lifecycle").isin("ended", "cancelled")).withColumn("identity", identity)
    return first_by(live, ["provider_id", "identity"], [section_rank(), *section_order(), F.col("seq")])
