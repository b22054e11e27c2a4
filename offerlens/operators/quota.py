"""Quota evidence over documents, structured quota records and status endpoints."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import dates
from offerlens.functions import quota as q
from offerlens.functions.text import sentence_list

assess = q.with_quota


def sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(
        key, F.posexplode(sentence_list(F.coalesce(F.col(text), F.lit("")))).alias("pos", "sentence")
    )


def flag_sentences(sents: DataFrame, pack: q.RulePack = q.ZH_PACK, col: str = "sentence") -> DataFrame:
    """One boolean column per rule family, plus the verdicts ``conditional`` and ``explicit``."""
    s = F.col(col)
    out = sents
    for family in ("sold_out", "app_only", "whole", "partial"):
        out = out.withColumn(f"is_{family}", pack.hits(family, s))
    return out.withColumn("is_conditional", pack.conditional(s)).withColumn(
        "is_explicit", F.col("is_sold_out") & ~F.col("is_conditional")
    )


def components(assessed: DataFrame, key: str) -> DataFrame:
    """Sold-out parts of partially sold-out documents as rows."""
    return assessed.select(key, F.posexplode("quota_components").alias("pos", "c")).select(key, "pos", "c.*")


def with_sold_out_date(assessed: DataFrame, as_of: dt.date | str, event_start: str | None = None) -> DataFrame:
    fallback = F.year(dates.as_date_lit(as_of))
    year = F.coalesce(F.year(F.col(event_start)), fallback) if event_start else fallback
    sold = F.col("quota_status").isin("sold_out", "partial_sold_out")
    return assessed.withColumn("sold_out_date", F.when(sold, q.sold_out_date(F.col("quota_excerpt"), year)))


RECORD_SCHEMA = (
    "struct<success:boolean,data:array<struct<bank_name:string,pay_type:string,left_count:double,"
    "disbursed_time:string,type_text:string>>>"
)


def explode_records(captures: DataFrame, keep: list[str], source: str = "text") -> DataFrame:
    parsed = captures.withColumn("__p", F.from_json(source, RECORD_SCHEMA)).filter("__p.success")
    return parsed.select(*keep, F.posexplode("__p.data").alias("pos", "r")).select(*keep, "pos", "r.*")


def eligible_records(records: DataFrame, pay_type: str = "1") -> DataFrame:
    """Records whose JSON list of payment types contains this one."""
    types = F.from_json("pay_type", "array<string>")
    return records.filter(F.coalesce(F.array_contains(types, pay_type), F.lit(False)))


def quota_from_records(records: DataFrame, offer: str) -> DataFrame:
    """Per-offer counts of sold, available and unknown records and the resulting status.

    Pure conditional counts: map-side combined, so an offer with a third of all
    records still sends one row per task.
    """
    disbursed = F.trim(F.coalesce("disbursed_time", F.lit(""))) != ""
    sold = disbursed | F.coalesce(F.col("left_count") <= 0, F.lit(False))
    open_ = ~sold & F.coalesce(F.col("left_count") > 0, F.lit(False))
    counted = records.groupBy(offer).agg(
        F.count_if(sold).alias("sold_out_count"),
        F.count_if(open_).alias("available_count"),
        F.count_if(~sold & ~open_).alias("unknown_count"),
    )
    s, a, u = (F.col(c) for c in ("sold_out_count", "available_count", "unknown_count"))
    status = (
        F.when((s > 0) & (a == 0) & (u == 0), "sold_out")
        .when(s > 0, "partial_sold_out")
        .when((a > 0) & (u == 0), "confirmed_available")
        .otherwise("not_marked_full")
    )
    return counted.withColumn("quota_status", status).withColumn("quota_evidence_complete", u == 0)


def overlay_api_status(activities: DataFrame) -> DataFrame:
    """Refine ``quota_status`` with the status service's answer.

    Expects ``api_unavailable`` (bool) and the three record counts; NULL means
    the service was not asked. Only an undecided page status is refined.
    """
    undecided = F.col("quota_status") == "not_marked_full"
    gone = F.coalesce("api_unavailable", F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    free = (n("available_count") > 0) & (n("sold_out_count") == 0) & (n("unknown_count") == 0)
    status = (
        F.when(undecided & gone, "unknown_source_failure")
        .when(undecided & free, "confirmed_available")
        .otherwise(F.col("quota_status"))
    )
    complete = (
        F.when(n("unknown_count") > 0, False)
        .when(undecided & gone, False)
        .when(undecided & free, True)
        .otherwise(F.col("quota_evidence_complete"))
    )
    return activities.withColumn("quota_evidence_complete", complete).withColumn("quota_status", status)


def join_status_endpoint(details: DataFrame, statuses: DataFrame, as_of: dt.date | str, key: str = "external_id", ok_code: str = "0000") -> DataFrame:
    """Detail ⟕ public status by event id.

    Expired offers are not asked: their join key is NULL, so they take part in
    no match and are not shuffled for one. A missing or invalid answer for an
    asked offer is a source failure.
    """
    live = F.coalesce(F.col("end_date") >= dates.as_date_lit(as_of), F.lit(True))
    answers = statuses.select(
        F.col(key).alias("__k"), (F.col("code") == ok_code).alias("__valid"), F.trim("full_quota_time").alias("__time")
    )
    asked = details.withColumn("__asked", live).withColumn("__key", F.when(live, F.col(key)))
    joined = asked.join(answers, F.col("__key") == F.col("__k"), "left")
    valid = F.coalesce(F.col("__valid"), F.lit(False))
    return (
        joined.withColumn("full_quota_time", F.when(F.col("__asked") & valid, F.nullif("__time", F.lit(""))))
        .withColumn("api_unavailable", F.col("__asked") & ~valid)
        .withColumn("api_skipped", ~F.col("__asked"))
        .withColumn(
            "notice",
            F.when(
                F.col("full_quota_time").isNotNull(),
                F.concat(F.lit("活動已達上限（官方公開狀態時間："), "full_quota_time", F.lit("）")),
            ),
        )
        .drop("__asked", "__key", "__k", "__valid", "__time")
    )


def exempt(assessed: DataFrame, adapter: str, exempt_adapters: tuple[str, ...] = ("pxmart_campaign_detail",)) -> DataFrame:
    """A page shared with another brand must not inherit that brand's app-only rule."""
    hit = F.coalesce(F.col(adapter).isin(*exempt_adapters), F.lit(False)) & (F.col("quota_status") == "unknown_app_only")
    return (
        assessed.withColumn("__x", hit)
        .withColumn("quota_status", F.when(F.col("__x"), "not_marked_full").otherwise(F.col("quota_status")))
        .withColumn("quota_complete", F.col("__x") | F.col("quota_complete"))
        .withColumn("quota_excerpt", F.when(F.col("__x"), "").otherwise(F.col("quota_excerpt")))
        .drop("__x")
    )


def build_evidence(activities: DataFrame) -> DataFrame:
    """Evidence array: the deciding excerpt (page or status service) and the availability notice.

    Expects ``quota_excerpt, url, fetched_at, content_hash, notice, available_notice, api_url``.
    At most two items per row.
    """
    notice = F.coalesce("notice", F.lit(""))
    api_url = F.coalesce("api_url", "url")
    from_api = (notice != "") & F.col("quota_excerpt").contains(notice)
    item = lambda src, text, kind: F.struct(
        src.alias("source_url"),
        text.alias("excerpt"),
        F.col("fetched_at").alias("observed_at"),
        kind.alias("kind"),
        F.col("content_hash").alias("content_hash"),
    )
    page = F.when(
        F.coalesce("quota_excerpt", F.lit("")) != "",
        item(
            F.when(from_api, api_url).otherwise(F.col("url")),
            F.col("quota_excerpt"),
            F.when(from_api, F.lit("activity_status_api")).otherwise(F.lit("activity_page")),
        ),
    )
    available = F.when(
        F.coalesce("available_notice", F.lit("")) != "",
        item(api_url, F.col("available_notice"), F.lit("activity_status_api")),
    )
    return activities.withColumn("evidence", F.array_compact(F.array(page, available)))


REVIEW_MARK = "monitor_review_required: true"


def with_review_flag(df: DataFrame, text: str = "text") -> DataFrame:
    """Needs a person: weak dates, unknown lifecycle, an explicit mark, a failed source or unknown records."""
    flag = (
        F.col("date_confidence").isin("none", "low")
        | (F.col("lifecycle") == "unknown")
        | F.coalesce(F.col(text).contains(REVIEW_MARK), F.lit(False))
        | (F.col("quota_status") == "unknown_source_failure")
        | (F.coalesce(F.col("unknown_count"), F.lit(0)) > 0 if "unknown_count" in df.columns else F.lit(False))
    )
    return df.withColumn("review_required", flag)
