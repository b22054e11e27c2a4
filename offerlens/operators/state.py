"""Durable history: sticky statuses, evidence carry-over, upserts and the change feed.

Evidence is a fact table ``(activity_id, ord, source_url, excerpt, ...)``
rather than an array, so an offer with unbounded evidence is never one row.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import quota as q
from offerlens.functions.urls import canonical_url

STICKY = ("sold_out", "partial_sold_out")
YIELDING = ("not_marked_full", "unknown_app_only", "unknown_source_failure")


def recheck_targets(history: DataFrame) -> DataFrame:
    """Rows worth visiting again. Predicate and columns reach the Parquet scan."""
    return history.filter(F.col("lifecycle").isin("active", "upcoming", "unknown")).select(
        "provider_id", "provider_name", "external_id", "title", "url", "source_url", "start_date", "end_date"
    )


def status_snapshot(history: DataFrame) -> DataFrame:
    return history.select("activity_id", "quota_status", "lifecycle", "title", "url")


def load_history(history: DataFrame) -> DataFrame:
    return history.orderBy("provider_name", "title")


def is_bootstrapped(history: DataFrame) -> bool:
    return not history.isEmpty()


def pack_hash(pack: q.RulePack = q.ZH_PACK) -> str:
    """Identity of a rule pack: a digest of its families and patterns in order."""
    rules = sorted((family, *patterns) for family, patterns in pack.rules.items())
    return hashlib.sha256(json.dumps(rules, ensure_ascii=False).encode()).hexdigest()


def judge_excerpts(evidence: DataFrame, stored: DataFrame | None = None, pack: q.RulePack = q.ZH_PACK) -> DataFrame:
    """Verdicts (excerpt_hash, pack_hash, quota_status, is_new) of all excerpts of ``evidence``, each under ``pack``.

    ``stored`` holds verdicts of earlier runs (excerpt_hash, pack_hash, quota_status). Only excerpts it has no verdict of
    under this pack are classified; after a rule change these are all of them. Equal excerpts are one; a null
    excerpt has no verdict. The rows are what to store for the next run.
    """
    now = pack_hash(pack)
    excerpts = evidence.filter("excerpt IS NOT NULL").select(F.sha2("excerpt", 256).alias("excerpt_hash"), "excerpt")
    excerpts = excerpts.groupBy("excerpt_hash").agg(F.any_value("excerpt").alias("excerpt"))
    columns = ["excerpt_hash", F.lit(now).alias("pack_hash"), "quota_status"]
    if stored is None:
        return q.with_quota(excerpts, "excerpt", pack).select(*columns, F.lit(True).alias("is_new"))
    known = stored.filter(F.col("pack_hash") == now).select("excerpt_hash", "quota_status")
    fresh = q.with_quota(excerpts.join(known, "excerpt_hash", "left_anti"), "excerpt", pack).select(*columns, F.lit(True).alias("is_new"))
    kept = known.join(excerpts.select("excerpt_hash"), "excerpt_hash", "left_semi").select(*columns, F.lit(False).alias("is_new"))
    return kept.unionByName(fresh)


def conditional_only(prev_evidence: DataFrame, pack: q.RulePack = q.ZH_PACK, verdicts: DataFrame | None = None) -> DataFrame:
    """Per key: does all its stored evidence fail to show a sold-out under today's rules?

    Classified row by row in the scan stage, or looked up in ``verdicts`` (see
    ``judge_excerpts``), then one map-side combined flag per key.
    """
    if verdicts is None:
        judged = q.with_quota(prev_evidence.select("activity_id", "excerpt"), "excerpt", pack)
    else:
        known = verdicts.filter(F.col("pack_hash") == pack_hash(pack)).select("excerpt_hash", "quota_status")
        judged = prev_evidence.select("activity_id", F.sha2("excerpt", 256).alias("excerpt_hash")).join(known, "excerpt_hash", "left")
    sold = F.coalesce(F.col("quota_status").isin(*STICKY), F.lit(False))
    return judged.groupBy("activity_id").agg((~F.bool_or(sold)).alias("conditional_only"))


def merge_sticky(
    batch: DataFrame,
    history: DataFrame,
    prev_evidence: DataFrame | None = None,
    exempt: Column | None = None,
    pack: q.RulePack = q.ZH_PACK,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Batch rows with confirmed history kept.

    A confirmed (partial) sell-out survives absence of the notice, an app-only
    answer or a failed source; app-only survives absence. Evidence that today's
    rules no longer accept is not carried. ``exempt`` marks rows whose earlier
    app-only answer came from a page shared with another brand. ``verdicts``
    spare judging stored evidence again.

    Adds ``previous_status`` (NULL for new keys) and ``carry_evidence``.
    """
    prev = history.select(
        "activity_id",
        F.col("quota_status").alias("previous_status"),
        F.col("quota_evidence_complete").alias("__prev_complete"),
    )
    joined = batch.join(prev, "activity_id", "left")
    if prev_evidence is None:
        joined = joined.withColumn("conditional_only", F.lit(False))
    else:
        wanted = prev_evidence.join(batch.select("activity_id"), "activity_id", "left_semi")
        joined = joined.join(conditional_only(wanted, pack, verdicts), "activity_id", "left")
    retracted = F.coalesce("conditional_only", F.lit(False))
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    was, now = F.col("previous_status"), F.col("quota_status")
    keep_sold = was.isin(*STICKY) & now.isin(*YIELDING) & ~retracted
    keep_app = (was == "unknown_app_only") & (now == "not_marked_full") & ~free
    corrected = free & (was == "unknown_app_only") & (now == "not_marked_full")
    return (
        joined.withColumn("carry_evidence", F.coalesce(was.isNotNull() & ~corrected & ~retracted, F.lit(False)))
        .withColumn(
            "quota_evidence_complete",
            F.when(keep_sold, F.col("__prev_complete")).when(keep_app, False).otherwise(F.col("quota_evidence_complete")),
        )
        .withColumn("quota_status", F.when(keep_sold, was).when(keep_app, "unknown_app_only").otherwise(now))
        .drop("__prev_complete", "conditional_only")
    )


def sticky_status(observations: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    """Status of each key after *all* its observations, as one mergeable aggregate.

    Folding the sticky rules over an ordered sequence depends only on three
    maxima: the last decisive observation (sold out, partial, available), the
    last one that says anything, and the last one at all. So the fold needs no
    ordered window, combines on the map side, ignores arrival order, and runs
    unchanged as a streaming aggregation.
    """
    return sticky_result(
        observations.groupBy(*keys).agg(*sticky_aggregates(status, order)), keys
    )


def sticky_aggregates(status: str, order: list[str]) -> list[Column]:
    s = F.col(status)
    row = F.struct(*order, s.alias("status"))
    decisive = s.isin(*STICKY, "confirmed_available")
    return [
        F.max(F.when(decisive, row)).alias("__decisive"),
        F.max(F.when(s != "not_marked_full", row)).alias("__telling"),
        F.max(row).alias("__last"),
        F.count(F.lit(1)).alias("observations"),
    ]


def sticky_result(aggregated: DataFrame, keys: list[str]) -> DataFrame:
    told, sure = F.col("__telling.status"), F.col("__decisive.status")
    is_last = F.col("__telling") == F.col("__last")
    status = (
        F.when(told.isNull(), "not_marked_full")
        .when(sure.isin(*STICKY), sure)
        .when(is_last, told)
        .when(told == "unknown_app_only", told)
        .otherwise("not_marked_full")
    )
    return aggregated.select(*keys, status.alias("quota_status"), "observations", F.col("__last").alias("last_seen"))


def merge_evidence(current: DataFrame, previous: DataFrame, carry: DataFrame) -> DataFrame:
    """Current evidence plus carried items it lacks, the latter in front and in reverse order.

    ``carry`` lists the keys allowed to keep evidence. Items are the same when
    source and whole excerpt are, compared by digest. ``ord`` sorts the result;
    gaps are harmless.
    """
    same = ["activity_id", "source_url", "__text"]
    digest = F.sha2(F.col("excerpt"), 256)
    missing = (
        previous.join(carry.select("activity_id"), "activity_id", "left_semi")
        .withColumn("__text", digest)
        .join(current.select("activity_id", "source_url", digest.alias("__text")), same, "left_anti")
    )
    rest = [c for c in previous.columns if c not in ("activity_id", "source_url", "ord")]
    unique = missing.groupBy(*same).agg(
        F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in rest]
    )
    low_cur = current.groupBy("activity_id").agg(F.min("ord").alias("__cur"))
    low_prev = previous.groupBy("activity_id").agg(F.min("ord").alias("__prev"))
    placed = (
        unique.join(low_prev, "activity_id")
        .join(low_cur, "activity_id", "left")
        .withColumn("ord", F.coalesce("__cur", F.lit(0)) - 1 - (F.col("ord") - F.col("__prev")))
        .drop("__cur", "__prev")
    )
    return current.unionByName(placed.select(*current.columns))


def merge_components(current: Column, previous: Column) -> Column:
    """Array form for a single offer's few components: missing previous ones in front, reversed."""
    missing = F.filter(previous, lambda c: ~F.array_contains(current, c))
    return F.concat(F.reverse(F.array_distinct(missing)), current)


def upsert(history: DataFrame, batch: DataFrame, seen: str = "fetched_at", key: str = "activity_id") -> DataFrame:
    """Next version of the history: batch rows replace stored ones, first sight and ids are kept, URLs are stored canonical."""
    if "url" in batch.columns:
        batch = batch.withColumn("url", canonical_url(F.col("url")))
    data = [c for c in batch.columns if c != key and c in history.columns]
    taken = dict.fromkeys([*data, *[c for c in (seen,) if c in batch.columns]])
    b = batch.select(key, *[F.col(c).alias(f"__n_{c}") for c in taken], F.lit(True).alias("__new"))
    j = history.join(b, key, "full_outer")
    is_new = F.coalesce("__new", F.lit(False))
    out = []
    for c in history.columns:
        if c == key:
            out.append(F.col(key))
        elif c == "first_seen_at":
            out.append(F.coalesce(F.col(c), F.col(f"__n_{seen}")).alias(c))
        elif c == "last_seen_at":
            out.append(F.when(is_new, F.col(f"__n_{seen}")).otherwise(F.col(c)).alias(c))
        elif c == "external_id" and c in data:
            out.append(F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c))
        elif c in data:
            out.append(F.when(is_new, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def status_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys known before whose status differs after the merge; new keys are not changes."""
    b = before.select("activity_id", F.col("quota_status").alias("from_status"))
    return (
        after.join(b, "activity_id")
        .filter(~F.col("quota_status").eqNullSafe(F.col("from_status")))
        .withColumnRenamed("quota_status", "to_status")
    )
