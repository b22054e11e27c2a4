"""A whole monitoring run as one composition: captures, registry and history to report, changes, gaps and the next state."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators import coverage, extract, keys, periods, quota, report, state
from offerlens.session import staged
from offerlens.sources.captures import gate_captures

FIELDS = ("raw_title", "heading", "text")
#: What a document keeps of its capture.
FACTS = ("provider_id", "provider_name", "external_id", "fetched_at", "content_hash", "seq")
HISTORY = (
    "activity_id", "provider_id", "provider_name", "external_id", "title", "url", "source_url", "start_date", "end_date",
    "quota_status", "quota_evidence_complete", "review_required", "fetched_at", "first_seen_at", "last_seen_at", "seq",
)


@dataclass(frozen=True)
class Run:
    """Results of a run. ``history`` and ``documents`` are the next run's state."""

    mode: str
    report: DataFrame
    summary: DataFrame
    changes: DataFrame
    gaps: DataFrame
    coverage: DataFrame
    history: DataFrame
    documents: DataFrame
    parsed: DataFrame
    quarantined: DataFrame


def read_documents(captures: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(documents of all captures, those that were parsed for it).

    ``known`` holds the documents of earlier captures (url, content_hash, status, error and the parsed fields). A capture
    of an address whose body is the same as then takes its document over; only the others reach the parser. Facts of
    the capture are always the new ones.
    """
    same = ["url", "content_hash"]
    fresh = captures if known is None else captures.join(known.select(*same), same, "left_anti")
    parsed = staged(extract.extract_pages(fresh, "capture_id", "url", "body", FIELDS, FACTS), "parsed")
    if known is None:
        return parsed, parsed
    once = known.select(*same, "status", "error", *FIELDS).dropDuplicates(same)
    carried = captures.select("capture_id", "url", *FACTS).join(once, same).select(*parsed.columns)
    return parsed.unionByName(carried), parsed


def offers_of(documents: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Offers of parsed documents: title, period, lifecycle, quota status and whether a person has to look."""
    rows = extract.resolve_titles(documents.filter("status = 'ok'"))
    rows = quota.assess(periods.resolve_periods(rows, "text"), "text")
    rows = quota.with_review_flag(periods.with_lifecycle(rows, as_of))
    rows = rows.withColumnRenamed("quota_complete", "quota_evidence_complete").withColumn("source_url", F.col("url"))
    return rows.select(*[c for c in HISTORY if c in rows.columns], "lifecycle")


def monitor(
    captures: DataFrame,
    attempts: DataFrame,
    providers: DataFrame,
    sources: DataFrame,
    history: DataFrame,
    as_of: dt.date | str,
    mode: str = "full",
    evidence: DataFrame | None = None,
    documents: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> Run:
    """One run over its captures (capture_id, url, body and ``FACTS``) and attempts, on top of ``history``.

    A status run without any history becomes a full one. Confirmed statuses of the history stay by the sticky rules;
    changes are told from the history as it was; the report is made of the whole history after the run.
    """
    if mode == "status" and not state.is_bootstrapped(history):
        mode = "full"
    accepted, quarantined = gate_captures(captures)
    docs, parsed = read_documents(accepted, documents)
    acts = report.dedupe_activities(keys.with_activity_id(offers_of(docs, as_of)))
    merged = staged(state.merge_sticky(acts, history, evidence, verdicts=verdicts), "merged")
    after = staged(state.upsert(history, merged), "history")
    gaps = coverage.coverage_gaps(attempts, providers, sources, attempts.select("run_id").distinct(), mode=mode)
    judged = coverage.finalize_coverage(coverage.run_coverage(attempts), gaps)
    return Run(
        mode=mode,
        report=report.section_report(after, as_of),
        summary=report.section_summary(after, as_of),
        changes=state.status_changes(history, merged),
        gaps=gaps,
        coverage=coverage.publish_gate(coverage.infer_status(judged)),
        history=after,
        documents=docs,
        parsed=parsed,
        quarantined=quarantined,
    )
