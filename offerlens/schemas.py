"""Table schemas (DDL strings) and closed vocabularies."""

from __future__ import annotations

CAPTURES = (
    "requested_url string, final_url string, status_code int, body binary, text string, "
    "content_type string, content_hash string"
)
EVIDENCE = "struct<source_url:string,excerpt:string,observed_at:string,kind:string,content_hash:string>"
COMPONENT = "struct<status:string,evidence:string,period:string,component:string>"
ACTIVITIES = (
    "provider_id string, provider_name string, title string, url string, source_url string, "
    "external_id string, start_date date, end_date date, lifecycle string, quota_status string, "
    "quota_evidence_complete boolean, review_required boolean, date_confidence string, "
    "conditions_summary string, fetched_at string, content_hash string, seq bigint"
)
ATTEMPTS = (
    "run_id string, provider_id string, provider_name string, source_name string, role string, url string, "
    "ok boolean, fetched_at string, status_code int, final_url string, error string, "
    "discovered_count int, coverage_issue string, seq bigint"
)
RUNS = (
    "run_id string, mode string, started_at string, finished_at string, run_status string, "
    "expected bigint, succeeded bigint, failed bigint, activity_count bigint"
)
FRONTIER = (
    "provider_id string, highest_valid_event_id bigint, scan_frontier_event_id bigint, updated_at string"
)
REGISTRY_JSON = """
schema_version int, timezone string, max_total_pages int,
providers array<struct<
  id:string, name:string, official_domains:array<string>,
  public_status_scope:string, public_status_coverage:string,
  sources:array<struct<
    name:string, role:string, url:string, display_url:string, adapter:string, coverage_scope:string,
    max_links:int, link_patterns:array<string>, minimum_event_id:bigint, bootstrap_end_id:bigint,
    rescan_window:bigint, frontier_buffer:bigint, maximum_probe_ids:bigint>>,
  seeds:array<struct<
    name:string, url:string, fetch_url:string, title:string, adapter:string, external_id:string,
    start_date:string, end_date:string>>>>
"""
SUPPLEMENT_JSON = """
schema_version int, generated_at string, headline string,
highlights array<struct<
  kind:string, provider_id:string, provider_name:string, title:string, summary:string, url:string>>,
supplemental_activities array<struct<
  provider_id:string, title:string, url:string, external_id:string, start_date:string, end_date:string,
  quota_status:string, conditions_summary:string,
  evidence:array<struct<source_url:string,excerpt:string,observed_at:string,kind:string,content_hash:string>>,
  components:array<struct<status:string,evidence:string,period:string,component:string>>>>
"""

# Closed vocabularies of the data model.
LIFECYCLES = ("upcoming", "active", "ended", "cancelled", "unknown")
QUOTA_STATUSES = (
    "not_marked_full",
    "partial_sold_out",
    "sold_out",
    "confirmed_available",
    "unknown_app_only",
    "unknown_source_failure",
)
STATUS_SCOPES = ("public", "partial", "app_only", "unavailable", "unknown")
SECTIONS = ("review_required", "app_only_unknown", "sold_out", "upcoming", "active_public")
PUBLISH_SECTION_ORDER = ("sold_out", "upcoming", "app_only_unknown", "active_public", "review_required")
DISCOVERY_ROLES = ("activity_listing", "activity_probe", "mixed_listing", "taiwanpay_api_listing")
STATUS_MODE_ROLES = (
    "announcement_listing",
    "announcement_detail",
    "mixed_listing",
    "mixed_detail",
    "status_page",
    "taiwanpay_api_listing",
)
STATUS_MODE_ADAPTERS = ("famipay_listing",)
CHECK_GROUPS = {
    "activity_probe": "numeric_probe",
    "status_page": "status",
    "quota_listing_detail": "status",
    "activity_detail": "detail",
    "announcement_detail": "detail",
    "mixed_detail": "detail",
}
DETAIL_ROLE_OF_LISTING = {
    "activity_listing": "activity_detail",
    "announcement_listing": "announcement_detail",
    "mixed_listing": "mixed_detail",
}
DNS_ERROR_MARKERS = (
    "nodename nor servname provided",
    "name or service not known",
    "temporary failure in name resolution",
    "could not resolve host",
    "no address associated with hostname",
)


def require_members(df, column: str, allowed) -> None:
    """Fail when a column holds a value outside its vocabulary (one ``exists``-style probe)."""
    from pyspark.sql import functions as F

    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(column).limit(1)
    row = bad.first()
    if row is not None:
        raise ValueError(f"{column} holds {row[0]!r}, which is not in {sorted(allowed)}")
