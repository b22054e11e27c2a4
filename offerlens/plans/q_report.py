"""Queries over de-duplication, sections, counts and the digest."""

from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.operators import publish, report
from offerlens.plans import q_coverage, q_state
from offerlens.plans.base import QUERIES, AS_OF, LIVE_SQL, Tables, offers, query, text


@query(
    "dedupe_activities",
    """WITH r AS (SELECT l_suppkey, l_partkey, l_returnflag = 'R' AS review_required, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY review_required, seq) AS rn FROM r)
SELECT 's' || l_suppkey AS provider_id, CAST(l_partkey AS VARCHAR) AS external_id, review_required, seq FROM k WHERE rn = 1""",
)
def dedupe_activities(t: Tables):
    rows = t.lineitem.select(
        text("s", F.col("l_suppkey")).alias("provider_id"),
        F.lit("").alias("provider_name"),
        F.col("l_partkey").cast("string").alias("external_id"),
        F.lit("https://x.example.com/").alias("url"),
        F.lit("").alias("title"),
        (F.col("l_returnflag") == "R").alias("review_required"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return report.dedupe_activities(rows).select("provider_id", "external_id", "review_required", "seq")


@query(
    "dedupe_documents",
    """WITH r AS (SELECT d.doc_id, source, sha256(text) AS h, coalesce(quality, 0) = 0 AS review_required FROM documents d LEFT JOIN labels USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY review_required, doc_id) AS rn FROM r) SELECT doc_id, h AS content_hash, review_required FROM k WHERE rn = 1""",
)
def dedupe_documents(t: Tables):
    """Hash first, so the shuffle moves hashes and ids, not texts."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    rows = d.join(t.labels, "doc_id", "left").select(
        "doc_id", "content_hash", (F.coalesce("quality", F.lit(0)) == 0).alias("review_required")
    )
    return report.dedupe_activities(rows, ["content_hash"], "doc_id")


@query("section_report", f"WITH {LIVE_SQL} SELECT seq, provider_name, title, lifecycle, section FROM sectioned WHERE lifecycle <> 'ended'")
def section_report(t: Tables):
    out = report.order_sections(report.section_report(offers(t), AS_OF))
    return out.select("seq", "provider_name", "title", "lifecycle", "section")


@query(
    "section_report_ranked",
    f"""WITH {LIVE_SQL} SELECT seq, section, row_number() OVER (ORDER BY list_position({list(schemas.SECTIONS)}, section), coalesce(start_date, DATE '9999-12-31'), provider_name, title, seq) AS rank
FROM sectioned WHERE lifecycle <> 'ended'""",
)
def section_report_ranked(t: Tables):
    """The order of the whole report as a column."""
    return report.rank_sections(report.section_report(offers(t), AS_OF)).select("seq", "section", "rank")


@query(
    "section_summary",
    f"""WITH {LIVE_SQL} SELECT count(*) FILTER (lifecycle <> 'ended') AS included_non_expired, count(*) FILTER (lifecycle = 'ended') AS expired_excluded,
  count(*) FILTER (lifecycle <> 'ended' AND section = 'active_public') AS active_public, count(*) FILTER (lifecycle <> 'ended' AND section = 'sold_out') AS sold_out_or_partial,
  count(*) FILTER (lifecycle <> 'ended' AND section = 'upcoming') AS upcoming, count(*) FILTER (lifecycle <> 'ended' AND section = 'app_only_unknown') AS app_only_unknown,
  count(*) FILTER (lifecycle <> 'ended' AND section = 'review_required') AS review_required FROM sectioned""",
)
def section_summary(t: Tables):
    return report.section_summary(offers(t), AS_OF)


def shared_offers(t: Tables):
    """Offers whose id is shared by four orders, so identities repeat across sections."""
    return offers(t).withColumn("external_id", F.floor(F.col("seq") / 4).cast("string")).withColumn("provider_id", F.lit("p"))


SHARED_SQL = f"""{LIVE_SQL},
ranked AS (SELECT *, CAST(seq // 4 AS VARCHAR) AS ext, list_position(['sold_out', 'upcoming', 'app_only_unknown', 'active_public', 'review_required'], section) AS sr FROM sectioned WHERE lifecycle <> 'ended'),
flat AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY sr, coalesce(start_date, DATE '9999-12-31'), provider_name, title, seq) AS rn FROM ranked)"""


@query("flatten_sections", f"WITH {SHARED_SQL} SELECT seq, ext AS external_id, section FROM flat WHERE rn = 1")
def flatten_sections(t: Tables):
    flat = report.flatten_sections(report.section_report(shared_offers(t), AS_OF))
    return flat.select("seq", "external_id", "section")


@query("provider_counts", f"WITH {SHARED_SQL} SELECT provider_name, count(*) AS offers FROM flat WHERE rn = 1 GROUP BY provider_name")
def provider_counts(t: Tables):
    return publish.provider_counts(report.section_report(shared_offers(t), AS_OF))


def _count(name: str) -> str:
    return f"(SELECT count(*) FROM ({QUERIES[name].sql}))"


_VERDICT = f"(SELECT max_by(verdict, run_id) FROM ({QUERIES['run_verdicts'].sql}))"


@query(
    "digest",
    f"""WITH {SHARED_SQL}, pc AS (SELECT provider_name, count(*) AS n FROM flat WHERE rn = 1 GROUP BY provider_name)
SELECT {_VERDICT} AS verdict, CASE {_VERDICT} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in publish.VERDICT_LABELS.items())} ELSE {_VERDICT} END AS label,
  (SELECT count(*) FROM sectioned WHERE lifecycle <> 'ended') AS included_non_expired,
  (SELECT count(*) FROM sectioned WHERE lifecycle <> 'ended' AND section = 'sold_out') AS sold_out_or_partial,
  (SELECT string_agg(provider_name || ' ' || n, '、' ORDER BY n DESC, lower(provider_name)) FROM pc) AS providers,
  {_count("status_changes")} AS changes, {_count("coverage_gaps")} AS gaps""",
)
def digest(t: Tables):
    """The last run's verdict with the changes of the history and the gaps of all runs."""
    o = shared_offers(t)
    verdict = q_coverage.run_verdicts(t).agg(F.max_by("verdict", "run_id")).scalar()
    return publish.digest(
        publish.provider_counts(report.section_report(o, AS_OF)),
        report.section_summary(o, AS_OF),
        verdict,
        q_state.status_changes(t),
        q_coverage.coverage_gaps(t),
    )
