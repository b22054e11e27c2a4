"""Queries that write a table through its sink and return what its scan reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions.urls import canonical_url
from offerlens.operators import state
from offerlens.plans.base import OFFERS_SQL, ATTEMPTS_SQL, Tables, attempts, offers, query, text
from offerlens.plans.q_urls import canonical_sql
from offerlens.session import new_table_dir
from offerlens.sources import registry, versions

LAST_RUN = "(SELECT max(strftime(ts, '%Y-%m-%d')) FROM events)"


@query(
    "scan_registry",
    """SELECT 'p' || n_nationkey AS provider_id, CAST(s AS VARCHAR) AS name, CASE s WHEN 'list' THEN 'activity_listing' ELSE 'announcement_listing' END AS role,
  'https://shop' || n_nationkey || '.example.com/' || s AS url, CASE s WHEN 'list' THEN CAST(n_regionkey + 3 AS INTEGER) END AS max_links, n_name AS provider_name,
  'shop' || n_nationkey || '.example.com' AS domain, n_nationkey * 1000000 + CASE s WHEN 'list' THEN 0 ELSE 1 END AS seq FROM nation, (VALUES ('list'), ('news')) v(s)""",
)
def scan_registry(t: Tables):
    """nation rendered as a registry file, read back as tables."""
    n = F.col("n_nationkey")
    url = lambda s: text("https://shop", n, ".example.com/", s)
    sources = F.array(
        F.struct(F.lit("list").alias("name"), F.lit("activity_listing").alias("role"), url("list").alias("url"), (F.col("n_regionkey") + 3).cast("int").alias("max_links")),
        F.struct(F.lit("news").alias("name"), F.lit("announcement_listing").alias("role"), url("news").alias("url"), F.lit(None).cast("int").alias("max_links")),
    )
    provider = F.struct(n.alias("n"), text("p", n).alias("id"), F.col("n_name").alias("name"), F.array(text("shop", n, ".example.com")).alias("official_domains"), sources.alias("sources"))
    whole = t.nation.agg(F.array_sort(F.array_agg(provider)).alias("providers")).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "providers")).alias("value"))
    path = new_table_dir(t.spark, "registry")
    whole.write.text(path)
    reg = registry.read_registry(t.spark, path)
    names = reg.providers.select("provider_id", F.col("name").alias("provider_name"))
    return reg.sources.join(names, "provider_id").join(reg.domains, "provider_id").select(
        "provider_id", "name", "role", "url", "max_links", "provider_name", "domain", "seq"
    )


@query(
    "scan_supplement",
    """SELECT 'highlight' AS kind, CAST(r_regionkey AS BIGINT) AS seq, r_name AS title, CAST(NULL AS VARCHAR) AS generated_at FROM region
UNION ALL SELECT 'offer', n_nationkey, n_name, '2026-01-01' FROM nation""",
)
def scan_supplement(t: Tables):
    """Regions as curated highlights and nations as curated offers, through the supplement file."""
    h = t.region.agg(F.array_sort(F.array_agg(F.struct(F.col("r_regionkey").alias("n"), F.col("r_name").alias("title")))).alias("highlights"))
    o = t.nation.agg(F.array_sort(F.array_agg(F.struct(F.col("n_nationkey").alias("n"), F.col("n_name").alias("title")))).alias("supplemental_activities"))
    row = h.select("highlights", o.scalar().alias("supplemental_activities"))
    path = new_table_dir(t.spark, "supplement")
    row.select(F.to_json(F.struct(F.lit("2026-01-01").alias("generated_at"), "highlights", "supplemental_activities")).alias("value")).write.text(path)
    highlights, offered = registry.read_supplement(t.spark, path)
    return highlights.select(F.lit("highlight").alias("kind"), "seq", "title", F.lit(None).cast("string").alias("generated_at")).unionByName(
        offered.select(F.lit("offer").alias("kind"), "seq", "title", F.col("fetched_at").alias("generated_at"))
    )


def _stored(t: Tables):
    """Settled orders as history of an earlier run."""
    o = offers(t).filter("quota_status = 'sold_out'")
    return o.select(
        F.col("external_id").alias("activity_id"), "provider_name", "title", "url", "quota_status", "external_id", F.lit("d1").alias("first_seen_at"), F.lit("d1").alias("last_seen_at")
    )


def _batch(t: Tables):
    """All orders of the next run; one of two has lost its external id."""
    seen = F.when(F.col("seq") % 2 == 0, F.col("external_id"))
    return offers(t).select(F.col("external_id").alias("activity_id"), "provider_name", "title", "url", "quota_status", seen.alias("external_id"), F.lit("d2").alias("fetched_at"))


@query(
    "sink_history",
    f"""WITH {OFFERS_SQL} SELECT external_id AS activity_id, {canonical_sql('url')} AS url, CASE WHEN quota_status = 'sold_out' THEN 'd1' ELSE 'd2' END AS first_seen_at, 'd2' AS last_seen_at,
  CASE WHEN quota_status = 'sold_out' OR seq % 2 = 0 THEN external_id END AS external_id, 2 AS versions FROM offers""",
)
def sink_history(t: Tables):
    """Two committed versions of the history; the second is an upsert of a whole run, scanned in order."""
    base = new_table_dir(t.spark, "history")
    first = versions.read_state(t.spark, base, "activities")
    assert first is None
    versions.commit_run(t.spark, base, 1, {"activities": _stored(t)})
    stored = versions.read_state(t.spark, base, "activities")
    versions.commit_run(t.spark, base, 2, {"activities": state.upsert(stored, _batch(t))})
    rows = state.load_history(versions.read_state(t.spark, base, "activities"))
    return rows.select("activity_id", "url", "first_seen_at", "last_seen_at", "external_id", F.lit(len(versions.versions(t.spark, base))).alias("versions"))


@query(
    "sink_history_buckets",
    f"""WITH {OFFERS_SQL}, d AS (SELECT max(start_date) AS last FROM offers)
SELECT external_id AS activity_id, {canonical_sql('url')} AS url, CASE WHEN quota_status = 'sold_out' THEN 'd1' ELSE 'd2' END AS first_seen_at,
  CASE WHEN start_date = last THEN 'd2' ELSE 'd1' END AS last_seen_at FROM offers, d WHERE quota_status = 'sold_out' OR start_date = last""",
)
def sink_history_buckets(t: Tables):
    """A history in buckets: the second run, of the last day's offers, rewrites only the buckets of its keys."""
    base = new_table_dir(t.spark, "history")
    versions.commit_buckets(base, 1, "activities", _stored(t).withColumn("url", canonical_url(F.col("url"))), "activity_id", lambda _, rows: rows)
    last = offers(t).agg(F.max("start_date")).scalar()
    day = offers(t).filter(F.col("start_date") == last).select(F.col("external_id").alias("activity_id"))
    batch = _batch(t).join(day, "activity_id", "left_semi")
    none = _stored(t).limit(0)
    versions.commit_buckets(base, 2, "activities", batch, "activity_id", lambda old, rows: state.upsert(none if old is None else old, rows))
    return versions.read_buckets(t.spark, base, "activities").select("activity_id", "url", "first_seen_at", "last_seen_at")


@query(
    "sink_frontier",
    """SELECT 'p' || n_nationkey AS provider_id, CAST(CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS BIGINT) AS highest_valid_event_id,
  CASE WHEN n_regionkey = 1 THEN 'd2' ELSE 'd1' END AS updated_at FROM nation""",
)
def sink_frontier(t: Tables):
    """Frontier state by provider: the providers of one region advance, the others stay."""
    n, base = F.col("n_nationkey").cast("bigint"), new_table_dir(t.spark, "frontier")
    old = t.nation.select(text("p", n).alias("provider_id"), n.alias("highest_valid_event_id"), F.lit("d1").alias("updated_at"))
    new = t.nation.filter("n_regionkey = 1").select(text("p", n).alias("provider_id"), (n + 100).alias("highest_valid_event_id"), F.lit("d2").alias("updated_at"))
    versions.commit_run(t.spark, base, 1, {"frontier": old})
    versions.commit_run(t.spark, base, 2, {"frontier": state.upsert(versions.read_state(t.spark, base, "frontier"), new, key="provider_id")})
    return versions.read_state(t.spark, base, "frontier")


@query(
    "sink_attempt_facts",
    f"WITH {ATTEMPTS_SQL} SELECT run_id, provider_id, role, url, ok, seq FROM attempts WHERE run_id = {LAST_RUN} UNION ALL SELECT 'first' AS run_id, provider_id, role, url, ok, seq FROM attempts",
)
def sink_attempt_facts(t: Tables):
    """Attempt facts of two runs, one of them written twice."""
    path, cols = new_table_dir(t.spark, "attempts"), ["run_id", "provider_id", "role", "url", "ok", "seq"]
    a = attempts(t).select(*cols)
    run = a.agg(F.max("run_id")).first()[0]
    for name, rows in ((run, a.filter(F.col("run_id") == run)), ("first", a), ("first", a)):
        versions.append_fact(rows, path, name)
    return t.spark.read.option("basePath", path).schema(a.schema).parquet(path).select(*cols)


@query(
    "sink_run_facts",
    f"WITH {ATTEMPTS_SQL} SELECT run_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded FROM attempts GROUP BY run_id",
)
def sink_run_facts(t: Tables):
    """One fact row per run, committed as a partitioned table with its run."""
    base = new_table_dir(t.spark, "runs")
    facts = attempts(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if("ok").alias("succeeded"))
    versions.commit_run(t.spark, base, 1, {"runs": facts}, {"runs": ["run_id"]})
    again = versions.commit_run(t.spark, base, 1, {"runs": facts.limit(0)})
    assert not again
    return versions.read_state(t.spark, base, "runs").withColumn("run_id", F.date_format("run_id", "yyyy-MM-dd")).select("run_id", "expected", "succeeded")


@query("sink_report_latest", f"WITH {OFFERS_SQL} SELECT 'r2' AS run_id, seq, title, quota_status FROM offers")
def sink_report_latest(t: Tables):
    """Reports of two runs; the latest is the last one whose marker was written."""
    path = new_table_dir(t.spark, "report")
    rows = offers(t).select("seq", "title", "quota_status")
    versions.write_report(rows.filter("quota_status = 'sold_out'"), path, "r1")
    versions.write_report(rows, path, "r2")
    return versions.read_latest_report(t.spark, path, rows.schema)


@query("sink_catalogue", f"WITH {OFFERS_SQL} SELECT seq, title, quota_status, CAST(max_reward_percent AS DOUBLE) AS max_percent FROM offers")
def sink_catalogue(t: Tables):
    path = new_table_dir(t.spark, "catalogue")
    rows = offers(t).select("seq", "title", "quota_status", F.struct(F.col("max_reward_percent").cast("double").alias("max_percent")).alias("insights"))
    versions.write_catalogue(rows, path)
    return t.spark.read.schema(rows.schema).json(path).select("seq", "title", "quota_status", "insights.max_percent")
