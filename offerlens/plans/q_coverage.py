"""Queries over run, source and provider coverage."""

from pyspark.sql import functions as F

from offerlens.operators import coverage
from offerlens.plans.base import ATTEMPTS_SQL, REGISTRY_SQL, Tables, attempts, query, registry, text

METRIC_SQL = """greatest(expected - succeeded, 0) AS failed, CASE WHEN expected > 0 THEN round_even(succeeded / expected, 4) ELSE 1.0 END AS rate,
  CASE WHEN expected > 0 AND succeeded = 0 THEN 'unavailable' WHEN succeeded = expected THEN 'complete' ELSE 'partial' END AS status"""

RUN_SQL = f"""{ATTEMPTS_SQL},
agg AS (SELECT run_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded, count(coverage_issue) AS discovery_issues,
  bool_and(contains(lower(error), 'name or service not known')) FILTER (NOT ok) AS dns FROM attempts GROUP BY run_id),
cov AS (SELECT run_id, expected, succeeded, discovery_issues, expected - succeeded AS failed, round_even(succeeded / expected, 4) AS rate,
  CASE WHEN succeeded = 0 THEN 'unavailable' WHEN succeeded = expected THEN 'complete' ELSE 'partial' END AS transport_status,
  succeeded = 0 AND coalesce(dns, false) AS systemic_dns_failure,
  CASE WHEN succeeded = 0 THEN 'unavailable' WHEN succeeded = expected AND discovery_issues = 0 THEN 'complete' ELSE 'partial' END AS status FROM agg)"""


@query("run_coverage", f"WITH {RUN_SQL} SELECT * FROM cov")
def run_coverage(t: Tables):
    return coverage.run_coverage(attempts(t))


@query(
    "systemic_failure",
    f"""WITH {ATTEMPTS_SQL}, g AS (SELECT run_id || '/' || source_name || '/' || provider_id || '/' || role AS unit, * FROM attempts),
agg AS (SELECT unit, count(*) AS expected, count(*) FILTER (ok) AS succeeded, bool_and(contains(lower(error), 'name or service not known')) FILTER (NOT ok) AS dns FROM g GROUP BY unit)
SELECT unit, expected, succeeded = 0 AND coalesce(dns, false) AS systemic_dns_failure FROM agg WHERE succeeded = 0""",
)
def systemic_failure(t: Tables):
    a = attempts(t).withColumn("unit", F.concat_ws("/", "run_id", "source_name", "provider_id", "role"))
    out = coverage.run_coverage(a, by="unit").filter("transport_status = 'unavailable'")
    return out.select("unit", "expected", "systemic_dns_failure")


@query(
    "health_metric",
    f"WITH {ATTEMPTS_SQL}, g AS (SELECT provider_id, role, count(*) AS expected, count(*) FILTER (ok) AS succeeded FROM attempts GROUP BY ALL) SELECT *, {METRIC_SQL} FROM g",
)
def health_metric(t: Tables):
    return coverage.health_metric(attempts(t), ["provider_id", "role"])


@query("status_mode_sources", f"WITH {REGISTRY_SQL} SELECT provider_id, seq, role FROM sources WHERE role = 'announcement_listing'")
def status_mode_sources(t: Tables):
    return coverage.mode_filter(registry(t)[2], "status").select("provider_id", "seq", "role")


MATCH_SQL = f"""{ATTEMPTS_SQL}, {REGISTRY_SQL},
s AS (SELECT *, row_number() OVER (PARTITION BY provider_id, role, name ORDER BY seq) AS rn FROM sources),
a AS (SELECT *, row_number() OVER (PARTITION BY run_id, provider_id, role, source_name ORDER BY seq) AS rn FROM attempts),
matched AS (SELECT a.run_id, a.seq AS attempt_seq, s.seq AS source_seq, a.provider_id, a.role, a.ok
  FROM a JOIN s ON a.provider_id = s.provider_id AND a.role = s.role AND a.source_name = s.name AND a.rn = s.rn),
ext AS (SELECT *, CASE role WHEN 'activity_probe' THEN 'numeric_probe' WHEN 'status_page' THEN 'status' WHEN 'activity_detail' THEN 'detail' ELSE 'other' END AS check_group
  FROM attempts WHERE provider_id IN (SELECT provider_id FROM providers) AND seq NOT IN (SELECT attempt_seq FROM matched))"""


@query("source_attempt_match", f"WITH {MATCH_SQL} SELECT * FROM matched")
def source_attempt_match(t: Tables):
    return coverage.match_sources(registry(t)[2], attempts(t))


@query("extended_checks", f"WITH {MATCH_SQL} SELECT run_id, seq, check_group, ok FROM ext")
def extended_checks(t: Tables):
    providers, _, sources = registry(t)
    a = attempts(t)
    return coverage.extended_checks(a, coverage.match_sources(sources, a), providers).select("run_id", "seq", "check_group", "ok")


HEALTH_SQL = f"""{MATCH_SQL},
runs AS (SELECT DISTINCT run_id FROM attempts),
reg AS (SELECT runs.run_id, count(*) AS expected, count(m.source_seq) AS succeeded FROM runs CROSS JOIN sources
  LEFT JOIN (SELECT DISTINCT run_id, source_seq, provider_id FROM matched WHERE ok) m ON m.run_id = runs.run_id AND m.source_seq = sources.seq AND m.provider_id = sources.provider_id GROUP BY 1),
health0 AS (SELECT run_id, 'registered' AS level, 'all' AS check_group, expected, succeeded FROM reg
  UNION ALL SELECT run_id, 'extended', check_group, count(*), count(*) FILTER (ok) FROM ext GROUP BY 1, 3
  UNION ALL SELECT run_id, 'extended', 'all', count(*), count(*) FILTER (ok) FROM ext GROUP BY 1),
health AS (SELECT *, {METRIC_SQL} FROM health0)"""


def _runs(a):
    return a.select("run_id").distinct()


def _health(t: Tables):
    providers, _, sources = registry(t)
    a = attempts(t)
    return coverage.request_health(sources, a, providers, _runs(a))


@query("request_health", f"WITH {HEALTH_SQL} SELECT run_id, level, check_group, expected, succeeded, failed, rate, status FROM health")
def request_health(t: Tables):
    return _health(t).select("run_id", "level", "check_group", "expected", "succeeded", "failed", "rate", "status")


def mixed_registry(t: Tables):
    """Sources of every form: bare ones before named and addressed ones of the same role, and an id scan."""
    n = F.col("n_nationkey")
    rows = [(0, "", "", "activity_listing", ""), (1, "s0", "", "activity_listing", ""), (2, "", "own", "activity_listing", ""), (3, "", "", "announcement_listing", ""),
            (4, "s2", "", "announcement_listing", ""), (5, "", "", "announcement_listing", ""), (6, "scan", "", "status_page", "fullpay_id_scan")]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, ("no", "name", "url", "role", "adapter"))]) for r in rows]))
    sources = t.nation.select(n, each.alias("s")).select(
        text("p", n).alias("provider_id"), (n.cast("bigint") * 10 + F.col("s.no")).alias("seq"), "s.name", "s.url", "s.role", "s.adapter"
    )
    first = attempts(t).filter("role = 'activity_listing'").groupBy("provider_id").agg(F.min_by("url", "seq").alias("first_url"))
    sources = sources.join(first, "provider_id", "left").withColumn("url", F.when(F.col("url") == "own", F.coalesce("first_url", F.lit("none"))).otherwise(F.col("url")))
    return sources.drop("first_url")


# The walk of the registry, source by source; ``taken`` holds what the sources before took in a run.
_STEPS = ["walk_0 AS (SELECT run_id, provider_id, []::BIGINT[] AS taken FROM (SELECT DISTINCT run_id FROM attempts) CROSS JOIN (SELECT DISTINCT provider_id FROM mixed))"]
for _no in range(6):
    _STEPS.append(
        f"hit_{_no} AS MATERIALIZED (SELECT w.run_id, w.provider_id, m.seq AS source_seq, m.role, min(a.seq) AS attempt_seq, min_by(a.ok, a.seq) AS ok FROM walk_{_no} w JOIN mixed m ON m.provider_id = w.provider_id AND m.no = {_no}"
        f" JOIN attempts a ON a.run_id = w.run_id AND a.provider_id = m.provider_id AND a.role = m.role AND (m.name = '' OR a.source_name = m.name) AND (m.name <> '' OR m.url = '' OR a.url = m.url)"
        f" AND NOT list_contains(w.taken, a.seq) GROUP BY ALL), walk_{_no + 1} AS MATERIALIZED (SELECT w.run_id, w.provider_id, CASE WHEN h.attempt_seq IS NULL THEN taken ELSE list_append(taken, h.attempt_seq) END AS taken"
        f" FROM walk_{_no} w LEFT JOIN hit_{_no} h USING (run_id, provider_id))"
    )
MIXED_SQL = f"""{ATTEMPTS_SQL}, {REGISTRY_SQL},
own AS (SELECT provider_id, min_by(url, seq) AS url FROM attempts WHERE role = 'activity_listing' GROUP BY 1),
mixed AS MATERIALIZED (SELECT p.provider_id, s.no, CAST(substr(p.provider_id, 2) AS BIGINT) * 10 + s.no AS seq, s.name, CASE WHEN s.no = 2 THEN coalesce(own.url, 'none') ELSE '' END AS url, s.role, s.adapter
  FROM providers p CROSS JOIN (VALUES (0, '', 'activity_listing', ''), (1, 's0', 'activity_listing', ''), (2, '', 'activity_listing', ''), (3, '', 'announcement_listing', ''),
    (4, 's2', 'announcement_listing', ''), (5, '', 'announcement_listing', ''), (6, 'scan', 'status_page', 'fullpay_id_scan')) s(no, name, role, adapter) LEFT JOIN own USING (provider_id)),
{", ".join(_STEPS)},
hits AS ({" UNION ALL ".join(f"SELECT run_id, attempt_seq, source_seq, provider_id, role, ok FROM hit_{_no}" for _no in range(6))})"""


@query("source_match_mixed", f"WITH {MIXED_SQL} SELECT * FROM hits")
def source_match_mixed(t: Tables):
    """One-to-one matching where bare, named and addressed sources of a role compete for the same attempts."""
    return coverage.match_sources(mixed_registry(t).filter("adapter = ''"), attempts(t))


def _mode_sql(mode: str, roles: str) -> str:
    own = f"(SELECT * FROM hits WHERE role IN ({roles}))"
    return f"""SELECT '{mode}' AS mode, run_id, 'registered' AS level, 'all' AS check_group, (SELECT count(*) FROM mixed WHERE role IN ({roles})) AS expected,
    (SELECT count(*) FROM {own} h WHERE h.run_id = r.run_id AND ok) + (SELECT count(*) FROM scans s JOIN mixed m USING (provider_id) WHERE s.run_id = r.run_id AND complete AND adapter <> '' AND role IN ({roles})) AS succeeded FROM r
  UNION ALL SELECT '{mode}', run_id, 'extended', coalesce(check_group, 'all'), count(*), count(*) FILTER (ok) FROM (SELECT *, CASE role WHEN 'activity_probe' THEN 'numeric_probe' WHEN 'status_page' THEN 'status' WHEN 'activity_detail' THEN 'detail' ELSE 'other' END AS check_group
    FROM attempts WHERE provider_id IN (SELECT provider_id FROM providers) AND seq NOT IN (SELECT attempt_seq FROM {own})) GROUP BY GROUPING SETS ((run_id, check_group), (run_id))"""


@query(
    "request_health_modes",
    f"""WITH {MIXED_SQL}, r AS (SELECT DISTINCT run_id FROM attempts), scans AS (SELECT run_id, provider_id, bool_and(ok) AS complete FROM attempts WHERE role = 'activity_probe' GROUP BY ALL),
h AS ({_mode_sql("full", "'activity_listing', 'announcement_listing', 'status_page'")} UNION ALL {_mode_sql("status", "'announcement_listing', 'status_page'")})
SELECT mode, run_id, level, check_group, expected, succeeded, {METRIC_SQL} FROM h""",
)
def request_health_modes(t: Tables):
    """Request health of full and of status runs; a scan source is as good as its provider's probes of the run."""
    a, providers, sources = attempts(t), registry(t)[0], mixed_registry(t)
    scans = a.filter("role = 'activity_probe'").groupBy("run_id", "provider_id").agg(F.bool_and("ok").alias("complete"))
    parts = [coverage.request_health(sources, a, providers, _runs(a), mode, scans).withColumn("mode", F.lit(mode)) for mode in ("full", "status")]
    return parts[0].unionByName(parts[1]).select("mode", "run_id", "level", "check_group", "expected", "succeeded", "failed", "rate", "status")


GAPS_SQL = f"""{HEALTH_SQL},
scope AS (SELECT p.provider_id, count(s.seq) AS n, count(*) FILTER (s.seq IS NOT NULL AND coalesce(s.coverage_scope, 'complete') = 'complete') AS complete, min_by(s.url, s.seq) AS url
  FROM providers p LEFT JOIN (SELECT * FROM sources WHERE role = 'activity_listing') s USING (provider_id) GROUP BY 1),
found AS (SELECT run_id, provider_id, CAST(sum(discovered_count) AS BIGINT) AS found FROM attempts WHERE role IN ('activity_listing', 'activity_probe') GROUP BY ALL),
gaps AS (SELECT run_id, provider_id, source_name, url, coverage_issue AS issue, CAST(discovered_count AS BIGINT) AS discovered_count FROM attempts WHERE coverage_issue IS NOT NULL
  UNION ALL SELECT run_id, provider_id, '業者活動發現來源', '', 'no_verified_activity_listing', 0 FROM runs CROSS JOIN scope WHERE n = 0
  UNION ALL SELECT runs.run_id, scope.provider_id, '官方主題活動總覽與關聯圖', url, 'partial_public_activity_discovery', coalesce(found, 0)
    FROM runs CROSS JOIN scope LEFT JOIN found ON found.run_id = runs.run_id AND found.provider_id = scope.provider_id WHERE n > 0 AND complete = 0)"""


def _gaps(t: Tables):
    providers, _, sources = registry(t)
    a = attempts(t)
    return coverage.coverage_gaps(a, providers, sources, _runs(a))


@query("coverage_gaps", f"WITH {GAPS_SQL} SELECT * FROM gaps")
def coverage_gaps(t: Tables):
    return _gaps(t)


PROVIDER_SQL = f"""{GAPS_SQL},
c AS (SELECT run_id, provider_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded, bool_or(NOT ok AND role IN ('activity_listing', 'activity_probe')) AS ff FROM attempts GROUP BY ALL),
g AS (SELECT run_id, provider_id, count(*) AS n, list(DISTINCT issue) AS kinds FROM gaps GROUP BY ALL),
pc AS (SELECT runs.run_id, p.provider_id, p.name, CASE WHEN public_status_scope = 'odd' THEN 'unknown' ELSE public_status_scope END AS public_status_scope,
  coalesce(expected, 0) AS expected, coalesce(succeeded, 0) AS succeeded, coalesce(expected, 0) - coalesce(succeeded, 0) AS failed,
  coalesce(n, 0) + CASE WHEN coalesce(ff, false) THEN 1 ELSE 0 END AS gap_count,
  array_to_string(list_sort(CASE WHEN coalesce(ff, false) THEN list_append(coalesce(kinds, []), 'source_fetch_failed') ELSE coalesce(kinds, []) END), ',') AS gap_kinds
  FROM runs CROSS JOIN providers p LEFT JOIN c ON c.run_id = runs.run_id AND c.provider_id = p.provider_id LEFT JOIN g ON g.run_id = runs.run_id AND g.provider_id = p.provider_id)"""


@query("provider_coverage", f"WITH {PROVIDER_SQL} SELECT *, CASE WHEN gap_count > 0 THEN 'limited' ELSE 'complete' END AS discovery_status FROM pc")
def provider_coverage(t: Tables):
    a = attempts(t)
    out = coverage.provider_coverage(a, _gaps(t), registry(t)[0], _runs(a))
    return out.withColumn("gap_kinds", F.array_join("gap_kinds", ","))


FINAL_SQL = f"""{GAPS_SQL.replace("WITH ", "")}, ng AS (SELECT run_id, count(*) AS n FROM gaps GROUP BY 1),
agg AS (SELECT run_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded, bool_and(contains(lower(error), 'name or service not known')) FILTER (NOT ok) AS dns, count(coverage_issue) AS di FROM attempts GROUP BY run_id),
cov AS (SELECT run_id, expected, succeeded, expected - succeeded AS failed, CASE WHEN succeeded = 0 THEN 'unavailable' WHEN succeeded = expected THEN 'complete' ELSE 'partial' END AS transport_status,
  succeeded = 0 AND coalesce(dns, false) AS systemic_dns_failure, CASE WHEN succeeded = 0 THEN 'unavailable' WHEN succeeded = expected AND di = 0 AND coalesce(n, 0) = 0 THEN 'complete' ELSE 'partial' END AS status,
  coalesce(n, 0) AS discovery_issues FROM agg LEFT JOIN ng USING (run_id))"""


@query(
    "run_verdicts",
    f"""WITH {FINAL_SQL} SELECT run_id, status, discovery_issues, CASE WHEN transport_status = 'unavailable' OR systemic_dns_failure THEN 'failed' WHEN failed > 0 OR discovery_issues > 0 THEN 'partial' ELSE 'success' END AS verdict,
  transport_status <> 'unavailable' AS may_publish, systemic_dns_failure AS retry_once FROM cov""",
)
def run_verdicts(t: Tables):
    final = coverage.finalize_coverage(coverage.run_coverage(attempts(t)), _gaps(t))
    out = coverage.publish_gate(coverage.infer_status(final))
    return out.select("run_id", "status", "discovery_issues", "verdict", "may_publish", "retry_once")


@query(
    "source_health",
    f"""WITH {FINAL_SQL} SELECT c.run_id, c.expected, c.succeeded, r.expected AS official_expected, r.succeeded AS official_succeeded, r.failed AS official_failed,
  coalesce(e.failed, 0) AS extended_failed, discovery_issues AS needs_review,
  CASE WHEN r.expected > 0 AND r.succeeded = 0 THEN 'unavailable' WHEN r.failed = 0 AND coalesce(e.failed, 0) = 0 AND discovery_issues = 0 THEN 'normal' ELSE 'partial' END AS health
FROM cov c JOIN health r ON r.run_id = c.run_id AND r.level = 'registered' LEFT JOIN health e ON e.run_id = c.run_id AND e.level = 'extended' AND e.check_group = 'all'""",
)
def source_health(t: Tables):
    return coverage.source_health(coverage.run_coverage(attempts(t)), _health(t), _gaps(t))
