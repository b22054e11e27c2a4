"""Queries over history, evidence, the id frontier and crawl planning."""

from pyspark.sql import functions as F

from offerlens.functions import quota
from offerlens.functions.urls import canonical_url
from offerlens.operators import coverage, extract, frontier, state
from offerlens.plans.base import LIVE_SQL, OFFERS_SQL, AS_OF, REGISTRY_SQL, Tables, attempts, day, offers, query, registry, text
from offerlens.plans.q_coverage import GAPS_SQL
from offerlens.plans.q_extract import LINKS_SQL
from offerlens.plans.q_urls import canonical_sql
from offerlens.operators.periods import with_lifecycle
from offerlens.session import spread, staged

SPLIT = "2024-01-16"
STATUSES = {
    "purchase": "sold_out",
    "signup": "partial_sold_out",
    "view": "unknown_app_only",
    "error": "unknown_source_failure",
    "click": "not_marked_full",
}
SEEN_SQL = """o AS (SELECT 'u' || user_id || '-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS activity_id, ts, event_id, value,
  CASE event_type WHEN 'purchase' THEN 'sold_out' WHEN 'signup' THEN 'partial_sold_out' WHEN 'view' THEN 'unknown_app_only' WHEN 'error' THEN 'unknown_source_failure' ELSE 'not_marked_full' END AS quota_status FROM events)"""


def observations(t: Tables):
    """events as status observations of (user, slot) offers."""
    status = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in STATUSES.items()])
    slot = F.get_json_object("props", "$.k").cast("int") % 10
    return t.events.select(
        text("u", F.col("user_id"), "-", slot).alias("activity_id"), "ts", "event_id", "value", status.alias("quota_status")
    )


def _last(df):
    o = F.struct("ts", "event_id")
    return df.groupBy("activity_id").agg(
        F.max_by("quota_status", o).alias("quota_status"), F.max_by("event_id", o).alias("event_id"), F.max_by("value", o).alias("value")
    ).withColumn("quota_evidence_complete", F.col("quota_status") != "unknown_app_only")


def _halves(t: Tables):
    o = observations(t)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    return o.filter(F.col("ts") < cut), o.filter(F.col("ts") >= cut)


def _evidence(df):
    """Evidence rows of observations: conditional wording when the value is high."""
    return df.select(
        "activity_id",
        F.col("event_id").alias("ord"),
        F.col("quota_status").alias("source_url"),
        F.when(F.col("value") > 40, "若額滿則停止回饋").otherwise("本活動回饋已全數額滿").alias("excerpt"),
    )


HALVES_SQL = f"""{SEEN_SQL},
h AS (SELECT activity_id, max_by(quota_status, (ts, event_id)) AS was FROM o WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1),
b AS (SELECT activity_id, max_by(quota_status, (ts, event_id)) AS now, max_by(event_id, (ts, event_id)) AS event_id FROM o WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1),
r AS (SELECT activity_id, NOT bool_or(value <= 40) AS retracted FROM o WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1),
j AS (SELECT b.activity_id, was, now, b.event_id, coalesce(retracted, false) AS retracted FROM b LEFT JOIN h USING (activity_id) LEFT JOIN r USING (activity_id)),
merged AS (SELECT *, CASE WHEN was IN ('sold_out', 'partial_sold_out') AND now IN ('not_marked_full', 'unknown_app_only', 'unknown_source_failure') AND NOT retracted THEN was
  WHEN was = 'unknown_app_only' AND now = 'not_marked_full' THEN was ELSE now END AS quota_status, was IS NOT NULL AND NOT retracted AS carry_evidence FROM j)"""


def _merged(t: Tables):
    before, after = _halves(t)
    return state.merge_sticky(_last(after), _last(before), _evidence(before))


@query("sticky_merge", f"WITH {HALVES_SQL} SELECT activity_id, was AS previous_status, quota_status, carry_evidence, quota_status <> 'unknown_app_only' AS quota_evidence_complete FROM merged")
def sticky_merge(t: Tables):
    return _merged(t).select("activity_id", "previous_status", "quota_status", "carry_evidence", "quota_evidence_complete")


def _stored_verdicts(t: Tables):
    """Verdicts as an earlier run stored them: of the evidence of its first days, and all of them under other rules too."""
    before, _ = _halves(t)
    early = _worded(before.filter(F.dayofmonth("ts") <= EARLY_DAY))
    old_rules = quota.RulePack({k: v for k, v in quota.ZH_PACK.rules.items() if k != next(iter(quota.ZH_PACK.rules))})
    kept = [state.judge_excerpts(early), state.judge_excerpts(_worded(before), pack=old_rules)]
    return staged(kept[0].unionByName(kept[1]).drop("is_new"), "verdicts")


EARLY_DAY = 8


def _worded(df):
    """Evidence whose excerpts name the value, so that many differ."""
    return _evidence(df).withColumn("excerpt", F.concat("excerpt", F.lit("（"), F.col("ord") % 500, F.lit("）")))


_EXCERPT = "CASE WHEN value > 40 THEN '若額滿則停止回饋' ELSE '本活動回饋已全數額滿' END || '（' || (event_id % 500) || '）'"


@query(
    "evidence_verdicts",
    f"""WITH {SEEN_SQL}, e AS (SELECT {_EXCERPT} AS excerpt, value > 40 AS conditional, day(ts) AS d FROM o WHERE ts < TIMESTAMP '{SPLIT}')
SELECT sha256(excerpt) AS excerpt_hash, CASE WHEN conditional THEN 'not_marked_full' ELSE 'sold_out' END AS quota_status, NOT bool_or(d <= {EARLY_DAY}) AS is_new FROM e GROUP BY excerpt, conditional""",
)
def evidence_verdicts(t: Tables):
    """Verdicts of all stored excerpts; only those without a verdict under today's rules are judged."""
    before, _ = _halves(t)
    return state.judge_excerpts(_worded(before), _stored_verdicts(t)).select("excerpt_hash", "quota_status", "is_new")


@query("sticky_merge_stored", f"WITH {HALVES_SQL} SELECT activity_id, was AS previous_status, quota_status, carry_evidence FROM merged")
def sticky_merge_stored(t: Tables):
    """The sticky merge with evidence judged by stored verdicts; the same rows as ``sticky_merge``."""
    before, after = _halves(t)
    verdicts = staged(state.judge_excerpts(_worded(before), _stored_verdicts(t)), "verdicts")
    out = state.merge_sticky(_last(after), _last(before), _worded(before), verdicts=verdicts)
    return out.select("activity_id", "previous_status", "quota_status", "carry_evidence")


@query(
    "sticky_exempt",
    f"""WITH {HALVES_SQL}, x AS (SELECT *, was = 'unknown_app_only' AND now = 'not_marked_full' AND event_id % 2 = 0 AS corrected FROM merged)
SELECT activity_id, was AS previous_status, CASE WHEN corrected THEN now ELSE quota_status END AS quota_status, carry_evidence AND NOT coalesce(corrected, false) AS carry_evidence FROM x""",
)
def sticky_exempt(t: Tables):
    """Earlier app-only answers of a page shared with another brand (every second row) neither stay nor leave evidence."""
    before, after = _halves(t)
    out = state.merge_sticky(_last(after), _last(before), _evidence(before), exempt=F.col("event_id") % 2 == 0)
    return out.select("activity_id", "previous_status", "quota_status", "carry_evidence")


@query(
    "component_merge",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, ['b' || (l_partkey % 4), 'a1'] AS cur, ['a' || (l_partkey % 5), 'b' || (l_suppkey % 3), 'c' || (l_orderkey % 2)] AS prev FROM lineitem)
SELECT k, n, array_to_string(list_concat(list_reverse(list_filter(prev, lambda x: NOT list_contains(cur, x))), cur), ' ') AS components FROM c""",
)
def component_merge(t: Tables):
    """Components of one offer: those missing now come back in front."""
    name = lambda letter, c, m: F.concat(F.lit(letter), (F.col(c) % m).cast("string"))
    cur = F.array(name("b", "l_partkey", 4), F.lit("a1"))
    prev = F.array(name("a", "l_partkey", 5), name("b", "l_suppkey", 3), name("c", "l_orderkey", 2))
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), cur.alias("cur"), prev.alias("prev"))
    return rows.select("k", "n", F.array_join(state.merge_components(F.col("cur"), F.col("prev")), " ").alias("components"))


@query("status_changes", f"WITH {HALVES_SQL} SELECT activity_id, was AS from_status, quota_status AS to_status FROM merged WHERE was <> quota_status")
def status_changes(t: Tables):
    before, _ = _halves(t)
    return state.status_changes(_last(before), _merged(t)).select("activity_id", "from_status", "to_status")


@query(
    "evidence_merge",
    f"""WITH {HALVES_SQL},
p AS (SELECT activity_id, event_id AS ord, quota_status AS source_url, CASE WHEN value > 40 THEN '若額滿則停止回饋' ELSE '本活動回饋已全數額滿' END AS excerpt FROM o WHERE ts < TIMESTAMP '{SPLIT}'),
c AS (SELECT activity_id, event_id AS ord, quota_status AS source_url, CASE WHEN value > 40 THEN '若額滿則停止回饋' ELSE '本活動回饋已全數額滿' END AS excerpt FROM o WHERE ts >= TIMESTAMP '{SPLIT}'),
u AS (SELECT activity_id, source_url, excerpt, min(ord) AS ord FROM p WHERE activity_id IN (SELECT activity_id FROM merged WHERE carry_evidence)
  AND (activity_id, source_url, excerpt) NOT IN (SELECT activity_id, source_url, excerpt FROM c) GROUP BY ALL),
lp AS (SELECT activity_id, min(ord) AS lo FROM p GROUP BY 1), lc AS (SELECT activity_id, min(ord) AS lo FROM c GROUP BY 1)
SELECT activity_id, source_url, excerpt, ord FROM c
UNION ALL SELECT u.activity_id, source_url, excerpt, coalesce(lc.lo, 0) - 1 - (ord - lp.lo) FROM u JOIN lp USING (activity_id) LEFT JOIN lc USING (activity_id)""",
)
def evidence_merge(t: Tables):
    before, after = _halves(t)
    carry = _merged(t).filter("carry_evidence")
    return state.merge_evidence(_evidence(after), _evidence(before), carry)


@query(
    "upsert_history",
    f"""WITH {HALVES_SQL}, h2 AS (SELECT activity_id, was, max(event_id) AS x FROM h JOIN o USING (activity_id) WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY ALL)
SELECT coalesce(h2.activity_id, b.activity_id) AS activity_id, coalesce(now, was) AS quota_status,
  CASE WHEN h2.activity_id IS NULL THEN 'batch' ELSE 'old' END AS first_seen_at, CASE WHEN b.activity_id IS NULL THEN 'old' ELSE 'batch' END AS last_seen_at,
  CASE WHEN h2.activity_id IS NOT NULL THEN 'h' END AS external_id FROM h2 FULL OUTER JOIN b ON b.activity_id = h2.activity_id""",
)
def upsert_history(t: Tables):
    before, after = _halves(t)
    history = _last(before).select(
        "activity_id", "quota_status", F.lit("h").alias("external_id"), F.lit("old").alias("first_seen_at"), F.lit("old").alias("last_seen_at")
    )
    batch = _last(after).select(
        "activity_id", "quota_status", F.lit(None).cast("string").alias("external_id"), F.lit("batch").alias("fetched_at")
    )
    # The store keeps its own columns; the batch's capture time feeds the two sight columns.
    out = state.upsert(history.withColumn("fetched_at", F.lit("old")), batch)
    return out.select("activity_id", "quota_status", "first_seen_at", "last_seen_at", "external_id")


STICKY_SQL = f"""{SEEN_SQL}, l AS (SELECT activity_id, list(quota_status ORDER BY ts, event_id) AS seen, count(*) AS observations FROM o GROUP BY 1)
SELECT activity_id, observations, list_reduce(seen, lambda s, x: CASE WHEN s IN ('sold_out', 'partial_sold_out') AND x IN ('not_marked_full', 'unknown_app_only', 'unknown_source_failure') THEN s
  WHEN s = 'unknown_app_only' AND x = 'not_marked_full' THEN s ELSE x END) AS quota_status FROM l"""


@query("sticky_fold", f"WITH {STICKY_SQL}")
def sticky_fold(t: Tables):
    out = state.sticky_status(observations(t), ["activity_id"], "quota_status", ["ts", "event_id"])
    return out.select("activity_id", "quota_status", "observations")


@query("recheck_scan", f"WITH {LIVE_SQL} SELECT seq, title, start_date FROM sectioned WHERE lifecycle IN ('active', 'upcoming', 'unknown')")
def recheck_scan(t: Tables):
    live = with_lifecycle(offers(t), AS_OF)
    return state.recheck_targets(live).select(F.col("external_id").cast("bigint").alias("seq"), "title", "start_date")


@query("status_snapshot", f"WITH {LIVE_SQL} SELECT CAST(seq AS VARCHAR) AS activity_id, quota_status, lifecycle, title, url FROM sectioned")
def status_snapshot(t: Tables):
    return state.status_snapshot(with_lifecycle(offers(t).withColumnRenamed("external_id", "activity_id"), AS_OF))


# ---------------------------------------------------------------- frontier


def _frontier(t: Tables):
    n = F.col("n_nationkey").cast("bigint")
    known = t.nation.filter("n_nationkey % 5 <> 4").select(
        text("p", n).alias("provider_id"), (n + 10).alias("highest_valid_event_id"), F.when(n % 3 == 0, 0).otherwise(n + 12).cast("bigint").alias("scan_frontier_event_id")
    )
    sources = t.nation.select(
        text("p", n).alias("provider_id"),
        (n % 7 + 1).alias("minimum_event_id"),
        F.lit(9).cast("bigint").alias("bootstrap_end_id"),
        F.lit(6).cast("bigint").alias("rescan_window"),
        F.lit(3).cast("bigint").alias("frontier_buffer"),
        F.when(n % 2 == 0, 5).otherwise(220).cast("bigint").alias("maximum_probe_ids"),
    )
    return frontier.plan_ranges(frontier.load_frontier(known), sources)


def _outcomes(t: Tables):
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "not_found").otherwise("valid")
    return t.events.select(
        text("p", F.col("user_id") % 25).alias("provider_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("event_id"),
        outcome.alias("outcome"),
        F.col("event_id").alias("seq"),
    )


FRONTIER_SQL = """k AS (SELECT CAST(n_nationkey AS BIGINT) AS n, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey + 10 END AS hi,
  CASE WHEN n_nationkey % 5 <> 4 THEN CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 10 ELSE n_nationkey + 12 END END AS fr FROM nation),
st AS (SELECT n, coalesce(hi, 0) AS previous_highest, coalesce(fr, 0) AS previous_frontier, CASE WHEN fr > 0 THEN greatest(n % 7 + 1, fr - 6 + 1) ELSE n % 7 + 1 END AS scan_start,
  CASE WHEN fr > 0 THEN fr + 3 ELSE greatest(9, n % 7 + 1) END AS e0, CASE WHEN n % 2 = 0 THEN 5 ELSE 220 END AS most FROM k),
ranges AS (SELECT 'p' || n AS provider_id, previous_highest, previous_frontier, scan_start, least(e0, scan_start + most - 1) AS scan_end, greatest(e0 - least(e0, scan_start + most - 1), 0) AS ids_cut_off FROM st),
oc AS (SELECT 'p' || (user_id % 25) AS provider_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS event_id,
  max_by(CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'not_found' ELSE 'valid' END, events.event_id) AS outcome FROM events GROUP BY 1, 2),
ins AS (SELECT oc.* FROM oc JOIN ranges USING (provider_id) WHERE event_id BETWEEN scan_start AND scan_end),
cnt AS (SELECT provider_id, count(*) AS probed, count(*) FILTER (outcome = 'valid') AS v, count(*) FILTER (outcome = 'not_found') AS e, count(*) FILTER (outcome = 'failure') AS f, max(event_id) FILTER (outcome = 'valid') AS top FROM ins GROUP BY 1),
scan AS (SELECT r.*, coalesce(probed, 0) AS probed_count, coalesce(v, 0) AS valid_count, coalesce(e, 0) AS empty_count,
  coalesce(f, 0) + (scan_end - scan_start + 1) - coalesce(probed, 0) AS failure_count, greatest(previous_highest, coalesce(top, 0)) AS highest_valid_event_id FROM ranges r LEFT JOIN cnt USING (provider_id)),
summ AS (SELECT *, failure_count = 0 AS complete, CASE WHEN failure_count = 0 THEN greatest(previous_frontier, scan_end) ELSE previous_frontier END AS scan_frontier_event_id FROM scan)"""


@query("frontier_plan", f"WITH {FRONTIER_SQL} SELECT provider_id, unnest(range(CAST(scan_start AS BIGINT), CAST(scan_end + 1 AS BIGINT))) AS event_id FROM ranges")
def frontier_plan(t: Tables):
    return frontier.plan_probe(_frontier(t)).select("provider_id", "event_id")


@query("scan_summary", f"WITH {FRONTIER_SQL} SELECT *, scan_frontier_event_id > previous_frontier AS frontier_advanced FROM summ")
def scan_summary(t: Tables):
    return frontier.scan_summary(_frontier(t), _outcomes(t))


@query("frontier_advance", f"WITH {FRONTIER_SQL} SELECT provider_id, highest_valid_event_id, scan_frontier_event_id FROM summ WHERE complete")
def frontier_advance(t: Tables):
    return frontier.advance_frontier(_frontier(t), _outcomes(t))


@query(
    "unanswered_ids",
    f"""WITH {FRONTIER_SQL}, pl AS (SELECT provider_id, unnest(range(CAST(scan_start AS BIGINT), CAST(scan_end + 1 AS BIGINT))) AS event_id FROM ranges)
SELECT provider_id, event_id FROM pl WHERE (provider_id, event_id) NOT IN (SELECT provider_id, event_id FROM oc)""",
)
def unanswered_ids(t: Tables):
    return frontier.unanswered_ids(frontier.plan_probe(_frontier(t)), _outcomes(t))


@query(
    "probe_classify",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'not_found' WHEN 'error' THEN 'failure' WHEN 'view' THEN 'failure' ELSE 'valid' END AS outcome FROM events""",
)
def probe_classify(t: Tables):
    e = F.col("event_type")
    body = (
        F.when(e == "click", '{"code":"2001"}')
        .when(e == "error", "<html>")
        .when(e == "view", '{"code":"0000","data":{"title":" ","activity_start_time":"x","activity_end_time":"y"}}')
        .otherwise(text('{"code":"0000","data":{"title":"t', F.col("event_id"), '","activity_start_time":"', day("ts"), '","activity_end_time":"y"}}'))
    )
    df = t.events.select("event_id", body.alias("text"))
    return frontier.classify_probe(df).select("event_id", "outcome")


# ---------------------------------------------------------------- crawl plan

CAP = 650


def _plan(t: Tables):
    """Registry with one id-scan source, seeds of five providers, rechecks and probes."""
    providers, _, sources = registry(t)
    providers = providers.withColumn("seq", F.substring("provider_id", 2, 9).cast("bigint"))
    scan = (F.col("provider_id") == "p1") & (F.col("name") == "s1")
    sources = sources.withColumn("adapter", F.when(scan, "fullpay_id_scan").otherwise(F.col("adapter")))
    r = F.col("r_regionkey")
    seeds = t.region.select(
        text("p", r).alias("provider_id"), text("https://shop", r, ".example.com/list/0?utm_source=seed").alias("url"), F.lit(None).cast("string").alias("fetch_url"), r.cast("bigint").alias("seq")
    )
    live = with_lifecycle(offers(t), AS_OF).withColumn("external_id", F.floor(F.col("seq") / 2).cast("string"))
    targets = live.filter("lifecycle <> 'ended'").select(
        "seq", "provider_id", "external_id", "title", F.lit("https://shop.example.com/offer").alias("url"), F.lit("").alias("source_url")
    )
    rechecks = frontier.plan_rechecks(targets, t.nation.select(text("p", F.col("n_nationkey")).alias("provider_id")))
    probes = frontier.plan_probe(_frontier(t)).select(
        "provider_id", F.lit("https://probe.example.com/").alias("fetch_url"), F.col("event_id").cast("string").alias("external_id"), F.col("event_id").alias("seq")
    )
    return frontier.initial_tasks(providers, sources, seeds, rechecks, probes, "full")


PLAN_SQL = f"""{LIVE_SQL}, {REGISTRY_SQL}, {FRONTIER_SQL},
plan AS (SELECT provider_id, url AS fetch_url, NULL AS external_id, 0 AS tier, CAST(substr(provider_id, 2) AS BIGINT) AS ps, 0 AS kind, CAST(seq AS BIGINT) AS seq FROM sources
    WHERE NOT (provider_id = 'p1' AND name = 's1')
  UNION ALL SELECT 'p' || r_regionkey, 'https://shop' || r_regionkey || '.example.com/list/0?utm_source=seed', NULL, 0, r_regionkey, 1, r_regionkey FROM region
  UNION ALL SELECT provider_id, 'https://shop.example.com/offer', CAST(seq // 2 AS VARCHAR), 2, 0, 0, seq FROM sectioned WHERE lifecycle <> 'ended'
  UNION ALL SELECT provider_id, 'https://probe.example.com/', CAST(e AS VARCHAR), 3, 0, 0, e FROM (SELECT provider_id, unnest(range(CAST(scan_start AS BIGINT), CAST(scan_end + 1 AS BIGINT))) AS e FROM ranges)),
keyed AS (SELECT *, provider_id || chr(0) || ({canonical_sql('fetch_url')}) || coalesce('#external_id=' || external_id, '') AS task_key FROM plan),
uniq AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY tier, ps, kind, seq) AS rn FROM keyed),
ranked AS (SELECT *, row_number() OVER (ORDER BY tier, ps, kind, seq, task_key) AS pos FROM uniq WHERE rn = 1)"""


@query("crawl_plan", f"WITH {PLAN_SQL} SELECT provider_id, fetch_url, external_id, tier, seq FROM ranked WHERE pos <= {CAP}")
def crawl_plan(t: Tables):
    return frontier.crawl_plan(_plan(t), CAP).select("provider_id", "fetch_url", "external_id", "tier", "seq")


@query(
    "pending_overflow",
    f"WITH {PLAN_SQL} SELECT 'r1' AS run_id, provider_id, '全域擷取上限' AS source_name, count(*) AS discovered_count, min_by(fetch_url, pos) AS url, 'crawl_reached_max_total_pages' AS issue FROM ranked WHERE pos > {CAP} GROUP BY provider_id",
)
def pending_overflow(t: Tables):
    return frontier.pending_overflow(_plan(t), CAP, "r1")


@query(
    "coverage_gaps_overflow",
    f"""SELECT run_id, provider_id, source_name, url, issue, CAST(discovered_count AS BIGINT) AS discovered_count FROM (WITH {GAPS_SQL} SELECT * FROM gaps)
UNION ALL SELECT (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events), provider_id, '全域擷取上限', url, 'crawl_reached_max_total_pages', n FROM
  (WITH {PLAN_SQL} SELECT provider_id, count(*) AS n, min_by(fetch_url, pos) AS url FROM ranked WHERE pos > {CAP} GROUP BY provider_id)""",
)
def coverage_gaps_overflow(t: Tables):
    """Gaps of all runs with the last run's tasks beyond the crawl cap."""
    a = attempts(t)
    providers, _, sources = registry(t)
    pending = frontier.pending_overflow(_plan(t), CAP, a.agg(F.max("run_id")).scalar())
    return coverage.coverage_gaps(a, providers, sources, a.select("run_id").distinct(), pending)


@query(
    "recheck_plan",
    f"""WITH {OFFERS_SQL}, x AS (SELECT seq, CASE provider_id WHEN 'p1' THEN 'taiwanpay' WHEN 'p2' THEN 'famipay' WHEN 'p3' THEN 'jkopay' WHEN 'p4' THEN 'pxpay' ELSE provider_id END AS provider_id FROM offers)
SELECT seq, provider_id, CASE provider_id WHEN 'taiwanpay' THEN 'taiwanpay_detail' WHEN 'pxpay' THEN 'pxmart_campaign_detail' ELSE '' END AS adapter FROM x
WHERE provider_id NOT IN ('famipay', 'jkopay') AND NOT (provider_id = 'pxpay' AND seq % 2 = 0)""",
)
def recheck_plan(t: Tables):
    names = {"p1": "taiwanpay", "p2": "famipay", "p3": "jkopay", "p4": "pxpay"}
    rename = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()], c)
    src = F.when(F.col("seq") % 2 == 0, "https://c.example.com/event/GetEventList?x=1").otherwise("https://c.example.com/campaign/pxpay-card/1")
    targets = offers(t).withColumn("provider_id", rename(F.col("provider_id"))).withColumn("source_url", src)
    providers = t.nation.select(rename(text("p", F.col("n_nationkey"))).alias("provider_id"))
    return frontier.plan_rechecks(targets, providers).select("seq", "provider_id", "adapter")


@query(
    "next_round",
    f"""WITH {LINKS_SQL}, found AS (SELECT DISTINCT {canonical_sql('link_url')} AS canonical_url FROM edges), s AS (SELECT {canonical_sql('url')} AS canonical_url FROM pages)
SELECT canonical_url FROM found WHERE canonical_url NOT IN (SELECT canonical_url FROM s)""",
)
def next_round(t: Tables):
    d = extract.extract_pages(t.pages, "page_id", "url", "html", ("links",))
    edges = extract.link_edges(d, "page_id", "url").select(canonical_url(F.col("link_url")).alias("canonical_url"))
    return frontier.next_round(edges, t.pages.select(canonical_url(F.col("url")).alias("canonical_url")))


@query(
    "link_expansion",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey // 10 AS dst FROM orders),
r AS (SELECT c_custkey AS page, 0 AS hop FROM customer WHERE c_acctbal < 0
  UNION SELECT e.dst, hop + 1 FROM r JOIN e ON e.src = r.page WHERE hop < 40)
SELECT page, min(hop) AS hop FROM r GROUP BY page""",
)
def link_expansion(t: Tables):
    edges = t.orders.select(F.col("o_custkey").alias("src"), F.floor(F.col("o_orderkey") / 10).alias("dst"))
    seeds = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("page"))
    return frontier.expand(seeds, edges)


@query(
    "evidence_identity",
    """SELECT CAST(c_custkey AS VARCHAR) AS activity_id, n AS variant, 500 + 1 AS excerpt_chars FROM customer, (VALUES ('a'), ('b')) v(n)""",
)
def evidence_identity(t: Tables):
    """Two notices that share their first 500 characters stay two; the one that is stored already is not doubled."""
    k = F.col("c_custkey").cast("string").alias("activity_id")
    excerpt = lambda v: F.concat(F.repeat(F.lit("同"), 500), F.lit(v)).alias("excerpt")
    customers = spread(t.customer.select("c_custkey"))
    row = lambda v, n: customers.select(k, F.lit("u").alias("source_url"), excerpt(v), F.lit(n).alias("ord"))
    merged = state.merge_evidence(row("a", 1), row("a", 1).unionByName(row("b", 2)), customers.select(k))
    return merged.select("activity_id", F.right("excerpt", F.lit(1)).alias("variant"), F.length("excerpt").alias("excerpt_chars"))
