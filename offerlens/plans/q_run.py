"""A whole run in one query: pages of orders on top of a history, to report, changes, gaps and verdicts."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators import keys, run
from offerlens.plans.base import SECTION_SQL, Tables, attempts, lifecycle_sql, query, registry, text
from offerlens.plans.q_coverage import FINAL_SQL
from offerlens.session import spread, staged

#: Orders are moved 28 years on, as pages name years of this century; so is the day of the run.
TODAY, KNOWN_BEFORE = "2026-06-01", "2026-01-01"
_WORDS = {"F": "本活動回饋已全數額滿。", "P": "若額滿則停止回饋。", "O": "每月回饋。"}


def _period() -> tuple[Column, Column]:
    start = F.add_months(F.col("o_orderdate").cast("date"), 28 * 12)
    return start, F.date_add(start, (F.col("o_orderkey") % 90).cast("int"))


def _facts(rows: DataFrame, seen: str, *more) -> DataFrame:
    k = F.col("o_orderkey")
    return rows.select(
        text("p", k % 25).alias("provider_id"), text("P", k % 25).alias("provider_name"), k.cast("string").alias("external_id"),
        text("https://shop.example.com/offer?id=", k).alias("url"), F.lit(seen).alias("fetched_at"), *more,
    )


FAILED, UNCHANGED = "4-NOT SPECIFIED", "1-URGENT"


def pages(t: Tables, seen: str) -> DataFrame:
    """A page per order, every tenth twice, the second time without dates; every 17th never has any; those of one priority failed."""
    k, (start, end) = F.col("o_orderkey"), _period()
    copy = F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    # Orders are dealt while they are narrow: pages are costly to write and to read.
    orders = spread(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))
    rows = orders.filter(F.col("o_orderpriority") != FAILED).select("*", copy)
    dates = F.concat(F.lit("<p>活動期間："), F.date_format(start, "yyyy/MM/dd"), F.lit("～"), F.date_format(end, "yyyy/MM/dd"), F.lit("</p>"))
    words = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.lit(w)) for s, w in _WORDS.items()])
    body = F.concat(
        text("<html><head><title>Offer ", F.col("o_orderpriority"), " #", k, "</title></head><body>"),
        F.when((k % 17 == 0) | (F.col("copy") == 1), "").otherwise(dates), F.lit("<p>"), words, F.lit("</p></body></html>"),
    )
    return _facts(rows, seen, body.alias("body"), (k * 2 + F.col("copy")).alias("seq"), text(k, "/", F.col("copy")).alias("capture_id"))


def stored(t: Tables) -> DataFrame:
    """Orders of the first years as an earlier run left them."""
    k, (start, end) = F.col("o_orderkey"), _period()
    rows = t.orders.filter(start < F.lit(KNOWN_BEFORE).cast("date"))
    old = _facts(
        rows, "d1", text("Offer ", F.col("o_orderpriority"), " #", k).alias("title"), start.alias("start_date"), end.alias("end_date"),
        F.when(k % 2 == 0, "partial_sold_out").otherwise("not_marked_full").alias("quota_status"), F.lit(True).alias("quota_evidence_complete"),
        F.lit(False).alias("review_required"), F.lit("d1").alias("first_seen_at"), F.lit("d1").alias("last_seen_at"), (k * 2).alias("seq"),
    )
    return keys.with_activity_id(old).withColumn("source_url", F.col("url")).select(*run.HISTORY)


def monitored(t: Tables) -> run.Run:
    """The run of day two; the pages of urgent orders were captured on day one, are the same and are not parsed again."""
    before = pages(t, "d1").filter(F.col("body").contains(f"Offer {UNCHANGED} "))
    known = run.read_documents(before.withColumn("content_hash", F.sha2(F.col("body").cast("binary"), 256)), None)[0]
    providers, _, sources = registry(t)
    return run.monitor(pages(t, "d2"), attempts(t), providers, sources, staged(stored(t), "history"), TODAY, documents=known)


RUN_SQL = f"""run_rows AS (SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS d1, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS d2, o_orderpriority <> '{FAILED}' AS seen, o_orderpriority = '{UNCHANGED}' AS unchanged, o_orderdate + INTERVAL 28 YEAR < DATE '{KNOWN_BEFORE}' AS known, o_orderkey % 17 = 0 AS dateless,
  CASE WHEN o_orderkey % 2 = 0 THEN 'partial_sold_out' ELSE 'not_marked_full' END AS was, CASE o_orderstatus WHEN 'F' THEN 'sold_out' ELSE 'not_marked_full' END AS now FROM orders),
after_run AS (SELECT k, seen, known, was, CASE WHEN NOT seen THEN was WHEN known AND was = 'partial_sold_out' AND now = 'not_marked_full' THEN was ELSE now END AS quota_status,
  CASE WHEN NOT (seen AND dateless) THEN d1 END AS start_date, CASE WHEN NOT (seen AND dateless) THEN d2 END AS end_date, seen AND dateless AS review_required FROM run_rows WHERE seen OR known),
aged AS (SELECT *, {lifecycle_sql(TODAY)} AS lifecycle FROM after_run), run_report AS (SELECT *, {SECTION_SQL} AS section FROM aged WHERE lifecycle <> 'ended')"""


@query(
    "monitor_run_report",
    f"""WITH {RUN_SQL} SELECT CAST(k AS VARCHAR) AS external_id, section, quota_status, start_date, end_date, lifecycle,
  CASE WHEN known THEN 'd1' ELSE 'd2' END AS first_seen_at, CASE WHEN seen THEN 'd2' ELSE 'd1' END AS last_seen_at FROM run_report""",
)
def monitor_run_report(t: Tables):
    """The report of a whole run, made of the history it leaves behind."""
    return monitored(t).report.select("external_id", "section", "quota_status", "start_date", "end_date", "lifecycle", "first_seen_at", "last_seen_at")


@query(
    "monitor_run",
    f"""WITH {RUN_SQL}, {FINAL_SQL}
SELECT 'section' AS part, section AS name, count(*) AS n FROM run_report GROUP BY section
UNION ALL SELECT 'change', was || ' > ' || quota_status, count(*) FROM after_run WHERE seen AND known AND was <> quota_status GROUP BY ALL
UNION ALL SELECT 'gap', issue, count(*) FROM gaps GROUP BY issue
UNION ALL SELECT 'verdict', CASE WHEN transport_status = 'unavailable' OR systemic_dns_failure THEN 'failed' WHEN failed > 0 OR discovery_issues > 0 THEN 'partial' ELSE 'success' END, count(*) FROM cov GROUP BY ALL
UNION ALL SELECT 'history', 'rows', count(*) FROM after_run
UNION ALL SELECT 'documents', 'all', count(*) + count(*) FILTER (k % 10 = 0) FROM run_rows WHERE seen
UNION ALL SELECT 'documents', 'parsed', count(*) + count(*) FILTER (k % 10 = 0) FROM run_rows WHERE seen AND NOT unchanged""",
)
def monitor_run(t: Tables):
    """What a whole run comes to: sections, changes, gaps, verdicts, the next history, and pages that had to be parsed."""
    r = monitored(t)
    counts = [
        r.report.select(F.lit("section").alias("part"), F.col("section").alias("name")),
        r.changes.select(F.lit("change"), F.concat_ws(" > ", "from_status", "to_status")),
        r.gaps.select(F.lit("gap"), "issue"),
        r.coverage.select(F.lit("verdict"), "verdict"),
        r.history.select(F.lit("history"), F.lit("rows")),
        r.documents.select(F.lit("documents"), F.lit("all")),
        r.parsed.select(F.lit("documents"), F.lit("parsed")),
    ]
    return reduce(DataFrame.union, counts).groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))
