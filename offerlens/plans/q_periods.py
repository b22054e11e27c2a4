"""Queries over period resolution, lifecycle and date coercion."""

from pyspark.sql import functions as F

from offerlens.functions import dates, quota
from offerlens.operators import periods, rewards
from offerlens.plans.base import AS_OF, OFFERS_SQL, Tables, day, lifecycle_sql, offers, query, text
from offerlens.session import spread

# Order dates are moved 29 years on, into the years the parser accepts.
S = "CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR AS DATE)"
E = f"CAST({S} + INTERVAL 45 DAY AS DATE)"


def _start():
    return F.add_months("o_orderdate", 348)


def _end():
    return F.date_add(_start(), 45)


def pages(t: Tables):
    """Orders rendered in every written form of a period."""
    k, s, e = F.col("o_orderkey"), _start(), _end()
    roc = lambda d: text(F.year(d) - 1911, "年", F.month(d), "月", F.dayofmonth(d), "日")
    m = k % 8
    body = (
        F.when(m == 0, text("前言 2020/1/1\n活動期間：", day(s, "yyyy/MM/dd"), " (一) 10:00 ～ ", day(e, "yyyy/MM/dd"), "\n其他"))
        .when(m == 1, text("優惠期間：民國", roc(s), "至", roc(e)))
        .when(m == 2, text("一、活動時間\n", day(s, "yyyy年M月d日"), "\n至", day(e, "M月d日"), "止"))
        .when(m == 3, text("startDate: ", day(s), "\nEndDate: ", day(e), " 23:59\n活動期間：2020/1/1～2020/2/1"))
        .when(m == 4, text("活動期間：", day(s, "yyyy年M月d日"), "起，每月計算"))
        .when(m == 5, text("活動日期：", day(s, "yyyy.M.d"), "，僅限當日有效"))
        .when(m == 6, text("全文 ", day(s, "yyyy-MM-dd"), "到", day(e, "yyyy-MM-dd"), " 皆可"))
        .otherwise(text("沒有日期 ", k))
    )
    return t.orders.select("o_orderkey", "o_orderdate", body.alias("text"))


PERIOD_SQL = f"""per AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE {S} END AS start_date,
  CASE WHEN o_orderkey % 8 IN (4, 7) THEN NULL WHEN o_orderkey % 8 = 5 THEN {S} ELSE {E} END AS end_date,
  CASE o_orderkey % 8 WHEN 4 THEN 'low' WHEN 5 THEN 'medium' WHEN 6 THEN 'low' WHEN 7 THEN 'none' ELSE 'high' END AS date_confidence FROM orders)"""


@query("period_resolve", f"WITH {PERIOD_SQL} SELECT * FROM per")
def period_resolve(t: Tables):
    return periods.resolve_periods(pages(t), "text").select("o_orderkey", "start_date", "end_date", "date_confidence")


@query(
    "period_windows",
    """SELECT o_orderkey, count(*) AS windows, CAST(sum(high) AS BIGINT) AS high FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 8 IN (6, 7) THEN [0] ELSE [1, 0] END) AS high FROM orders) GROUP BY o_orderkey""",
)
def period_windows(t: Tables):
    w = periods.period_windows(pages(t), "o_orderkey", "text")
    return w.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("confidence") == "high").alias("high"))


@query(
    "period_windows_docs",
    """SELECT doc_id, length(regexp_replace(text, '[\\t\\r]+', ' ', 'g')) AS low_chars FROM documents""",
)
def period_windows_docs(t: Tables):
    w = periods.period_windows(t.documents, "doc_id", "text").filter("confidence = 'low'")
    return w.select("doc_id", F.length("window").cast("bigint").alias("low_chars"))


@query(
    "period_override",
    f"""WITH {PERIOD_SQL}, o AS (SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 5 AS b, start_date, end_date, date_confidence FROM per)
SELECT o_orderkey,
  CASE WHEN b = 0 AND (a = 0 OR date_confidence IN ('none', 'low')) THEN DATE '2031-01-01' WHEN start_date IS NULL OR end_date IS NULL THEN DATE '2032-01-01' ELSE start_date END AS start_date,
  CASE WHEN b = 0 AND (a = 0 OR date_confidence IN ('none', 'low')) THEN DATE '2031-02-01' WHEN start_date IS NULL OR end_date IS NULL THEN DATE '2032-02-01' ELSE end_date END AS end_date,
  CASE WHEN b = 0 AND (a = 0 OR date_confidence IN ('none', 'low')) THEN 'high' WHEN start_date IS NULL OR end_date IS NULL THEN 'high' ELSE date_confidence END AS date_confidence FROM o""",
)
def period_override(t: Tables):
    k = F.col("o_orderkey")
    df = (
        pages(t)
        .withColumn("title", F.when(k % 5 == 0, "2031/1/1~2/1 title").otherwise("title"))
        .withColumn("adapter", F.when(k % 3 == 0, "title_first").otherwise("plain"))
        .withColumn("list_start", F.lit("2032-01-01"))
        .withColumn("list_end", F.lit("2032-02-01"))
    )
    out = periods.override_periods(df, "text", "title", "adapter", "list_start", "list_end", ("title_first",))
    return out.select("o_orderkey", "start_date", "end_date", "date_confidence")


@query("lifecycle", f"WITH {OFFERS_SQL} SELECT {lifecycle_sql()} AS lifecycle, quota_status, count(*) AS offers FROM offers GROUP BY ALL")
def lifecycle(t: Tables):
    return periods.with_lifecycle(offers(t), AS_OF).groupBy("lifecycle", "quota_status").agg(F.count(F.lit(1)).alias("offers"))


@query(
    "timing",
    f"""WITH {OFFERS_SQL} SELECT seq, CAST(start_date - DATE '{AS_OF}' AS INTEGER) AS starts_in_days, CAST(end_date - DATE '{AS_OF}' AS INTEGER) AS ends_in_days,
  coalesce(start_date - DATE '{AS_OF}' BETWEEN 1 AND 14, false) AS is_upcoming, coalesce(end_date - DATE '{AS_OF}' BETWEEN 0 AND 7, false) AS is_expiring_soon FROM offers""",
)
def timing(t: Tables):
    return rewards.with_timing(offers(t), AS_OF).select("seq", "starts_in_days", "ends_in_days", "is_upcoming", "is_expiring_soon")


@query(
    "date_coercion",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS lenient, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS strict FROM orders""",
)
def date_coercion(t: Tables):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, day("o_orderdate"))
        .when(k % 4 == 1, text(" ", day("o_orderdate"), "T10:00"))
        .when(k % 4 == 2, text(F.year("o_orderdate"), "-02-30"))
        .otherwise("民國115年7月")
    )
    return t.orders.select("o_orderkey", dates.lenient_date(raw).alias("lenient"), dates.strict_date(raw).alias("strict"))


@query(
    "dash_periods",
    f"""SELECT o_orderkey, {S} AS start_date, {E} AS end_date FROM orders WHERE o_orderkey % 3 <> 2 AND {E} >= DATE '2027-06-01'""",
)
def dash_periods(t: Tables):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 2, text(day(_start()), "~2099-13-01")).otherwise(text(" ", day(_start()), " ~", day(_end())))
    df = t.orders.select("o_orderkey", raw.alias("period"))
    return periods.parse_period(df, "period", "2027-06-01").select("o_orderkey", "start_date", "end_date")


@query(
    "long_text_decisions",
    """SELECT c_custkey, DATE '2026-07-01' + CAST(c_custkey % 28 AS INTEGER) AS start_date, DATE '2026-08-31' AS end_date, CAST(c_nationkey % 12 + 1 AS VARCHAR) AS months,
  'sold_out' AS quota_status, 600 + length(CAST(c_custkey AS VARCHAR)) AS excerpt_chars FROM customer""",
)
def long_text_decisions(t: Tables):
    """What decides may stand anywhere: a period behind 21 000 characters, a month behind 1 200, a notice of 600 characters."""
    k = F.col("c_custkey")
    far = F.concat(F.repeat(F.lit("條款文字"), 5250), text(" 2026/7/"), (k % 28 + 1).cast("string"), text("～2026/8/31"))
    month = F.concat(F.repeat(F.lit("x"), 1200), (F.col("c_nationkey") % 12 + 1).cast("string"), text("月"))
    notice = F.concat(text("本活動回饋已全數額滿"), F.repeat(F.lit("長"), 590), k.cast("string"))
    customers = spread(t.customer.select("c_custkey", "c_nationkey"))
    rows = customers.select("c_custkey", dates.resolve_period(far).alias("p"), dates.mentioned_months(month).alias("m"), quota.quota_of(notice).alias("q"))
    return rows.select(
        "c_custkey", F.col("p.start").alias("start_date"), F.col("p.end").alias("end_date"), F.array_join("m", ",").alias("months"),
        F.col("q.status").alias("quota_status"), F.length("q.excerpt").cast("bigint").alias("excerpt_chars"),
    )
