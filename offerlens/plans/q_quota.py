"""Queries over quota evidence, rewards and insight."""

from pyspark.sql import functions as F

from offerlens.functions.quota import RulePack
from offerlens.operators import periods, quota, rewards
from offerlens.plans.base import AS_OF, OFFERS_SQL, Tables, day, lifecycle_sql, offers, query, text

# ---------------------------------------------------------------- documents

# DuckDB has no look-behind: put a line break behind each terminator and split there.
SENTENCES_SQL = r"""raw AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([。！？!?；;])', '\1' || chr(10), 'g'), chr(10))) AS s,
  generate_subscripts(string_split(regexp_replace(text, '([。！？!?；;])', '\1' || chr(10), 'g'), chr(10)), 1) AS i FROM documents),
squashed AS (SELECT doc_id, i, trim(regexp_replace(s, '[\s\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]+', ' ', 'g')) AS sentence FROM raw),
sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, sentence FROM squashed WHERE sentence <> '')"""


@query("sentence_table", f"WITH {SENTENCES_SQL} SELECT doc_id, pos, sentence FROM sents")
def sentence_table(t: Tables):
    return quota.sentences(t.documents, "doc_id", "text")


# A rule pack for the invented languages of the corpus; patterns stay inside what RE2 can do.
DOC_PACK = RulePack(
    {
        "sold_out": ("tion[a-z]* (?:the|de|la|der)", "ment[a-z]* (?:of|et|und)"),
        "conditional": ("^(?:If|On|En|Der) ", " or ", " ou "),
        "personal_cap": ("each .{0,20}limit",),
        "total_cap": ("total .{0,8}limit",),
        "example": ("^Ex.{0,60}tion",),
        "already": ("already", " est "),
        "app_only": ("(?:App|app)[a-z]* ", "www"),
        "whole": ("(?:all|alle|tout).{0,24}(?:tion|ment)",),
        "partial": ("[0-9]{1,4} .{0,40}tion", "(?:re|un)[a-z]+ .{0,24}ment"),
    }
)


def _alt(family: str) -> str:
    return "|".join(f"(?:{p})" for p in DOC_PACK.rules[family])


DOC_FLAGS_SQL = f"""{SENTENCES_SQL},
flags AS (SELECT doc_id, pos, sentence, regexp_matches(sentence, '{_alt('sold_out')}') AS is_sold_out,
  regexp_matches(sentence, '{_alt('app_only')}') AS is_app_only, regexp_matches(sentence, '{_alt('whole')}') AS is_whole,
  regexp_matches(sentence, '{_alt('partial')}') AS is_partial,
  CASE WHEN regexp_matches(sentence, '{_alt('personal_cap')}') AND NOT regexp_matches(sentence, '{_alt('total_cap')}') THEN true
    WHEN regexp_matches(sentence, '{_alt('example')}') THEN true WHEN regexp_matches(sentence, '{_alt('already')}') THEN false
    ELSE regexp_matches(sentence, '{_alt('conditional')}') END AS is_conditional FROM sents),
ex AS (SELECT *, is_sold_out AND NOT is_conditional AS is_explicit FROM flags)"""


@query(
    "sentence_flags",
    f"""WITH {DOC_FLAGS_SQL} SELECT doc_id, count(*) AS sentences, count(*) FILTER (is_sold_out) AS sold_out,
  count(*) FILTER (is_conditional) AS conditional, count(*) FILTER (is_explicit) AS explicit,
  count(*) FILTER (is_partial) AS partial, count(*) FILTER (is_app_only) AS app_only FROM ex GROUP BY doc_id""",
)
def sentence_flags(t: Tables):
    flags = quota.flag_sentences(quota.sentences(t.documents, "doc_id", "text"), DOC_PACK)
    n = F.count_if
    return flags.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"),
        n("is_sold_out").alias("sold_out"),
        n("is_conditional").alias("conditional"),
        n("is_explicit").alias("explicit"),
        n("is_partial").alias("partial"),
        n("is_app_only").alias("app_only"),
    )


@query(
    "quota_status_docs",
    f"""WITH {DOC_FLAGS_SQL},
agg AS (SELECT doc_id, count(*) FILTER (is_explicit) AS n_explicit, count(*) FILTER (is_explicit AND is_partial) AS n_partial,
  count(*) FILTER (is_explicit AND is_whole AND NOT is_partial) AS n_whole,
  min_by(sentence, pos) FILTER (is_explicit) AS first_explicit, min_by(sentence, pos) FILTER (is_app_only) AS first_app FROM ex GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_partial > 0 AND n_whole = 0 THEN 'partial_sold_out' WHEN n_explicit > 0 THEN 'sold_out'
    WHEN first_app IS NOT NULL THEN 'unknown_app_only' ELSE 'not_marked_full' END AS quota_status,
  coalesce(first_explicit, first_app, '') AS quota_excerpt,
  CASE WHEN n_partial > 0 AND n_whole = 0 THEN n_partial ELSE 0 END AS n_components
FROM documents d LEFT JOIN agg USING (doc_id)""",
)
def quota_status_docs(t: Tables):
    return quota.assess(t.documents.select("doc_id", "text"), "text", DOC_PACK).select(
        "doc_id", "quota_status", "quota_excerpt", F.size("quota_components").cast("bigint").alias("n_components")
    )


# ---------------------------------------------------------------- rendered notices


def notices(t: Tables):
    """Orders rendered as offer pages: status and priority decide which notice the page carries."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    month = F.month("o_orderdate")
    # Thirty years on, because notices only name years from 2000 on.
    shown = F.add_months("o_orderdate", 360)
    body = (
        F.when((s == "F") & (p == "1-URGENT"), text("活動期間", day("o_orderdate", "yyyy/MM/dd"), "起。\n活動二", month, "月份回饋已額滿，其餘仍可參加。"))
        .when(s == "F", text("【額滿公告】本活動回饋已於", day(shown, "yyyy/M/d"), "全數額滿。若額滿將另行公告。"))
        .when(s == "P", text(" ", month, " 月因活動總回饋上限已額滿，故 ", month, " 月消費不符合回饋資格。"))
        .when(p == "4-NOT SPECIFIED", text("優惠", F.col("o_orderkey"), "。回饋額滿資訊僅公告於悠遊付App，本網站不另行公告。"))
        .when(p == "5-LOW", text("每人每月回饋上限", F.col("o_orderkey"), "點；若額滿則停止回饋"))
        .otherwise(text("消費滿額即享回饋，送完為止。", F.col("o_orderkey")))
    )
    return t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", body.alias("text"))


NOTICE_STATUS_SQL = """CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'partial_sold_out' WHEN o_orderstatus = 'F' THEN 'sold_out'
  WHEN o_orderstatus = 'P' THEN 'partial_sold_out' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown_app_only' ELSE 'not_marked_full' END"""


@query(
    "quota_status_offers",
    f"""SELECT o_orderkey, {NOTICE_STATUS_SQL} AS quota_status,
  NOT (o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED') AS quota_complete FROM orders""",
)
def quota_status_offers(t: Tables):
    return quota.assess(notices(t), "text").select("o_orderkey", "quota_status", "quota_complete")


@query(
    "quota_components",
    """SELECT o_orderkey, 0 AS pos, 'sold_out' AS status, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '月' AS period,
  CASE WHEN o_orderstatus = 'F' THEN '活動二' END AS component FROM orders
WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def quota_components(t: Tables):
    return quota.components(quota.assess(notices(t), "text"), "o_orderkey").drop("evidence")


@query(
    "sold_out_dates",
    f"""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) AS sold_out_date FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'""",
)
def sold_out_dates(t: Tables):
    dated = quota.with_sold_out_date(quota.assess(notices(t), "text"), AS_OF)
    return dated.filter("sold_out_date IS NOT NULL").select("o_orderkey", "sold_out_date")


# ---------------------------------------------------------------- structured records


def records(t: Tables):
    """lineitem as quota records of its order: returned lines are used up, open ones have stock."""
    left = F.when(F.col("l_returnflag") == "A", F.lit(0.0)).when(F.col("l_returnflag") == "N", F.col("l_quantity"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("offer"),
        F.when(F.col("l_tax") < 0.05, '["0","1"]').when(F.col("l_tax") < 0.07, "[2]").otherwise("broken").alias("pay_type"),
        left.alias("left_count"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), day("l_shipdate")).alias("disbursed_time"),
    )


RECORDS_SQL = """recs AS (SELECT l_orderkey AS offer, l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_quantity <= 0) AS sold,
  l_returnflag = 'N' AND l_quantity > 0 AS open FROM lineitem WHERE l_tax < 0.05),
counted AS (SELECT offer, count(*) FILTER (sold) AS sold_out_count, count(*) FILTER (open AND NOT sold) AS available_count,
  count(*) FILTER (NOT sold AND NOT open) AS unknown_count FROM recs GROUP BY offer)"""


@query(
    "quota_records",
    f"""WITH {RECORDS_SQL} SELECT *, CASE WHEN sold_out_count > 0 AND available_count = 0 AND unknown_count = 0 THEN 'sold_out'
  WHEN sold_out_count > 0 THEN 'partial_sold_out' WHEN available_count > 0 AND unknown_count = 0 THEN 'confirmed_available'
  ELSE 'not_marked_full' END AS quota_status, unknown_count = 0 AS quota_evidence_complete FROM counted""",
)
def quota_records(t: Tables):
    return quota.quota_from_records(quota.eligible_records(records(t)), "offer")


@query(
    "quota_records_json",
    """SELECT l_orderkey AS o, count(*) AS n_records, sum(l_quantity) AS left_total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""",
)
def quota_records_json(t: Tables):
    """One payload per line (bounded), read back through the record schema."""
    body = F.to_json(
        F.struct(
            (F.col("l_returnflag") != "R").alias("success"),
            F.array(F.struct(F.lit("bank").alias("bank_name"), F.lit('["1"]').alias("pay_type"), F.col("l_quantity").alias("left_count"))).alias("data"),
        )
    )
    rows = quota.explode_records(t.lineitem.select(F.col("l_orderkey").alias("o"), body.alias("text")), ["o"])
    return rows.groupBy("o").agg(F.count(F.lit(1)).alias("n_records"), F.sum("left_count").alias("left_total"))


@query(
    "api_status_overlay",
    f"""WITH {RECORDS_SQL}, j AS (SELECT o_orderkey, {NOTICE_STATUS_SQL} AS page_status, o_orderpriority = '2-HIGH' AS gone,
  coalesce(sold_out_count, 0) AS s, coalesce(available_count, 0) AS a, coalesce(unknown_count, 0) AS u,
  NOT (o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED') AS complete FROM orders LEFT JOIN counted ON offer = o_orderkey)
SELECT o_orderkey, CASE WHEN page_status = 'not_marked_full' AND gone THEN 'unknown_source_failure'
    WHEN page_status = 'not_marked_full' AND a > 0 AND s = 0 AND u = 0 THEN 'confirmed_available' ELSE page_status END AS quota_status,
  CASE WHEN u > 0 THEN false WHEN page_status = 'not_marked_full' AND gone THEN false
    WHEN page_status = 'not_marked_full' AND a > 0 AND s = 0 AND u = 0 THEN true ELSE complete END AS quota_evidence_complete FROM j""",
)
def api_status_overlay(t: Tables):
    pages = quota.assess(notices(t), "text").select(
        "o_orderkey",
        "quota_status",
        F.col("quota_complete").alias("quota_evidence_complete"),
        (F.col("o_orderpriority") == "2-HIGH").alias("api_unavailable"),
    )
    counts = quota.quota_from_records(quota.eligible_records(records(t)), "offer").drop("quota_status", "quota_evidence_complete")
    joined = pages.join(counts, F.col("offer") == F.col("o_orderkey"), "left")
    return quota.overlay_api_status(joined).select("o_orderkey", "quota_status", "quota_evidence_complete")


@query(
    "status_endpoint_join",
    f"""WITH {OFFERS_SQL}, st AS (SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d') END AS tm FROM events),
j AS (SELECT seq, coalesce(end_date >= DATE '{AS_OF}', true) AS asked, coalesce(valid, false) AS valid, tm FROM offers LEFT JOIN st ON st.event_id = seq)
SELECT seq, CASE WHEN asked AND valid THEN tm END AS full_quota_time, asked AND NOT valid AS api_unavailable, NOT asked AS api_skipped,
  CASE WHEN asked AND valid AND tm IS NOT NULL THEN '活動已達上限（官方公開狀態時間：' || tm || '）' END AS notice FROM j""",
)
def status_endpoint_join(t: Tables):
    answers = t.events.select(
        F.col("event_id").cast("string").alias("external_id"),
        F.when(F.col("event_type") == "error", "9999").otherwise("0000").alias("code"),
        F.when(F.col("event_type") == "purchase", day("ts")).otherwise(F.lit(" ")).alias("full_quota_time"),
    )
    out = quota.join_status_endpoint(offers(t), answers, AS_OF)
    return out.select("seq", "full_quota_time", "api_unavailable", "api_skipped", "notice")


@query(
    "quota_exemption",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND ({NOTICE_STATUS_SQL}) = 'unknown_app_only' THEN 'not_marked_full' ELSE {NOTICE_STATUS_SQL} END AS quota_status FROM orders""",
)
def quota_exemption(t: Tables):
    page = notices(t).withColumn("adapter", F.when(F.col("o_orderkey") % 2 == 0, "shared_page").otherwise(""))
    return quota.exempt(quota.assess(page, "text"), "adapter", ("shared_page",)).select("o_orderkey", "quota_status")


@query(
    "evidence_assembly",
    f"""WITH r AS (SELECT o_orderkey, 'u' || o_orderkey AS url, 'api' || o_orderkey AS api,
  strftime(o_orderdate, '%Y/%-m/%-d') AS d, {NOTICE_STATUS_SQL} AS st, o_orderstatus AS s, o_orderpriority AS p, month(o_orderdate) AS m FROM orders),
e AS (SELECT o_orderkey, 0 AS pos, CASE WHEN st = 'sold_out' THEN api ELSE url END AS source_url,
  CASE WHEN st = 'sold_out' THEN 'activity_status_api' ELSE 'activity_page' END AS kind FROM r WHERE st <> 'not_marked_full'
UNION ALL SELECT o_orderkey, CASE WHEN st <> 'not_marked_full' THEN 1 ELSE 0 END, api, 'activity_status_api' FROM r WHERE p = '5-LOW')
SELECT * FROM e""",
)
def evidence_assembly(t: Tables):
    k = F.col("o_orderkey")
    df = quota.assess(notices(t), "text").select(
        "o_orderkey",
        "quota_excerpt",
        text("u", k).alias("url"),
        text("api", k).alias("api_url"),
        F.lit("").alias("fetched_at"),
        F.lit("").alias("content_hash"),
        F.lit("額滿公告】本活動").alias("notice"),
        F.when(F.col("o_orderpriority") == "5-LOW", "尚有名額").alias("available_notice"),
    )
    out = quota.build_evidence(df)
    return out.select("o_orderkey", F.posexplode("evidence").alias("pos", "e")).select("o_orderkey", "pos", "e.source_url", "e.kind")


@query(
    "review_flags",
    f"""WITH {OFFERS_SQL}, l AS (SELECT *, {lifecycle_sql()} AS lifecycle FROM offers)
SELECT seq, end_date IS NULL OR lifecycle = 'unknown' OR review_required OR quota_status = 'unknown_source_failure' AS review_required FROM l""",
)
def review_flags(t: Tables):
    df = (
        offers(t)
        .withColumn("date_confidence", F.when(F.col("end_date").isNull(), "low").otherwise("high"))
        .withColumn("text", F.when(F.col("review_required"), "note: x\nmonitor_review_required: true").otherwise("plain"))
        .transform(periods.with_lifecycle, AS_OF)
    )
    return quota.with_review_flag(df).select("seq", "review_required")


# ---------------------------------------------------------------- rewards


def reward_lines(t: Tables):
    """lineitem rendered as prose with a reward, a cap, a fee, a threshold and a budget."""
    pct = F.round(F.col("l_discount") * 100, 0).cast("int")
    fee = F.round(F.col("l_tax") * 100, 0).cast("int")
    amount = F.format_number("l_quantity", 0)
    body = (
        F.when(
            F.col("l_returnflag") == "A",
            text("消費享", pct, "%回饋，每人回饋上限", amount, "元，另收", fee, "%手續費；再加碼最高享", pct + 1, "％回饋"),
        )
        .when(F.col("l_returnflag") == "N", text("累積消費滿", amount, "元送", amount, "元優惠券，年利率", fee, "%。"))
        .otherwise(text("新戶贈NT$", F.format_number(F.col("l_quantity") * 100, 0), "現金回饋，活動總回饋上限50萬元"))
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.col("l_suppkey"), F.lit("").alias("title"), body.alias("conditions_summary"),
    )


REWARD_SQL = """rw AS (SELECT l_orderkey, l_linenumber, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN CAST(round(l_discount * 100, 0) AS DOUBLE) + 1 END AS max_reward_percent,
  CASE WHEN l_returnflag = 'N' THEN l_quantity WHEN l_returnflag = 'R' THEN l_quantity * 100 END AS fixed_reward_amount FROM lineitem)"""


@query("reward_lines", f"WITH {REWARD_SQL} SELECT l_orderkey, l_linenumber, max_reward_percent, fixed_reward_amount FROM rw")
def reward_lines_query(t: Tables):
    return rewards.with_rewards(rewards.activity_text(reward_lines(t))).select(
        "l_orderkey", "l_linenumber", "max_reward_percent", "fixed_reward_amount"
    )


@query(
    "reward_stats",
    f"""WITH {REWARD_SQL} SELECT l_suppkey, count(*) AS offers, count(max_reward_percent) AS with_percent, max(max_reward_percent) AS max_percent,
  round(avg(max_reward_percent), 6) AS avg_percent, round(median(max_reward_percent), 6) AS median_percent, max(fixed_reward_amount) AS max_fixed,
  count(*) FILTER (coalesce(max_reward_percent >= 10, false) OR coalesce(fixed_reward_amount >= 100, false)) AS high_return FROM rw GROUP BY l_suppkey""",
)
def reward_stats(t: Tables):
    scored = rewards.with_rewards(rewards.activity_text(reward_lines(t)))
    return rewards.reward_stats(scored, ["l_suppkey"])


@query(
    "percent_mentions",
    """WITH m AS (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS pos, round(l_discount * 100, 0) AS p, round(l_tax * 100, 0) AS f FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, pos, CASE pos WHEN 0 THEN p WHEN 1 THEN f ELSE p + 1 END AS value,
  CASE pos WHEN 0 THEN p > 0 WHEN 1 THEN false ELSE true END AS is_reward FROM m
UNION ALL SELECT l_orderkey, l_linenumber, 0, round(l_tax * 100, 0), false FROM lineitem WHERE l_returnflag = 'N'""",
)
def percent_mentions(t: Tables):
    prose = rewards.activity_text(reward_lines(t)).withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return rewards.percent_mentions(prose, "k", "prose").select("k.*", "pos", "value", "is_reward")


@query(
    "insight_records",
    f"""WITH {OFFERS_SQL}, i AS (SELECT seq, quota_status, CAST(floor(max_reward_percent) AS BIGINT) AS pct, date_diff('day', DATE '{AS_OF}', start_date) AS a, date_diff('day', DATE '{AS_OF}', end_date) AS b FROM offers),
f AS (SELECT *, pct > 0 AS has, pct >= 10 AS high, coalesce(a BETWEEN 1 AND 14, false) AS up, coalesce(b BETWEEN 0 AND 7, false) AS soon FROM i)
SELECT seq, CAST(a AS INTEGER) AS starts_in_days, CAST(b AS INTEGER) AS ends_in_days, up AS is_upcoming, soon AS is_expiring_soon, high AS is_high_return,
  array_to_string(list_filter([CASE WHEN high THEN '高回饋' END, CASE WHEN up THEN '即將開始' END, CASE WHEN soon THEN '即將結束' END,
    CASE quota_status WHEN 'sold_out' THEN '已額滿' WHEN 'partial_sold_out' THEN '部分額滿' WHEN 'unknown_app_only' THEN '需至 App 確認' END], lambda x: x IS NOT NULL), '|') AS tags,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN has THEN '最高 ' || pct || '% 回饋' || CASE WHEN high THEN '，屬高回饋活動' ELSE '' END END,
    CASE WHEN up THEN '將於 ' || a || ' 天後開始' WHEN a = 0 THEN '今天開始' END,
    CASE WHEN soon THEN CASE WHEN b = 0 THEN '今天截止' ELSE '將於 ' || b || ' 天後截止' END END,
    CASE quota_status WHEN 'sold_out' THEN '官方資訊顯示活動已額滿' WHEN 'partial_sold_out' THEN '部分期別或子活動已額滿' WHEN 'unknown_app_only' THEN '額滿狀態需至 App 確認' END], lambda x: x IS NOT NULL), '；'), ''),
    '尚未辨識出明確回饋幅度，請查看官方活動辦法') || '。' AS human_summary FROM f""",
)
def insight_records(t: Tables):
    df = offers(t).withColumn("conditions_summary", text("享", F.floor("max_reward_percent"), "%回饋"))
    out = rewards.with_insights(df.drop("max_reward_percent", "fixed_reward_amount"), AS_OF)
    return out.select(
        "seq", "starts_in_days", "ends_in_days", "is_upcoming", "is_expiring_soon", "is_high_return",
        F.array_join("insight_tags", "|").alias("tags"), "human_summary",
    )
