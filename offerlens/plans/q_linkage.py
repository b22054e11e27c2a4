"""Queries over announcement linkage."""

from pyspark.sql import functions as F

from offerlens.functions import titles
from offerlens.operators import linkage, quota
from offerlens.plans.base import STATUS_SQL, Tables, offer_status, query, text
from offerlens.session import spread, staged

SOLD, PART, NONE = "本活動回饋已全數額滿。", "7月份回饋已額滿。", "若額滿則停止回饋。"


def linked_offers(t: Tables):
    """Orders as offers of 25 providers; settled ones name their event id, all have a URL of their own."""
    k = F.col("o_orderkey")
    # Rows are dealt while they are narrow; identifiers, addresses and notices are costly behind it.
    df = spread(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")).select(
        k.cast("string").alias("activity_id"),
        text("p", k % 25).alias("provider_id"),
        text("https://s.example.com/offer?b=2&utm_source=x&a=", k).alias("url"),
        F.lit("").alias("title"),
        F.when(F.col("o_orderstatus") == "P", "no id").otherwise(text("EventId=E", k)).alias("text"),
        offer_status().alias("quota_status"),
    )
    slim = linkage.keyed_activities(df).select("activity_id", "canonical_url", "quota_status", "norm", "keys", "title_keys")
    return staged(slim, "offers")


def notices(t: Tables):
    """lineitem as announcements about its order, by id or by URL, some for another provider or on the offer's own page."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    verdict = F.when(F.col("l_returnflag") == "N", NONE).when(F.col("l_linestatus") == "F", SOLD).otherwise(PART)
    named = F.when(n % 2 == 0, text(" EventId=E", k)).otherwise(text(" 見 https://S.example.com/offer?a=", k, "&b=2#x."))
    own = (n == 1) & (F.col("l_returnflag") == "A")
    df = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")).select(
        text(k, "-", n).alias("announcement_id"),
        text("p", F.when(n == 7, (k + 1) % 25).otherwise(k % 25)).alias("provider_id"),
        F.when(own, text("https://s.example.com/offer?a=", k, "&b=2")).otherwise(text("https://s.example.com/news/", k, "-", n)).alias("url"),
        F.lit("").alias("title"),
        F.concat(verdict, named).alias("text"),
    )
    slim = linkage.keyed_announcements(quota.assess(df, "text")).select(
        "announcement_id", "canonical_url", "quota_status", "quota_excerpt", "quota_components", "norm", "keys", "title_keys"
    )
    return staged(slim, "notices")


NOTICES_SQL = f"""n AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linestatus = 'F' AS sold, CASE WHEN l_linenumber = 7 THEN (l_orderkey + 1) % 25 ELSE l_orderkey % 25 END AS pid,
  l_linenumber = 1 AND l_returnflag = 'A' AS own, l_linenumber % 2 = 0 AS by_id FROM lineitem WHERE l_returnflag <> 'N'),
o AS (SELECT o_orderkey AS k, o_orderkey % 25 AS pid, o_orderstatus <> 'P' AS has_id, {STATUS_SQL} AS quota_status FROM orders)"""


@query(
    "apply_matches",
    f"""WITH {NOTICES_SQL},
m AS (SELECT o.k, bool_or(sold) AS sold FROM o JOIN n ON n.k = o.k AND n.pid = o.pid AND NOT own AND (NOT by_id OR has_id) GROUP BY o.k)
SELECT CAST(o.k AS VARCHAR) AS activity_id, m.k IS NOT NULL AS matched,
  CASE WHEN coalesce(sold, false) OR quota_status = 'sold_out' THEN 'sold_out' WHEN m.k IS NOT NULL THEN 'partial_sold_out' ELSE quota_status END AS new_status,
  m.k IS NOT NULL AS quota_evidence_complete
FROM o LEFT JOIN m ON m.k = o.k""",
)
def apply_matches(t: Tables):
    return linkage.apply_matches(linked_offers(t), notices(t), with_titles=False).select("activity_id", "matched", "new_status", "quota_evidence_complete")


@query(
    "evidence_links",
    f"""WITH {NOTICES_SQL}, a AS (SELECT 'id' || chr(1) || 'p' || pid || chr(1) || 'e' || k AS key FROM o WHERE has_id
  UNION ALL SELECT 'url' || chr(1) || 'p' || pid || chr(1) || 'https://s.example.com/offer?a=' || k || '&b=2' FROM o),
b AS (SELECT CASE WHEN by_id THEN 'id' || chr(1) || 'p' || pid || chr(1) || 'e' || k ELSE 'url' || chr(1) || 'p' || pid || chr(1) || 'https://s.example.com/offer?a=' || k || '&b=2' END AS key, sold FROM n),
ac AS (SELECT key, count(*) AS offers FROM a GROUP BY key), bc AS (SELECT key, count(*) AS notices, count(*) FILTER (sold) AS sold_notices FROM b GROUP BY key)
SELECT key, offers, notices, sold_notices FROM ac JOIN bc USING (key)""",
)
def evidence_links(t: Tables):
    """Every (offer, announcement) pair as counts per shared key: both sides reduced before they meet."""
    a = linkage.activity_links(linked_offers(t)).groupBy("key").agg(F.count(F.lit(1)).alias("offers"))
    b = linkage.announcement_links(notices(t)).groupBy("key").agg(
        F.count(F.lit(1)).alias("notices"), F.count_if(F.col("quota_status") == "sold_out").alias("sold_notices")
    )
    return a.join(b, "key")


PAIRS_SQL = f"""WITH {NOTICES_SQL}, pairs AS (SELECT o.k, n.n, sold FROM o JOIN n ON n.k = o.k AND n.pid = o.pid AND NOT own AND (NOT by_id OR has_id))"""


@query(
    "announcement_evidence",
    f"""{PAIRS_SQL} SELECT CAST(k AS VARCHAR) AS activity_id, k || '-' || n AS announcement_id, 'latest_announcement:event_id_or_url:1.00' AS kind,
  CASE WHEN bool_and(sold) THEN 'sold_out' ELSE 'partial_sold_out' END AS quota_status, 1.0::DOUBLE AS score, 'https://s.example.com/news/' || k || '-' || n AS source_url
FROM pairs GROUP BY k, n""",
)
def announcement_evidence(t: Tables):
    acts, anns = linked_offers(t), notices(t)
    out = linkage.evidence_of(acts.select("activity_id", "canonical_url", "norm"), linkage.activity_links(acts), linkage.announcement_links(anns))
    return out.select("activity_id", "announcement_id", "kind", "quota_status", "score", "source_url")


@query(
    "announcement_components",
    f"""{PAIRS_SQL} SELECT DISTINCT CAST(k AS VARCHAR) AS activity_id, 'sold_out' AS status, '07月' AS period, '7月份回饋已額滿。' AS evidence FROM pairs WHERE NOT sold""",
)
def announcement_components(t: Tables):
    acts, anns = linked_offers(t), notices(t)
    out = linkage.components_of(acts.select("activity_id", "canonical_url", "norm"), linkage.activity_links(acts), linkage.announcement_links(anns))
    return out.select("activity_id", "status", "period", "evidence")


# ---------------------------------------------------------------- titles


def part_titles(t: Tables):
    """Offers titled by part name, notices by type and name; months from the size."""
    size = F.col("p_size")
    base = t.part.select(
        F.col("p_partkey").alias("k"), F.col("p_brand").alias("provider_id"), "p_name", "p_type", (size % 12 + 1).alias("month"), size.alias("size")
    )
    acts = base.select(
        F.col("k").cast("string").alias("activity_id"),
        "provider_id",
        text("https://a.example.com/", F.col("k")).alias("url"),
        F.col("p_name").alias("title"),
        F.when(F.col("size") % 2 == 0, text(F.col("month"), "月")).otherwise("").alias("text"),
        F.lit("not_marked_full").alias("quota_status"),
    )
    anns = base.select(
        text("n", F.col("k")).alias("announcement_id"),
        "provider_id",
        text("https://n.example.com/", F.col("k")).alias("url"),
        text(F.col("p_type"), " ", F.col("p_name")).alias("title"),
        F.concat(F.when(F.col("size") % 3 == 0, F.lit(PART)).otherwise(F.lit(SOLD)), F.when(F.col("size") % 3 == 1, text(" 2026/", F.col("month"), "/1")).otherwise("")).alias("text"),
    )
    keyed = linkage.keyed_activities(acts), linkage.keyed_announcements(quota.assess(anns, "text"))
    return staged(keyed[0], "parts"), staged(keyed[1], "part-notices")


_CORE = "regexp_replace(lower(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g')), '[0-9]', '', 'g')"
CORES_SQL = f"""a AS (SELECT DISTINCT p_brand AS provider_id, {_CORE.format(x='p_name')} AS a_core FROM part),
n AS (SELECT DISTINCT p_brand AS provider_id, {_CORE.format(x="p_type || p_name")} AS n_core FROM part)"""


@query(
    "link_titles_contained",
    f"""WITH {CORES_SQL} SELECT a.provider_id, a_core, n_core FROM a JOIN n USING (provider_id)
WHERE (length(a_core) >= 3 AND contains(n_core, a_core)) OR (length(n_core) >= 3 AND contains(a_core, n_core))""",
)
def link_titles_contained(t: Tables):
    acts, anns = part_titles(t)
    return linkage.contained_cores(acts, anns)


# The matching-block ratio as SQL: the longest common block of two titles (earliest in the first, then in the second), then
# the same to its left and to its right, until nothing is shared. A block is coded as length * 1000 + 999 - place.
_BLOCK = """coalesce(list_max(flatten(list_transform(range(1, length({a}) + 1), lambda k: list_transform(range(1, length({a}) - k + 2),
  lambda i: CASE WHEN contains({b}, substr({a}, i, k)) THEN k * 1000 + 999 - i END)))), 0)"""
_CHARACTERS = "list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) || '#' || length(list_filter(string_split(substr({x}, 1, i), ''), lambda c: c = substr({x}, i, 1))))"


def ratio_sql(left: str, right: str) -> str:
    """CTEs that end in ``alike``: (provider_id, a_norm, n_norm, score) of distinct titles (provider_id, norm) that reach the ratio."""
    share = linkage.RATIO / 2
    return f"""a_titles AS MATERIALIZED (SELECT provider_id, norm, {_CHARACTERS.format(x="norm")} AS chars FROM (SELECT DISTINCT provider_id, norm FROM {left} WHERE norm <> '')),
n_titles AS MATERIALIZED (SELECT provider_id, norm, {_CHARACTERS.format(x="norm")} AS chars FROM (SELECT DISTINCT provider_id, norm FROM {right} WHERE norm <> '')),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, a.provider_id, a.norm AS a_norm, n.norm AS n_norm, len(a.chars) + len(n.chars) AS both_chars
  FROM a_titles a JOIN n_titles n ON n.provider_id = a.provider_id AND least(len(a.chars), len(n.chars)) >= {share} * (len(a.chars) + len(n.chars)) - 1e-9
  WHERE len(list_intersect(a.chars, n.chars)) >= {share} * (len(a.chars) + len(n.chars)) - 1e-9),
blocks AS (SELECT id, a_norm AS a, n_norm AS b, {_BLOCK.format(a="a_norm", b="n_norm")} AS block FROM pairs
  UNION ALL SELECT id, a, b, {_BLOCK.format(a="a", b="b")} FROM (
    SELECT id, part.a AS a, part.b AS b FROM (
      SELECT id, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS part FROM (
        SELECT id, a, b, k, i, instr(b, substr(a, i, k)) AS j FROM (SELECT id, a, b, block // 1000 AS k, 999 - block % 1000 AS i FROM blocks WHERE block > 0))))
  WHERE a <> '' AND b <> ''),
alike AS MATERIALIZED (SELECT provider_id, a_norm, n_norm, 2 * matched / both_chars AS score FROM pairs JOIN (SELECT id, sum(block // 1000) AS matched FROM blocks GROUP BY id) USING (id)
  WHERE 2 * matched / both_chars >= {linkage.RATIO})"""


_NORM = "lower(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
PART_TITLES_SQL = f"""acts AS MATERIALIZED (SELECT p_partkey AS k, p_brand AS provider_id, {_NORM.format(x="p_name")} AS norm, {_CORE.format(x="p_name")} AS core,
  CASE WHEN p_size % 2 = 0 THEN p_size % 12 + 1 END AS month FROM part),
anns AS MATERIALIZED (SELECT p_partkey AS k, p_brand AS provider_id, {_NORM.format(x="p_type || p_name")} AS norm, {_CORE.format(x="p_type || p_name")} AS core,
  CASE p_size % 3 WHEN 0 THEN 7 WHEN 1 THEN p_size % 12 + 1 END AS month, p_size % 3 <> 0 AS sold FROM part)"""


@query("link_titles_similar", f"WITH RECURSIVE {PART_TITLES_SQL}, {ratio_sql('acts', 'anns')} SELECT provider_id, a_norm, n_norm, round(score, 6) AS score FROM alike")
def link_titles_similar(t: Tables):
    """Similar part titles of one brand."""
    acts, anns = part_titles(t)
    out = linkage.similar_titles(acts, anns)
    return out.select("provider_id", "a_norm", "n_norm", F.round("score", 6).alias("score"))


_LINE = f"coalesce(list_filter(string_split(text, chr(10)), lambda x: length(x) BETWEEN 4 AND 120)[1], '{titles.UNKNOWN_TITLE}')"
_BARE = f"regexp_replace({_LINE}, '{titles.NOTICE_BRACKET}', '', 'g')"
DOCUMENT_TITLES_SQL = f"""lines AS MATERIALIZED (SELECT source AS provider_id,
  regexp_replace(lower(regexp_replace({_BARE}, '[^0-9A-Za-z\u4e00-\u9fff]', '', 'g')), '{titles.NOTICE_WORDS}', '', 'g') AS norm FROM documents)"""


@query("link_document_titles", f"WITH RECURSIVE {DOCUMENT_TITLES_SQL}, {ratio_sql('lines', 'lines')} SELECT provider_id, a_norm, n_norm, round(score, 6) AS score FROM alike")
def link_document_titles(t: Tables):
    """Similar titles among the documents of a source; the title is the first fitting line."""
    title = titles.best_title(F.lit(""), F.lit(""), F.col("text"))
    lines = t.documents.select(
        F.col("source").alias("provider_id"), titles.normal_title(title).alias("norm")
    ).filter("norm <> ''")
    return linkage.similar_titles(lines, lines).select("provider_id", "a_norm", "n_norm", F.round("score", 6).alias("score"))


_MONTHS = "(a.month IS NULL OR n.month IS NULL OR a.month = n.month)"
_INSIDE = "((length(a.core) >= 3 AND contains(n.core, a.core)) OR (length(n.core) >= 3 AND contains(a.core, n.core)))"


@query(
    "apply_title_matches",
    f"""WITH RECURSIVE {PART_TITLES_SQL}, {ratio_sql("acts", "anns")},
n AS (SELECT provider_id, norm, core, month, bool_or(sold) AS sold FROM anns GROUP BY ALL),
a AS (SELECT provider_id, norm, core, month FROM acts GROUP BY ALL),
hit AS (SELECT a.provider_id, a.norm, a.core, a.month, bool_or(n.sold) AS sold FROM a JOIN n ON n.provider_id = a.provider_id AND {_MONTHS}
  LEFT JOIN alike s ON s.provider_id = a.provider_id AND s.a_norm = a.norm AND s.n_norm = n.norm WHERE s.score IS NOT NULL OR {_INSIDE} GROUP BY ALL)
SELECT CAST(k AS VARCHAR) AS activity_id, hit.sold IS NOT NULL AS matched, CASE WHEN hit.sold THEN 'sold_out' WHEN NOT hit.sold THEN 'partial_sold_out' ELSE 'not_marked_full' END AS new_status
FROM acts LEFT JOIN hit ON hit.provider_id = acts.provider_id AND hit.norm = acts.norm AND hit.core = acts.core AND hit.month IS NOT DISTINCT FROM acts.month""",
)
def apply_title_matches(t: Tables):
    """Statuses from title matches alone: ratio or containment, months not in conflict."""
    acts, anns = part_titles(t)
    return linkage.apply_matches(acts, anns).select("activity_id", "matched", "new_status")


def _key_sql(kind: str) -> str:
    return f"'{kind}' || chr(1) || n.provider_id || chr(1) || n.{kind} || chr(1) || coalesce(CAST(pow(2, n.month - 1) AS INTEGER), 0)"


@query(
    "title_evidence_links",
    f"""WITH RECURSIVE {PART_TITLES_SQL}, {ratio_sql("acts", "anns")}
SELECT DISTINCT CAST(a.k AS VARCHAR) AS activity_id, {_key_sql("norm")} AS key, 'normalized_title_period' AS method, round(s.score, 6) AS score
FROM acts a JOIN alike s ON s.provider_id = a.provider_id AND s.a_norm = a.norm JOIN anns n ON n.provider_id = a.provider_id AND n.norm = s.n_norm AND {_MONTHS}
UNION ALL SELECT DISTINCT CAST(a.k AS VARCHAR), {_key_sql("core")}, 'normalized_title_period', NULL
FROM acts a JOIN (SELECT DISTINCT provider_id, core, month FROM anns WHERE length(core) >= 3) n ON n.provider_id = a.provider_id AND {_MONTHS} AND length(a.core) >= 3 AND {_INSIDE}""",
)
def title_evidence_links(t: Tables):
    """Evidence by title as (offer, announcement key) rows: one for all announcements of a title form and month set."""
    acts, anns = part_titles(t)
    links = linkage.activity_links(acts.withColumn("keys", F.expr("cast(array() as array<string>)")), linkage.title_links(acts, anns))
    return links.select("activity_id", "key", "method", F.round("score", 6).alias("score"))
