"""Queries over the supplement, highlights, calendar, catalogue search and facets."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.operators import publish, rewards, search
from offerlens.operators.coverage import per_run
from offerlens.operators.periods import with_lifecycle
from offerlens.plans.base import AS_OF, LIVE_SQL, OFFERS_SQL, Tables, day, offers, query, registry, text
from offerlens.session import new_table_dir, staged

# ---------------------------------------------------------------- supplement


def supplement(t: Tables):
    """supplier as curated offers: blank titles, foreign hosts, odd statuses, missing and past dates included."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    host = F.when(k % 7 == 0, text("https://shop", n, ".example.com.evil.org/x")).when(k % 7 == 1, text("http://shop", n, ".example.com/x")).otherwise(text("https://m.shop", n, ".example.com/x"))
    return t.supplier.select(
        text("p", n).alias("provider_id"),
        F.when(k % 11 == 0, " ").otherwise(F.col("s_name")).alias("title"),
        text(host, k).alias("url"),
        F.when(k % 3 == 0, k.cast("string")).alias("external_id"),
        F.lit("1998-05-01").alias("start_date"),
        F.when(k % 5 == 0, "1998-05-02").when(k % 5 == 1, "soon").otherwise("1999-01-01").alias("end_date"),
        F.when(k % 2 == 0, "sold_out").otherwise("weird").alias("quota_status"),
        F.lit("").alias("conditions_summary"),
        k.alias("seq"),
    )


@query(
    "supplement_accept",
    f"""WITH {OFFERS_SQL}, s AS (SELECT 'p' || s_nationkey AS provider_id, n_name AS provider_name, trim(s_name) AS title, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS ext, s_suppkey AS seq,
  CASE s_suppkey % 5 WHEN 0 THEN 'past' WHEN 1 THEN 'open' ELSE 'live' END AS term, CASE WHEN s_suppkey % 2 = 0 THEN 'sold_out' ELSE 'not_marked_full' END AS quota_status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 > 1 AND s_suppkey % 11 <> 0)
SELECT seq, provider_name, title, quota_status, term = 'open' AS review_required, 'active' AS lifecycle FROM s
WHERE term <> 'past' AND NOT EXISTS (SELECT 1 FROM offers o WHERE o.provider_id = s.provider_id AND o.external_id = s.ext)""",
)
def supplement_accept(t: Tables):
    providers, domains, _ = registry(t)
    out = publish.accept_supplement(supplement(t), offers(t), providers, domains, AS_OF)
    return out.select("seq", "provider_name", "title", "quota_status", "review_required", "lifecycle")


@query(
    "union_published",
    f"""WITH {OFFERS_SQL} SELECT provider_id, count(*) AS offers, CAST(sum(cur) AS BIGINT) AS curated FROM (SELECT provider_id, 0 AS cur FROM offers UNION ALL SELECT 'p' || s_nationkey, 1 FROM supplier) GROUP BY provider_id""",
)
def union_published(t: Tables):
    extra = supplement(t).select("provider_id", "title", "url", F.lit(1).alias("curated"))
    both = publish.union_published(offers(t), extra)
    return both.groupBy("provider_id").agg(F.count(F.lit(1)).alias("offers"), F.sum(F.coalesce("curated", F.lit(0))).alias("curated"))


# ---------------------------------------------------------------- highlights


def insight_offers(t: Tables):
    """Offers with insight flags; three neighbouring orders share one URL."""
    df = offers(t).withColumn("url", text("https://x.example.com/", F.floor(F.col("seq") / 3)))
    df = rewards.with_reward_flags(df).transform(rewards.with_timing, AS_OF)
    return df.withColumn("human_summary", text("s", F.col("seq"))).withColumn("conditions_summary", F.lit(""))


INSIGHT_SQL = f"""{OFFERS_SQL}, ins AS (SELECT seq, provider_name, title, 'https://x.example.com/' || (seq // 3) AS url, 's' || seq AS summary, quota_status IN ('sold_out', 'partial_sold_out') AS sold,
  max_reward_percent AS pct, floor(fixed_reward_amount) AS fix, max_reward_percent >= 10 OR fixed_reward_amount >= 100 AS high, start_date - DATE '{AS_OF}' AS a, end_date - DATE '{AS_OF}' AS b FROM offers),
c1 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pct DESC, fix DESC, seq) AS u FROM ins WHERE NOT sold AND high),
h1 AS (SELECT *, row_number() OVER (ORDER BY pct DESC, fix DESC, seq) AS r FROM c1 WHERE u = 1 QUALIFY r <= 3),
c2 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY a, seq) AS u FROM ins WHERE NOT sold AND a BETWEEN 1 AND 14 AND url NOT IN (SELECT url FROM h1)),
h2 AS (SELECT *, row_number() OVER (ORDER BY a, seq) AS r FROM c2 WHERE u = 1 QUALIFY r <= 2),
c3 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY b, seq) AS u FROM ins WHERE NOT sold AND b BETWEEN 0 AND 7 AND url NOT IN (SELECT url FROM h1 UNION ALL SELECT url FROM h2)),
h3 AS (SELECT *, row_number() OVER (ORDER BY b, seq) AS r FROM c3 WHERE u = 1 QUALIFY r <= 2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS u FROM ins WHERE sold AND url NOT IN (SELECT url FROM h1 UNION ALL SELECT url FROM h2 UNION ALL SELECT url FROM h3)),
h4 AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM c4 WHERE u = 1 QUALIFY r <= 2),
hl0 AS (SELECT 'high_return' AS kind, 0 AS kn, * FROM h1 UNION ALL SELECT 'upcoming', 1, * FROM h2 UNION ALL SELECT 'expiring', 2, * FROM h3 UNION ALL SELECT 'sold_out', 3, * FROM h4),
hl AS (SELECT kind, CAST(row_number() OVER (ORDER BY kn, r) - 1 AS INTEGER) AS pos, provider_name, title, summary, url FROM hl0 QUALIFY pos < 8)"""


@query("highlights_auto", f"WITH {INSIGHT_SQL} SELECT pos, kind, provider_name, title, summary, url FROM hl")
def highlights_auto(t: Tables):
    return publish.auto_highlights(insight_offers(t))


@query(
    "highlights_overlay",
    f"""WITH {INSIGHT_SQL}, l AS (SELECT url, max_by(kind, pos) AS highlight_kind, max_by(summary, pos) AS editorial_summary FROM hl GROUP BY url)
SELECT highlight_kind, editorial_summary, count(*) AS offers FROM ins LEFT JOIN l USING (url) GROUP BY ALL""",
)
def highlights_overlay(t: Tables):
    o = insight_offers(t)
    out = publish.overlay_highlights(o, publish.auto_highlights(o))
    return out.groupBy("highlight_kind", "editorial_summary").agg(F.count(F.lit(1)).alias("offers"))


CURATED_SQL = """cur AS (SELECT s_suppkey AS seq, 'ai_pick' AS kind, n_name AS provider_name, trim(s_name) AS title, 'sum ' || s_suppkey AS summary, 'https://m.shop' || s_nationkey || '.example.com/x' || s_suppkey AS url
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 > 1 AND s_suppkey % 11 <> 0 ORDER BY s_suppkey LIMIT 8)"""


def _curated(t: Tables):
    providers, domains, _ = registry(t)
    raw = supplement(t).join(providers.select("provider_id", F.col("name").alias("provider_name")), "provider_id").select(
        F.lit(None).cast("string").alias("kind"), "provider_id", "provider_name", "title", text("sum ", F.col("seq")).alias("summary"), "url", "seq"
    )
    return publish.curated_highlights(raw, providers, domains)


@query("highlights_curated", f"WITH {CURATED_SQL} SELECT * FROM cur")
def highlights_curated(t: Tables):
    return _curated(t)


@query("highlights_chosen", f"WITH {CURATED_SQL} SELECT kind, provider_name, title, summary, url, seq AS pos FROM cur")
def highlights_chosen(t: Tables):
    return publish.choose_highlights(_curated(t), publish.auto_highlights(insight_offers(t)))


# ---------------------------------------------------------------- calendar


CAL_SQL = f"""{LIVE_SQL},
fit AS (SELECT * FROM sectioned WHERE lifecycle <> 'ended' AND quota_status <> 'sold_out' AND end_date >= start_date),
mem AS (SELECT 'start' AS kind, start_date AS day, provider_name, title, url FROM fit UNION ALL SELECT 'end', end_date, provider_name, title, url FROM fit),
cal AS (SELECT kind, day, count(*) AS offers, list(provider_name || '｜' || title || chr(10) || url ORDER BY lower(provider_name), lower(title), url) AS ms FROM mem WHERE day >= DATE '{AS_OF}' GROUP BY ALL),
noun AS (SELECT *, CASE kind WHEN 'start' THEN '開跑' ELSE '截止' END AS noun FROM cal)"""


@query("calendar_members", f"WITH {CAL_SQL} SELECT kind, day, provider_name, title FROM mem WHERE day >= DATE '{AS_OF}'")
def calendar_members(t: Tables):
    live = with_lifecycle(offers(t), AS_OF)
    return publish.calendar_members(live, AS_OF).select("kind", "day", "provider_name", "title")


@query(
    "calendar_events",
    f"""WITH {CAL_SQL} SELECT kind, day, offers, offers || ' 檔優惠今日' || noun AS summary,
  CASE WHEN offers > 25 THEN '共 ' || offers || ' 檔優惠今日' || noun || '。完整清單：https://site.example.com/'
  ELSE '今日' || noun || '優惠：' || chr(10) || array_to_string(list_transform(ms, lambda m, i: i || '. ' || m), chr(10)) || chr(10) || chr(10) || '完整資訊：https://site.example.com/' || chr(10) || '實際優惠與名額以官方公告為準。' END AS description FROM noun""",
)
def calendar_events(t: Tables):
    live = with_lifecycle(offers(t), AS_OF)
    return publish.calendar_events(publish.calendar_members(live, AS_OF), "https://site.example.com/")


@query(
    "activities_per_provider",
    f"WITH {OFFERS_SQL}, c AS (SELECT provider_id, count(*) AS n FROM offers GROUP BY 1) SELECT 'p' || n_nationkey AS provider_id, n_name AS name, coalesce(n, 0) AS activity_count FROM nation LEFT JOIN c ON c.provider_id = 'p' || n_nationkey",
)
def activities_per_provider(t: Tables):
    return publish.activities_per_provider(offers(t), registry(t)[0]).select("provider_id", "name", "activity_count")


@query(
    "registry_per_run",
    "SELECT run_id, provider_id FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id FROM events) CROSS JOIN (SELECT 'p' || n_nationkey AS provider_id FROM nation)",
)
def registry_per_run(t: Tables):
    runs = t.events.select(day("ts").alias("run_id")).distinct()
    return per_run(runs, registry(t)[0].select("provider_id"))


# ---------------------------------------------------------------- search


def catalogue(t: Tables):
    df = with_lifecycle(offers(t), AS_OF)
    pct = F.floor("max_reward_percent")
    return df.withColumn("conditions_summary", text("回饋 ", pct, " % ", F.col("quota_status")))


def highlights(t: Tables):
    """The five offers that end last, as references by URL."""
    return offers(t).orderBy(F.col("end_date").desc_nulls_last(), "seq").limit(5).select("url", F.lit(None).cast("string").alias("title"))


SEARCH_SQL = f"""{LIVE_SQL},
hl AS (SELECT lower(url) AS ref FROM offers ORDER BY end_date DESC NULLS LAST, seq LIMIT 5),
cat AS (SELECT *, lower(provider_name || ' ' || title || ' ' || '回饋 ' || CAST(floor(max_reward_percent) AS BIGINT) || ' % ' || quota_status) AS search_text, floor(max_reward_percent) >= 10 AS cat_high_return,
  coalesce(start_date - DATE '{AS_OF}' BETWEEN 1 AND 14, false) AS cat_upcoming, coalesce(lifecycle <> 'ended' AND end_date - DATE '{AS_OF}' BETWEEN 0 AND 7, false) AS cat_ending,
  quota_status IN ('sold_out', 'partial_sold_out') AS cat_sold_out, lower(url) IN (SELECT ref FROM hl) AS is_explicit,
  start_date - DATE '{AS_OF}' AS a, end_date - DATE '{AS_OF}' AS b FROM sectioned),
sc AS (SELECT *, CASE WHEN is_explicit THEN 60 ELSE 0 END + CASE WHEN cat_high_return THEN 35 ELSE 0 END + CASE WHEN cat_upcoming THEN 22 ELSE 0 END + CASE WHEN cat_ending THEN 18 ELSE 0 END
  + CASE quota_status WHEN 'partial_sold_out' THEN 10 WHEN 'sold_out' THEN -25 ELSE 0 END AS score FROM cat)"""


@query("categories", f"WITH {SEARCH_SQL} SELECT seq, cat_high_return, cat_upcoming, cat_ending, cat_sold_out, is_explicit AS cat_featured, score FROM sc")
def categories(t: Tables):
    out = search.with_score(search.with_categories(catalogue(t), AS_OF, highlights(t)))
    return out.select("seq", "cat_high_return", "cat_upcoming", "cat_ending", "cat_sold_out", "cat_featured", "score")


@query(
    "search_results",
    f"""WITH {SEARCH_SQL}, f AS (SELECT *, cat_high_return OR cat_upcoming OR cat_ending OR quota_status = 'partial_sold_out' AS featured FROM sc)
SELECT seq, title, score - CASE WHEN is_explicit THEN 60 ELSE 0 END AS score FROM f WHERE provider_name = 'NATION_3' AND contains(search_text, 'offer 2-high') AND featured""",
)
def search_results(t: Tables):
    cats = search.with_score(search.with_categories(catalogue(t), AS_OF))
    hits = search.search(cats, "Offer 2-HIGH", "NATION_3", "featured")
    return search.order_results(hits, "featured").select("seq", "title", "score")


_RANKS = {"featured": "score DESC, ", "high-return": "score DESC, ", "ending": "end_date NULLS LAST, ", "all": ""}
_PICKS = {"featured": "(cat_high_return OR cat_upcoming OR cat_ending OR quota_status = 'partial_sold_out')", "high-return": "cat_high_return", "ending": "cat_ending", "all": "true"}


@query(
    "search_ranked",
    f"WITH {SEARCH_SQL}, plain AS (SELECT * REPLACE (score - CASE WHEN is_explicit THEN 60 ELSE 0 END AS score) FROM sc) "
    + " UNION ALL ".join(f"SELECT '{c}' AS category, seq, row_number() OVER (ORDER BY {_RANKS[c]}start_date NULLS LAST, title COLLATE zh, seq) AS rank FROM plain WHERE {_PICKS[c]}" for c in _RANKS),
)
def search_ranked(t: Tables):
    """The place of every result of four categories, titles in Chinese collation."""
    cats = staged(search.with_score(search.with_categories(catalogue(t), AS_OF)), "catalogue")
    parts = [search.rank_results(search.search(cats, "", "", c), c).select(F.lit(c).alias("category"), "seq", "rank") for c in _RANKS]
    return reduce(DataFrame.unionByName, parts)


_ASKED = ("Offer 2-HIGH", "nation_3 ", "% sold", "r 1", "回饋", "o", "no such words")


@query(
    "search_indexed",
    f"WITH {SEARCH_SQL} " + " UNION ALL ".join(f"SELECT '{q}' AS query, seq FROM cat WHERE contains(search_text, '{q.lower()}')" for q in _ASKED),
)
def search_indexed(t: Tables):
    """Look-ups of any length through the written index of grams, verified in the rows they lead to."""
    cat = staged(search.with_categories(catalogue(t), AS_OF), "catalogue")
    path = new_table_dir(t.spark, "postings")
    search.write_postings(cat, path, "seq")
    postings = t.spark.read.parquet(path)
    return reduce(DataFrame.unionByName, [search.search_indexed(cat, postings, "seq", q).select(F.lit(q).alias("query"), "seq") for q in _ASKED])


@query(
    "badges",
    f"""WITH {SEARCH_SQL} SELECT seq, CASE WHEN lifecycle = 'upcoming' AND a = 1 THEN '明日開始' WHEN lifecycle = 'upcoming' THEN a || ' 天後開始'
  WHEN cat_ending THEN CASE b WHEN 0 THEN '今日截止' WHEN 1 THEN '明日截止' ELSE '剩 ' || b || ' 天' END
  WHEN lifecycle = 'active' THEN '進行中' WHEN lifecycle = 'ended' THEN '已結束' ELSE '期間待確認' END AS badge FROM cat""",
)
def badges(t: Tables):
    return search.with_badge(search.with_categories(catalogue(t), AS_OF), AS_OF).select("seq", "badge")


@query(
    "provider_facets",
    f"""WITH {OFFERS_SQL}, n AS (SELECT CASE WHEN seq % 2 = 0 THEN upper(provider_name) ELSE lower(provider_name) || ' ' END AS n, 1 AS one FROM offers UNION ALL SELECT n_name, 0 FROM nation UNION ALL SELECT r_name, 0 FROM region)
SELECT lower(trim(n)) AS facet_key, min(trim(n)) AS provider_name, CAST(sum(one) AS BIGINT) AS offers FROM n GROUP BY 1""",
)
def provider_facets(t: Tables):
    name = F.col("provider_name")
    acts = offers(t).withColumn("provider_name", F.when(F.col("seq") % 2 == 0, F.upper(name)).otherwise(F.concat(F.lower(name), F.lit(" "))))
    names = t.nation.select(F.col("n_name").alias("name")).unionByName(t.region.select(F.col("r_name").alias("name")))
    return search.provider_facets(acts, names)


@query(
    "tile_counts",
    f"""WITH {SEARCH_SQL} SELECT count(*) FILTER (lifecycle <> 'ended') AS valid, count(*) FILTER (lifecycle <> 'ended' AND cat_high_return) AS high_return,
  count(*) FILTER (lifecycle <> 'ended' AND cat_upcoming) AS upcoming, count(*) FILTER (lifecycle <> 'ended' AND cat_sold_out) AS sold_out_reminder FROM cat""",
)
def tile_counts(t: Tables):
    return search.tile_counts(search.with_categories(catalogue(t), AS_OF))
