"""Queries over URL, identity and key operators."""

from pyspark.sql import functions as F

from offerlens.functions import urls
from offerlens.operators import keys
from offerlens.plans.base import OFFERS_SQL, Tables, offers, query, text

CANONICAL_SQL = r"""lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
  || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END"""


def canonical_sql(u: str) -> str:
    """Canonical URL for plain ASCII queries in DuckDB."""
    q = (
        "list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT "
        "regexp_matches(lower(x), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid)(=|$)')))"
    ).format(u=u)
    return CANONICAL_SQL.format(u=u, q=q)


@query("url_canonical", f"SELECT page_id, {canonical_sql('url')} AS canonical_url FROM pages")
def url_canonical(t: Tables):
    return keys.with_canonical_url(t.pages, "url").select("page_id", "canonical_url")


@query(
    "url_allowed_semi",
    r"""WITH p AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, url,
  lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages),
d(lang, domain) AS (VALUES ('en', 'example.com'), ('en', 'example.org'), ('fr', 'example.net'), ('de', 'Example.org.'), ('es', 'le.com'))
SELECT page_id, lang AS provider_id FROM p WHERE EXISTS (SELECT 1 FROM d WHERE d.lang = p.lang
  AND (host = lower(rtrim(domain, '.')) OR ends_with(host, '.' || lower(rtrim(domain, '.')))))""",
)
def url_allowed_semi(t: Tables):
    rows = [("en", "example.com"), ("en", "example.org"), ("fr", "example.net"), ("de", "Example.org."), ("es", "le.com")]
    domains = t.spark.createDataFrame(rows, "provider_id string, domain string")
    pages = t.pages.select("page_id", "url", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("provider_id"))
    return keys.filter_allowed(pages, "url", domains).select("page_id", "provider_id")


@query(
    "url_external_id",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'offer-' || o_orderkey || '_x1'
  WHEN 2 THEN 'n' || o_orderkey END AS external_id FROM orders""",
)
def url_external_id(t: Tables):
    k = F.col("o_orderkey")
    url = (
        F.when(k % 4 == 0, text("https://a.example.com/deals?id=0&EventId=", k, "#top"))
        .when(k % 4 == 1, text("https://a.example.com/deals/offer-", k, "_x1/"))
        .when(k % 4 == 2, text("https://a.example.com/go/?EventId=&nID=n", k))
        .otherwise(text("https://a.example.com/x", k, ".html?ref=1"))
    )
    return keys.with_external_id(t.orders.select("o_orderkey", url.alias("url")), "url").select("o_orderkey", "external_id")


@query(
    "url_event_id",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS event_id FROM orders""",
)
def url_event_id(t: Tables):
    k = F.col("o_orderkey")
    good, bad = "https://offers.example.com/page?x=1&EventId=", "https://offers.example.com/other?EventId="
    url = F.when(F.col("o_orderstatus") == "F", text(good, k)).when(F.col("o_orderstatus") == "P", text(bad, k)).otherwise(text(good, "a", k))
    df = t.orders.select("o_orderkey", url.alias("url"))
    return keys.with_event_id(df, "url", "offers.example.com", "/page").select("o_orderkey", "event_id")


@query(
    "url_identifiers",
    """SELECT o_orderkey, 'e' || o_orderkey AS identifier FROM orders
UNION ALL SELECT o_orderkey, 'n' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'zz-' || o_orderkey FROM orders WHERE o_orderstatus <> 'O'""",
)
def url_identifiers(t: Tables):
    k = F.col("o_orderkey")
    url = text("https://a.example.com/?EVENTID=E", k, "&ref=1&nid=N", F.col("o_custkey"))
    body = F.when(F.col("o_orderstatus") == "O", text("EventId = e", k)).otherwise(text("活動編號：ZZ-", k, " EventId=e", k))
    df = t.orders.select("o_orderkey", url.alias("url"), body.alias("text"))
    return keys.event_identifiers(df, "o_orderkey", "url", "text")


@query(
    "activity_key",
    f"""WITH {OFFERS_SQL}
SELECT seq, substr(sha256(provider_id || chr(0) || 'id:' || external_id), 1, 24) AS store_key,
  substr(sha256(provider_id || chr(0) || ({canonical_sql('url')})), 1, 24) AS url_key,
  substr(sha256(provider_id || chr(0) || 'url:' || url), 1, 24) AS publish_key,
  substr(sha256(provider_id || chr(0) || external_id), 1, 24) AS digest_key,
  sha256(title || chr(10) || url) AS content_hash FROM offers""",
)
def activity_key(t: Tables):
    df = offers(t).select("seq", "provider_id", "provider_name", "external_id", "url", "title")
    bare = F.lit(None).cast("string")
    df = keys.with_activity_id(df, "store", "store_key")
    df = keys.with_activity_id(df, "digest", "digest_key")
    df = keys.with_content_hash(df, ["title", "url"])
    df = df.withColumn("external_id", bare)
    df = keys.with_activity_id(df, "store", "url_key")
    df = keys.with_activity_id(df, "publish", "publish_key")
    return df.select("seq", "store_key", "url_key", "publish_key", "digest_key", "content_hash")


@query(
    "alias_reconcile",
    """WITH h AS (SELECT p_partkey AS seq, CASE WHEN p_brand = 'Brand#1' THEN 'jkopay' ELSE p_brand END AS provider_id,
  'slug' || (p_partkey // 2) AS bare, CASE p_size % 3 WHEN 0 THEN 'campaign-' WHEN 1 THEN 'Event-' ELSE '' END AS prefix FROM part),
a AS (SELECT *, prefix <> '' AND provider_id = 'jkopay' AS is_alias, CASE WHEN provider_id = 'jkopay' THEN bare ELSE prefix || bare END AS external_id FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY provider_id, external_id ORDER BY is_alias, seq) AS rn FROM a)
SELECT seq, provider_id, external_id, substr(sha256(provider_id || chr(0) || 'id:' || external_id), 1, 24) AS activity_id FROM r WHERE rn = 1""",
)
def alias_reconcile(t: Tables):
    prefix = F.when(F.col("p_size") % 3 == 0, "campaign-").when(F.col("p_size") % 3 == 1, "Event-").otherwise("")
    df = t.part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_brand") == "Brand#1", "jkopay").otherwise(F.col("p_brand")).alias("provider_id"),
        text(prefix, "slug", F.floor(F.col("p_partkey") / 2)).alias("external_id"),
    )
    out = keys.reconcile_aliases(df, "jkopay", "campaign|event")
    return out.select("seq", "provider_id", "external_id", "activity_id")


@query(
    "url_resolve",
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS absolute FROM l""",
)
def url_resolve(t: Tables):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1)))
    df = t.pages.select("page_id", "url", hrefs.alias("href"))
    return df.select("page_id", "href", urls.resolve_url(F.col("href"), F.col("url")).alias("absolute"))


