"""Queries over capture, document, link and listing operators."""

from pyspark.sql import functions as F

from offerlens.operators import extract
from offerlens.operators.coverage import listing_yield
from offerlens.plans.base import AS_OF, PAGE_SIZE, Tables, day, order_pages, query, text
from offerlens.plans.q_quota import SENTENCES_SQL
from offerlens.plans.q_urls import canonical_sql
from offerlens.sources import captures

# ---------------------------------------------------------------- captures


@query(
    "capture_gate",
    """SELECT page_id, octet_length(encode(html)) AS body_bytes, octet_length(encode(html)) <= 20000 AS accepted, sha256(html) AS content_hash FROM pages""",
)
def capture_gate(t: Tables):
    good, bad = captures.gate_captures(t.pages, "html", 20_000)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.select("page_id", F.col("body_bytes").cast("bigint").alias("body_bytes"), "accepted", "content_hash")


@query(
    "format_split",
    """SELECT format, count(*) AS captures, CAST(sum(length(body)) AS BIGINT) AS chars FROM (
  SELECT 'html' AS format, html AS body FROM pages UNION ALL SELECT 'json', props FROM events) GROUP BY format""",
)
def format_split(t: Tables):
    both = t.pages.select(F.col("html").alias("text")).unionByName(t.events.select(F.col("props").alias("text")))
    return extract.split_by_format(both, "text", None).groupBy("format").agg(
        F.count(F.lit(1)).alias("captures"), F.sum(F.length("text")).alias("chars")
    )


# ---------------------------------------------------------------- pages


def documents(t: Tables):
    return extract.resolve_titles(extract.extract_pages(t.pages, "page_id", "url", "html"))


_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"


def _plain(x: str) -> str:
    return _PLAIN.format(x=x).replace('\\"', '"')


TITLE_SQL = _plain("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
HEAD_SQL = _plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")


@query(
    "page_extract",
    f"""SELECT page_id, 'ok' AS status, {TITLE_SQL} AS raw_title, {HEAD_SQL} AS heading,
  CAST(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS INTEGER) AS n_links FROM pages""",
)
def page_extract(t: Tables):
    d = extract.extract_pages(t.pages, "page_id", "url", "html", ("raw_title", "heading", "links"))
    return d.select("page_id", "status", "raw_title", "heading", F.size("links").alias("n_links"))


# Text rebuilt with regexes only: hidden elements and comments out, block tags to line breaks, entities decoded.
TEXT_SQL = r"""raw AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript|svg|template)[^>]*>.*?</(script|style|noscript|svg|template)>', '', 'gs'), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs') AS h FROM pages),
cut AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|section|table|td|th|tr|ul)(\s[^>]*)?/?>', chr(10), 'g'), '<[a-zA-Z/][^>]*>', '', 'g') AS h FROM raw),
dec AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS h FROM cut),
lines AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM dec)"""


@query(
    "page_text",
    f"""WITH {TEXT_SQL} SELECT page_id, len(ls) AS n_lines, sha256(array_to_string(ls, chr(10))) AS text_hash FROM lines""",
)
def page_text(t: Tables):
    d = extract.extract_pages(t.pages, "page_id", "url", "html", ("text",))
    return d.select(
        "page_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), F.sha2("text", 256).alias("text_hash")
    )


LINKS_SQL = r"""l AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '<a href="([^"]*)">.*?</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2)) AS anchor,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">.*?</a>', 1), 1) - 1 AS pos FROM pages),
edges AS (SELECT page_id, url, html, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS link_url, anchor FROM l)"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, link_url, anchor FROM edges")
def page_links(t: Tables):
    d = extract.extract_pages(t.pages, "page_id", "url", "html", ("links",))
    return extract.link_edges(d, "page_id", "url").select("page_id", "pos", "link_url", "anchor")


@query(
    "link_indegree",
    f"WITH {LINKS_SQL} SELECT {canonical_sql('link_url')} AS target, count(*) AS links, count(DISTINCT page_id) AS pages FROM edges GROUP BY 1",
)
def link_indegree(t: Tables):
    from offerlens.functions.urls import canonical_url

    d = extract.extract_pages(t.pages, "page_id", "url", "html", ("links",))
    edges = extract.link_edges(d, "page_id", "url").select("page_id", canonical_url(F.col("link_url")).alias("target"))
    # Count per (target, page) first: the distinct count then adds up small rows.
    per_page = edges.groupBy("target", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("target").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))


PATTERNS = {"en": ["/t", "and$"], "fr": ["/[l-q]"], "de": ["(?:ein|und)"], "es": ["[aeiou]n"]}
_WANTED = " OR ".join(
    "(lang = '{}' AND regexp_matches(link_url || chr(10) || anchor, '(?i){}'))".format(k, "|".join(f"(?:{p})" for p in v))
    for k, v in PATTERNS.items()
)


@query(
    "listing_links",
    f"""WITH {LINKS_SQL}, c AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, url, pos, link_url, anchor, {canonical_sql('link_url')} AS canonical_url, {canonical_sql('url')} AS own FROM edges),
h AS (SELECT * FROM c WHERE ({_WANTED}) AND canonical_url <> own),
f AS (SELECT page_id, lang, canonical_url, min(pos) AS first_pos, min_by(anchor, pos) AS anchor FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos, count(*) OVER (PARTITION BY page_id) AS total_found FROM f)
SELECT lang AS source_id, CAST(pos AS INTEGER) AS pos, canonical_url, anchor, CAST(total_found AS INTEGER) AS total_found FROM r WHERE pos < CASE lang WHEN 'en' THEN 2 ELSE 4 END""",
)
def listing_links(t: Tables):
    pages = t.pages.withColumn("source_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    d = extract.extract_pages(pages, "page_id", "url", "html", ("links",), keep=("source_id",))
    limits = {"en": 2, "fr": 4, "de": 4, "es": 4}
    out = extract.discover_links(d, PATTERNS, limits, "source_id", "url")
    return out.select("source_id", "pos", "canonical_url", "anchor", "total_found")


@query(
    "event_links",
    """SELECT page_id, o_orderkey AS event_id, (o_orderkey % 20) * 2 AS pos FROM (SELECT o_orderkey, o_orderkey // 20 AS page_id, o_orderkey % 20 AS n FROM orders) WHERE n <> 3""",
)
def event_links(t: Tables):
    """Hub pages that link each offer twice and themselves once."""
    k = F.col("o_orderkey")
    a = lambda anchor: text('<a href="/page?EventId=', k, '">', anchor, "</a>")
    pages = order_pages(t, F.concat(a("first"), a("again"))).select(
        "page_id", "items", F.lit("https://offers.example.com/hub").alias("url"), (F.col("page_id") * PAGE_SIZE + 3).cast("string").alias("own_id")
    )
    d = extract.extract_pages(pages, "page_id", "url", "items", ("links",), keep=("own_id",))
    edges = d.select("page_id", "own_id", F.posexplode("links").alias("pos", "l")).select(
        "page_id", "own_id", "pos", F.col("l.url").alias("link_url"), F.col("l.anchor").alias("anchor")
    )
    out = extract.discover_event_links(edges, "page_id", "own_id", "offers.example.com", "/page")
    return out.select("page_id", F.col("event_id").cast("bigint").alias("event_id"), F.col("pos").cast("bigint").alias("pos"))


# ---------------------------------------------------------------- JSON payloads


LISTING = extract.ListingSpec(
    "struct<body:struct<recommendedCampaigns:array<struct<systemSeq:string,title:string,startDate:string>>,"
    "normalCampaigns:array<struct<systemSeq:string,title:string,startDate:string>>>>",
    ("body.recommendedCampaigns", "body.normalCampaigns"),
    {"external_id": "systemSeq", "title": "title", "start_text": "startDate"},
)


def json_listings(t: Tables):
    item = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("systemSeq"),
            text("offer ", F.col("o_orderpriority")).alias("title"),
            day("o_orderdate").alias("startDate"),
        )
    )
    pages = order_pages(t, item, ",")
    return pages.select("page_id", text('{"body":{"normalCampaigns":[', F.col("items"), '],"other":[{"systemSeq":"x"}]}}').alias("text"))


@query(
    "json_listing",
    """SELECT o_orderkey // 20 AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 20 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
  CAST(o_orderkey AS VARCHAR) AS external_id, 'offer ' || o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS start_text FROM orders""",
)
def json_listing(t: Tables):
    return extract.explode_listing(json_listings(t), LISTING, ["page_id"])


@query(
    "listing_yield",
    """WITH p AS (SELECT page_id, greatest(len(regexp_extract_all(html, '<a href="')) - 5, 0) AS n FROM pages)
SELECT page_id, 'over' AS mode, least(n, 1) AS discovered_count, CASE WHEN n = 0 THEN 'listing_zero_discovery' WHEN n > 1 THEN 'listing_reached_max_links' END AS coverage_issue FROM p
UNION ALL SELECT page_id, 'reached', least(n, 1), CASE WHEN n = 0 THEN 'listing_zero_discovery' WHEN n >= 1 THEN 'listing_reached_max_links' END FROM p""",
)
def listing_yield_query(t: Tables):
    n = F.greatest(F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))) - 5, F.lit(0))
    p = t.pages.select("page_id", n.cast("bigint").alias("total_found"), F.lit(1).cast("bigint").alias("max_links"))
    a, b = (listing_yield(p, mode=m).withColumn("mode", F.lit(m)) for m in ("over", "reached"))
    return a.unionByName(b).select("page_id", "mode", "discovered_count", "coverage_issue")


def details(t: Tables):
    k = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    k.cast("string").alias("systemSeq"),
                    F.when(k % 3 == 0, text("<b>Offer</b> &amp; more ", k)).otherwise(text("Offer ", k)).alias("title"),
                    text("<p>first ", k, '</p><p>see <a href="/x', k, '">here</a></p>').alias("content"),
                    F.lit("hidden").alias("secretKey"),
                ).alias("campaignDetail"),
                F.array(F.struct(F.lit("（活動額滿）other").alias("title"))).alias("recommendedCampaigns"),
            ).alias("body")
        )
    )
    return t.orders.select(k.alias("doc_id"), F.lit("https://a.example.com/d/").alias("final_url"), body.alias("text"))


@query(
    "json_documents",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Offer &amp; more ' || o_orderkey ELSE 'Offer ' || o_orderkey END AS raw_title,
  'systemSeq: ' || o_orderkey || chr(10) || 'title: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Offer & more ' || o_orderkey ELSE 'Offer ' || o_orderkey END || chr(10)
  || 'content: first ' || o_orderkey || chr(10) || 'see here' AS text, 'https://a.example.com/x' || o_orderkey AS link FROM orders""",
)
def json_documents(t: Tables):
    d = extract.flatten_json(details(t))
    return d.select("doc_id", "raw_title", "text", F.get("links", 0)["url"].alias("link"))


@query(
    "json_detail",
    """SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS seq_text, CASE WHEN o_orderkey % 3 = 0 THEN '<b>Offer</b> &amp; more ' || o_orderkey ELSE 'Offer ' || o_orderkey END AS title FROM orders""",
)
def json_detail(t: Tables):
    d = extract.select_detail(details(t))
    return d.select("doc_id", F.col("detail.systemSeq").alias("seq_text"), F.col("detail.title").alias("title"))


@query(
    "json_titles",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Best ' || o_orderkey WHEN 1 THEN 'Second ' || o_orderkey ELSE 'Named ' || o_orderkey END AS title FROM orders""",
)
def json_titles(t: Tables):
    k = F.col("o_orderkey")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = F.array(
        pair("name", text("Named ", k)),
        pair("Subject", F.when(k % 3 == 1, text("<i>Second</i> ", k)).otherwise(F.lit("x"))),
        pair("activity_title", F.when(k % 3 == 0, text("Best  ", k)).otherwise(F.lit(""))),
        pair("other", F.lit("never this one")),
    )
    rows = t.orders.select(k.alias("doc_id"), F.posexplode(pairs).alias("pos", "p")).select("doc_id", "pos", "p.*")
    return extract.json_titles(rows)


# ---------------------------------------------------------------- HTML listings


_CARD_LIVE = f"CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR + INTERVAL 30 DAY >= DATE '2027-06-01'"


def _shown(extra_days: int = 0):
    """Order dates moved to years the period parser accepts."""
    return F.date_add(F.add_months("o_orderdate", 348), extra_days)


@query(
    "cards_anchor",
    f"""SELECT o_orderkey // 20 AS page_id, CAST(o_orderkey AS VARCHAR) AS card_id, 'Card & ' || o_orderkey AS title,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR AS DATE) AS start_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR + INTERVAL 30 DAY AS DATE) AS end_date
FROM orders WHERE {_CARD_LIVE}""",
)
def cards_anchor(t: Tables):
    k = F.col("o_orderkey")
    card = text(
        '<a class="c" href="/benefit/content.php?id=', k, '"><p class="x title">Card &amp; ', k, '</p><p class="date">',
        day(_shown(), "yyyy/MM/dd"), " ~ ", day(_shown(30), "yyyy/M/d"), "</p></a>",
    )
    pages = order_pages(t, F.concat(card, card)).withColumnRenamed("items", "text")
    cards = extract.explode_cards(pages, extract.CARD_SPECS["anchor_cards"], ["page_id"])
    return extract.live_cards(cards, "page_id", "2027-06-01").select("page_id", "card_id", "title", "start_date", "end_date")


@query(
    "cards_portfolio",
    f"""SELECT o_orderkey // 20 AS page_id, 'd' || o_orderkey AS card_id, 'Pick ' || o_orderkey AS title,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR AS DATE) AS start_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR + INTERVAL 30 DAY AS DATE) AS end_date
FROM orders WHERE {_CARD_LIVE}""",
)
def cards_portfolio(t: Tables):
    k = F.col("o_orderkey")
    card = text(
        '<div class="portfolio-title"><h3 class="t"><a href="/Preferential/Detail/d', k, '">Pick <b>', k, "</b></a></h3>",
        '<span class="labeldate">', day(_shown(), "yyyy-MM-dd"), '</span><span class="labeldate">', day(_shown(30), "yyyy-MM-dd"), "</span></div>\n",
    )
    pages = order_pages(t, card).withColumnRenamed("items", "text")
    cards = extract.explode_cards(pages, extract.CARD_SPECS["portfolio_cards"], ["page_id"])
    return extract.live_cards(cards, "page_id", "2027-06-01").select("page_id", "card_id", "title", "start_date", "end_date")


@query(
    "cards_event",
    """SELECT o_orderkey // 20 AS page_id, 'Pay day ' || o_orderkey AS title, 'sum ' || o_custkey AS summary,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR AS DATE) AS start_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL 29 YEAR + INTERVAL 30 DAY AS DATE) AS end_date FROM orders WHERE o_orderstatus <> 'P'""",
)
def cards_event(t: Tables):
    from offerlens.functions.dates import slash_range

    k = F.col("o_orderkey")
    title = F.when(F.col("o_orderstatus") == "P", text("Cash ", k)).otherwise(text("Pay day ", k))
    card = text(
        '<div class="card card--event"><a class="card__cover-link" href="https://bank.example.com/', k, '"></a><h4 class="card__title">', title,
        '</h4><p class="card__date">', day(_shown(), "yyyy/M/d"), " - ", day(_shown(30), "yyyy/M/d"), '</p><p class="card__text small">sum ', F.col("o_custkey"), "</p></div>",
    )
    pages = order_pages(t, card).withColumnRenamed("items", "text")
    cards = extract.explode_cards(pages, extract.CARD_SPECS["event_cards"], ["page_id"]).filter(F.lower("title").contains("pay"))
    dated = cards.withColumn("p", slash_range(F.col("date_text")))
    return dated.select("page_id", "title", "summary", F.col("p.start").alias("start_date"), F.col("p.end").alias("end_date"))


@query(
    "url_mentions",
    """SELECT o_orderkey // 20 AS page_id, 'deal-' || o_orderkey AS slug_key, CASE WHEN o_orderkey % 2 = 0 THEN 'campaign' ELSE 'event' END AS kind,
  'https://mkt.example.com/zh-TW/' || CASE WHEN o_orderkey % 2 = 0 THEN 'campaign' ELSE 'event' END || '/Deal-' || o_orderkey AS detail_url FROM orders""",
)
def url_mentions(t: Tables):
    k = F.col("o_orderkey")
    kind = F.when(k % 2 == 0, "campaign").otherwise("event")
    item = text(
        '"https://mkt.example.com/', kind, "/Deal-", k, '" "https://mkt.example.com/zh-TW/event/DEAL-', k, '" "https://mkt.example.com/event/newEvent', k, '" "https://other.example.com/event/x" ',
    )
    pages = order_pages(t, item).withColumnRenamed("items", "text")
    out = extract.explode_url_mentions(pages, ["page_id"], "mkt.example.com", ("campaign", "event"))
    return out.select("page_id", "slug_key", "kind", "detail_url")


@query(
    "pagination_links",
    """WITH p AS (SELECT DISTINCT o_orderkey // 20 AS page_id FROM orders), n AS (SELECT page_id, unnest([page_id - 1, page_id + 1]) AS other FROM p)
SELECT page_id, CAST(CASE WHEN other < page_id THEN 0 ELSE 1 END AS INTEGER) AS pos, 'https://www.example.com/Preferential?cat=a&page=' || other AS page_url FROM n WHERE other > 0 OR other < page_id AND other >= 0
UNION ALL SELECT page_id, 0, 'never' FROM p WHERE false""",
)
def pagination_links(t: Tables):
    n = F.floor(F.col("o_orderkey") / PAGE_SIZE)
    link = lambda v: text('<a href="/Preferential?page=', v, '&amp;cat=a">', v, "</a>")
    pages = t.orders.select(n.alias("page_id")).distinct()
    p = F.col("page_id")
    html = F.concat(F.when(p > 0, link(p - 1)).otherwise(""), link(p), link(p + 1), link(p + 1))
    df = pages.select("page_id", text("https://www.example.com/Preferential?cat=a&page=", p).alias("url"), html.alias("text"))
    return extract.pagination_links(df, "page_id", "url", "/Preferential").select(
        "page_id", F.when(F.col("page_url").endswith(F.concat(F.lit("="), (p - 1).cast("string"))), 0).otherwise(1).alias("pos"), "page_url"
    )


@query(
    "embedded_campaigns",
    f"""SELECT o_orderkey // 20 AS page_id, CAST(o_orderkey AS VARCHAR) AS campaign_id, 'A & B ' || o_orderkey AS title, 's' || o_orderkey AS slug
FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}'""",
)
def embedded_campaigns(t: Tables):
    item = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.struct(
                text("A &amp; B ", F.col("o_orderkey")).alias("title"),
                F.when(F.col("o_orderstatus") == "F", " px PAY ").otherwise("other").alias("label"),
                day("o_orderdate").alias("closeDate"),
                text("s", F.col("o_orderkey")).alias("slug"),
            ).alias("attributes"),
        )
    )
    pages = order_pages(t, item, ",")
    html = text('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"campaigns":[', F.col("items"), "]}}}</script></html>")
    out = extract.embedded_campaigns(pages.select("page_id", html.alias("text")), ["page_id"], "PX Pay", AS_OF)
    return out.select("page_id", "campaign_id", "title", "slug")


@query(
    "chunk_recovery",
    """SELECT o_orderkey AS doc_id, 'desc & ' || o_orderkey || chr(10) || 'line ' || o_custkey || chr(10) || 'tail' || chr(10) || 'T' || o_orderkey || chr(10) || 'body' AS text FROM orders""",
)
def chunk_recovery(t: Tables):
    k = F.col("o_orderkey")
    html = text(
        "<html><head><title>T", k, '</title><meta name="description" content="desc &amp; ', k, '"></head><body><p>body</p><script>self.__next_f.push([1,"<p>line ',
        F.col("o_custkey"), '<\\/p>"])</script><script>self.__next_f.push([1,"<div>\\u0074ail<\\/div>"])</script></body></html>',
    )
    d = t.orders.select(k.alias("doc_id"), F.lit("https://a.example.com/").alias("final_url"), html.alias("text"))
    return extract.recover_chunks(d).select("doc_id", "text")


@query(
    "news_explode",
    """WITH r AS (SELECT o_orderkey // 20 AS page_id, CAST(o_orderkey AS VARCHAR) AS record_id, 'n' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date_text, o_orderkey,
  count(*) OVER (PARTITION BY o_orderkey // 20) AS total_found FROM orders)
SELECT page_id, record_id, title, date_text, total_found FROM r""",
)
def news_explode(t: Tables):
    k = F.col("o_orderkey")
    item = text('"', k, '":', F.to_json(F.struct(text("n", k).alias("title"), day("o_orderdate").alias("date"), F.lit("<p>x</p>").alias("content"))))
    pages = order_pages(t, item, ",").select("page_id", text('{"all":{', F.col("items"), "}}").alias("text"))
    return extract.explode_news(pages, ["page_id"]).select("page_id", "record_id", "title", "date_text", F.col("total_found").cast("bigint").alias("total_found"))


@query(
    "metadata_overlay",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'startDate: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'official_api_title: hint ' || o_orderkey || chr(10) || 'body' ELSE 'body' END AS text,
  CASE WHEN o_orderstatus = 'F' THEN 'hint ' || o_orderkey ELSE 'own title' END AS title,
  CASE WHEN o_orderstatus = 'F' THEN sha256('h' || chr(10) || 'startDate: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'official_api_title: hint ' || o_orderkey) ELSE 'h' END AS content_hash FROM orders""",
)
def metadata_overlay(t: Tables):
    f = F.col("o_orderstatus") == "F"
    df = t.orders.select(
        "o_orderkey",
        F.lit("body").alias("text"),
        F.lit("own title").alias("title"),
        F.lit("h").alias("content_hash"),
        F.when(f, day("o_orderdate")).alias("start_text"),
        F.lit("").alias("end_text"),
        F.when(f, text("hint ", F.col("o_orderkey"))).otherwise("").alias("title_hint"),
        F.lit(None).cast("string").alias("summary_hint"),
    )
    return extract.overlay_metadata(df).select("o_orderkey", "text", "title", "content_hash")


# ---------------------------------------------------------------- titles and summaries


@query(
    "best_titles",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Heading ' || o_orderkey WHEN 1 THEN 'Sale ' || o_orderkey WHEN 2 THEN 'Line four ' || o_orderkey
  WHEN 3 THEN 'Name' || o_orderkey || ' - x' ELSE 'a | ' || o_orderkey END AS title FROM orders""",
)
def best_titles(t: Tables):
    k = F.col("o_orderkey")
    m = k % 5
    df = t.orders.select(
        "o_orderkey",
        F.when(m == 0, "活動訊息 | site").when(m == 1, text("Sale ", k, "｜site - x_y")).when(m == 2, "abc")
        .when(m == 3, text("Name", k, " - x | site")).otherwise(text("a | ", k)).alias("raw_title"),
        F.when(m == 2, "h").otherwise(text("Heading ", k)).alias("heading"),
        text("abc\nLine four ", k, "\nmore").alias("text"),
    )
    return extract.resolve_titles(df).select("o_orderkey", "title")


@query(
    "final_titles",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A good title ' || o_orderkey WHEN 1 THEN 'hint ' || o_orderkey WHEN 2 THEN 'Real line ' || o_orderkey ELSE 'Redirecting...' END AS title FROM orders""",
)
def final_titles(t: Tables):
    k = F.col("o_orderkey")
    m = k % 4
    df = t.orders.select(
        "o_orderkey",
        F.when(m == 0, text("A good title ", k)).when(m == 1, "最新消息").when(m == 2, "x {{title}}").otherwise("Redirecting...").alias("title"),
        F.when(m == 1, text(" hint  ", k)).otherwise("").alias("hint"),
        F.when(m == 3, "short\nMenu long enough\n活動內容").otherwise(text("首頁 home page\nshort\n  Real line ", k, "\nlater line")).alias("text"),
    )
    return extract.final_titles(df, "hint").select("o_orderkey", "title")


WORDS = ("tion", "ment", "ung", "ado")


@query(
    "condition_summary",
    f"""WITH {SENTENCES_SQL}, w AS (SELECT doc_id, pos, sentence FROM sents WHERE regexp_matches(sentence, '{"|".join(WORDS)}')),
whole AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM w GROUP BY doc_id),
k AS (SELECT doc_id, pos, substr(sentence, 1, 220) AS s FROM w),
c AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
j AS (SELECT doc_id, substr(string_agg(s, ' ' ORDER BY pos), 1, 520) AS display FROM c WHERE before < 520 GROUP BY doc_id)
SELECT doc_id, coalesce(summary, '') AS summary, coalesce(display, '') AS display FROM documents LEFT JOIN whole USING (doc_id) LEFT JOIN j USING (doc_id)""",
)
def condition_summary(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", extract.condition_summary(c, WORDS).alias("summary"), extract.condition_display(c, WORDS).alias("display"))


@query(
    "condition_sections",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['lead ' || o_orderkey, '適用地點：store ' || o_custkey, '活動內容：get ' || o_orderkey]
  WHEN 1 THEN ['plain text ' || o_orderkey] ELSE ['注意事項：same', 'desc ' || o_orderkey] END AS v FROM orders)
SELECT o_orderkey, unnest(v) AS entry, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos FROM s""",
)
def condition_sections(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = k % 3
    summary = (
        F.when(m == 0, text("lead ", k, " Location: store  ", c, " title: T", k, " content:  get ", k, " restrictions: "))
        .when(m == 1, text(" plain  text ", k))
        .otherwise(text("reminder: same reminder: same description: desc ", k))
    )
    return t.orders.select(
        "o_orderkey", F.posexplode(extract.condition_sections(text("T", k), summary)).alias("pos", "entry")
    ).select("o_orderkey", "pos", "entry")


@query(
    "detail_reconcile",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS titles_agree, o_orderstatus = 'P' AS review_required,
  CASE o_orderstatus WHEN 'F' THEN 'Offer ' || o_orderkey || ' extra' ELSE 'Offer ' || o_orderkey END AS final_title FROM orders""",
)
def detail_reconcile(t: Tables):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    listed = t.orders.select("o_orderkey", k.cast("string").alias("external_id"), text("Offer ", k).alias("title"))
    detail_title = F.when(s == "F", text("Offer ", k, " extra")).otherwise("完全不同的活動")
    detailed = t.orders.filter(s != "O").select(k.cast("string").alias("external_id"), detail_title.alias("title"))
    return extract.reconcile_detail(listed, detailed).select("o_orderkey", "titles_agree", "review_required", "final_title")


