"""Captures to documents, links and listing rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.functions import dates, html, titles, urls
from offerlens.functions.text import all_matches, first_match, head, sentence_list, squash
from offerlens.operators.keys import first_by, limit_per_group
from offerlens.operators.similarity import sequence_ratio

PARSED = {"raw_title": "string", "heading": "string", "text": "string", "links": "array<struct<url:string,anchor:string>>"}
NAMED_URL = r"https?://[^\s<>'\"]+"
# Words that mark a condition sentence, and the labelled sections of a summary.
CONDITION_WORDS = ("回饋", "上限", "名額", "指定", "每筆", "每戶", "每月", "活動期間")
SECTION_NAMES = "title|description|location|content|reminder|restrictions"
SECTION_LABELS = {
    "location": "適用地點",
    "content": "活動內容",
    "reminder": "注意事項",
    "restrictions": "限制條件",
}


def _map_documents(
    captures: DataFrame, key: str, url: str, source: str, parse: Callable, fields: dict[str, str], keep: tuple[str, ...]
) -> DataFrame:
    """Run a per-page parser over Arrow batches. A page that fails becomes a row, not a failed job.

    ``fields``: name and type of what ``parse`` returns; ``keep``: columns of ``captures`` that stay beside them.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (key, url))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for address, page in zip(frame[url], frame["__source"]):
                try:
                    rows.append({"status": "ok", "error": None} | parse(page, address))
                except Exception as exc:
                    rows.append({"status": "failed", "error": f"{type(exc).__name__}: {exc}"} | dict.fromkeys(fields))
            made = pd.DataFrame(rows, columns=["status", "error", *fields], index=frame.index, dtype=object)
            yield pd.concat([frame.drop(columns="__source"), made], axis=1)

    narrow = captures.select(key, url, *keep, F.col(source).alias("__source"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema if f.name != "__source"}
    made = kinds | {"status": "string", "error": "string"} | fields
    parsed = narrow.mapInPandas(batches, ", ".join(f"`{n}` {k}" for n, k in made.items()))
    return parsed.select(key, url, "status", "error", *fields, *keep)


def _page_parser(read: Callable, fields: tuple[str, ...]) -> Callable:
    def parse(source: str, base_url: str) -> dict:
        out = read(source, base_url, fields)
        if "links" in out:
            out["links"] = [{"url": a, "anchor": b} for a, b in out["links"]]
        return out

    return parse


def extract_pages(
    captures: DataFrame,
    key: str = "doc_id",
    url: str = "final_url",
    source: str = "text",
    fields: tuple[str, ...] = tuple(PARSED),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """HTML captures to documents; ``status`` tells parsed pages from quarantined ones. Only ``fields`` are built."""
    return _map_documents(captures, key, url, source, _page_parser(html.html_document, fields), {f: PARSED[f] for f in fields}, keep)


def recover_chunks(captures: DataFrame, key: str = "doc_id", url: str = "final_url", source: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return _map_documents(captures, key, url, source, _page_parser(html.chunked_document, tuple(PARSED)), PARSED, keep)


def flatten_json(captures: DataFrame, key: str = "doc_id", url: str = "final_url", source: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON captures of any depth to documents; a detail object hides its siblings.

    Python only walks the payload; lines, links and title are built from its pairs in Spark.
    """

    def parse(source: str, base_url: str) -> dict:
        pairs = html.payload_pairs(source, base_url)
        return {"__pairs": [p | {"links": [{"url": a, "anchor": b} for a, b in p["links"]]} for p in pairs]}

    link = "struct<url:string,anchor:string>"
    kind = f"array<struct<key:string,value:string,shown:string,links:array<{link}>>>"
    rows = _map_documents(captures, key, url, source, parse, {"__pairs": kind}, keep)
    pairs = F.col("__pairs")
    lines = F.transform(F.filter(pairs, lambda p: p["shown"] != ""), lambda p: F.concat(p["key"], F.lit(": "), p["shown"]))

    def links(p: Column) -> Column:
        named = F.transform(all_matches(p["value"], NAMED_URL), lambda u: F.struct(F.regexp_replace(u, r"[.,);\]]+\z", "").alias("url"), F.lit("").alias("anchor")))
        return F.concat(p["links"], named)

    order = F.array(*[F.lit(k) for k in html.TITLE_KEYS])
    fits = F.filter(pairs, lambda p: F.array_contains(order, F.lower(p["key"])) & F.length(F.regexp_replace(p["value"], "<[^>]+>", "")).between(3, 240))
    ranked = F.array_sort(F.transform(fits, lambda p, i: F.struct(F.array_position(order, F.lower(p["key"])).alias("rank"), i.alias("pos"), p["value"].alias("value"))))
    title = squash(F.regexp_replace(head(ranked)["value"], "<[^>]+>", " "))
    ok = F.col("status") == "ok"
    built = {
        "raw_title": F.when(ok, F.coalesce(title, F.lit(titles.UNKNOWN_TITLE))),
        "heading": F.when(ok, F.lit("")),
        "text": F.array_join(lines, "\n"),
        "links": F.flatten(F.transform(pairs, links)),
    }
    kept = [c for c in rows.columns if c not in (key, url, "status", "error", "__pairs")]
    return rows.select(key, url, "status", "error", *[c.alias(n) for n, c in built.items()], *kept)


def failures(documents: DataFrame) -> DataFrame:
    return documents.filter("status = 'failed'")


def resolve_titles(documents: DataFrame, out: str = "title") -> DataFrame:
    return documents.withColumn(
        out, titles.best_title(F.col("raw_title"), F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))
    )


def final_titles(documents: DataFrame, hint: str, out: str = "title") -> DataFrame:
    return documents.withColumn(out, titles.final_title(F.col("title"), F.col(hint), F.col("text")))


def link_edges(documents: DataFrame, key: str = "doc_id", url: str = "final_url") -> DataFrame:
    """One row per link, with its position on the page."""
    return documents.select(key, url, F.posexplode("links").alias("pos", "link")).select(
        key, url, "pos", F.col("link.url").alias("link_url"), F.col("link.anchor").alias("anchor")
    )


def json_titles(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Best title per payload from exploded (key, pos, name, value) pairs."""
    order = F.array_position(F.array(*[F.lit(k) for k in html.TITLE_KEYS]), F.lower("name"))
    bare = F.regexp_replace("value", "<[^>]+>", "")
    fits = pairs.filter((order > 0) & F.length(bare).between(3, 240))
    shown = squash(F.regexp_replace("value", "<[^>]+>", " "))
    return fits.groupBy(key).agg(F.min_by(shown, F.struct(order, F.col("pos"))).alias("title"))


# ---------------------------------------------------------------- formats and payloads


def is_json(text: Column, content_type: Column | None = None) -> Column:
    looks = F.regexp_replace(text, r"(?U)\A\s+", "").rlike(r"\A[\[{]")
    return looks if content_type is None else F.lower(content_type).contains("json") | looks


def split_by_format(captures: DataFrame, text: str = "text", content_type: str | None = "content_type") -> DataFrame:
    kind = is_json(F.col(text), F.col(content_type) if content_type else None)
    return captures.withColumn("format", F.when(kind, "json").otherwise("html"))


DETAIL_SCHEMA = "struct<body:struct<campaignDetail:struct<" + ",".join(
    f"{k}:string" for k in sorted(html.DETAIL_KEYS)
) + ">>>"


def select_detail(captures: DataFrame, source: str = "text") -> DataFrame:
    """Narrow read of a detail payload: unread siblings never leave the JSON parser."""
    return captures.withColumn("detail", F.from_json(source, DETAIL_SCHEMA)["body"]["campaignDetail"])


@dataclass(frozen=True)
class ListingSpec:
    """Where a JSON listing keeps its records. ``schema`` types the whole payload."""

    schema: str
    arrays: tuple[str, ...]
    fields: dict[str, str]


def explode_listing(captures: DataFrame, spec: ListingSpec, keep: list[str], source: str = "text") -> DataFrame:
    """Record arrays of a payload (unioned in order) to candidate rows with their position."""
    parsed = captures.withColumn("__p", F.from_json(source, spec.schema))
    arrays = [F.expr("__p" if a == "" else f"__p.{a}") for a in spec.arrays]
    records = arrays[0] if len(arrays) == 1 else F.flatten(F.array_compact(F.array(*arrays)))
    rows = parsed.select(*keep, F.posexplode(records).alias("pos", "__r"))
    return rows.select(*keep, "pos", *[F.expr(f"__r.{e}").alias(n) for n, e in spec.fields.items()])


def plain_fragment(fragment: Column) -> Column:
    """Text of a small HTML fragment: tags out, the common entities decoded, one line."""
    text = F.regexp_replace(fragment, r"<[^>]+>", " ")
    for entity, char in (
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squash(text)


@dataclass(frozen=True)
class CardSpec:
    """Regexes of one site's listing cards; ``card`` matches a whole card."""

    card: str
    card_id: str
    title: str
    date: str | None = None
    date_join: str = " "
    summary: str | None = None


# Card layouts of the sites that list offers as HTML cards.
CARD_SPECS: dict[str, CardSpec] = {
    "anchor_cards": CardSpec(
        card=r"""(?is)<a[^>]+href=["']/benefit/content(?:\.php)?\?id=\d+["'][^>]*>.*?</a>""",
        card_id=r"""(?is)href=["']/benefit/content(?:\.php)?\?id=(\d+)["']""",
        title=r"""(?is)<p[^>]+class=["'][^"']*\btitle\b[^"']*["'][^>]*>(.*?)</p>""",
        date=r"""(?is)<p[^>]+class=["'][^"']*\bdate\b[^"']*["'][^>]*>(.*?)</p>""",
    ),
    "portfolio_cards": CardSpec(
        card=r"""(?is)<div[^>]+class=["'][^"']*\bportfolio-title\b[^"']*["'][^>]*>.*?<h3[^>]*>.*?<a[^>]+href=["']/Preferential/Detail/[A-Za-z0-9_-]+["'][^>]*>.*?</a>.*?</h3>.*?</div>""",
        card_id=r"""(?is)<h3[^>]*>.*?href=["']/Preferential/Detail/([A-Za-z0-9_-]+)["']""",
        title=r"""(?is)<h3[^>]*>.*?href=["']/Preferential/Detail/[A-Za-z0-9_-]+["'][^>]*>(.*?)</a>""",
        date=r"""(?is)<span[^>]+class=["'][^"']*\blabeldate\b[^"']*["'][^>]*>(.*?)</span>""",
        date_join=" ~ ",
    ),
    "event_cards": CardSpec(
        card=r"""(?is)<div\s+class=["']card card--event["']\s*>.*?(?=<div\s+class=["']card card--event["']\s*>|\z)""",
        card_id=r"""(?is)class=["']card__cover-link["'][^>]*href=["']([^"']+)""",
        title=r"""(?is)class=["']card__title["'][^>]*>(.*?)</h\d>""",
        date=r"""(?is)class=["']card__date["'][^>]*>(.*?)</p>""",
        summary=r"""(?is)class=["']card__text[^"']*["'][^>]*>(.*?)</p>""",
    ),
}


def explode_cards(captures: DataFrame, spec: CardSpec, keep: list[str], source: str = "text") -> DataFrame:
    """Listing cards to rows: ``pos, card_id, title, date_text, summary``; cards without a title are not offers."""
    rows = captures.select(*keep, F.posexplode(all_matches(F.col(source), spec.card)).alias("pos", "__c"))
    card = F.col("__c")
    date_text = (
        F.array_join(F.transform(all_matches(card, spec.date, 1), plain_fragment), spec.date_join)
        if spec.date
        else F.lit("")
    )
    return rows.filter(card.rlike(spec.title)).select(
        *keep,
        "pos",
        first_match(card, spec.card_id, 1).alias("card_id"),
        plain_fragment(first_match(card, spec.title, 1)).alias("title"),
        date_text.alias("date_text"),
        (plain_fragment(first_match(card, spec.summary, 1)) if spec.summary else F.lit("")).alias("summary"),
    )


def live_cards(cards: DataFrame, listing: str, as_of: dt.date | str) -> DataFrame:
    """Cards of a listing with their period, expired ones dropped, first of each id kept."""
    period = dates.resolve_title_period(F.col("date_text"))
    live = (
        cards.withColumn("__p", F.when(F.col("date_text") != "", period))
        .withColumn("start_date", F.col("__p.start"))
        .withColumn("end_date", F.col("__p.end"))
        .drop("__p")
        .filter(F.col("end_date").isNull() | (F.col("end_date") >= dates.as_date_lit(as_of)))
    )
    return first_by(live, [listing, "card_id"], [F.col("pos")])


def explode_url_mentions(
    captures: DataFrame,
    keep: list[str],
    host: str,
    kinds: tuple[str, ...],
    locale: str = "zh-TW",
    self_prefix: str = "newevent",
    source: str = "text",
) -> DataFrame:
    """Detail URLs named anywhere in a page source, one per lower-case slug, listings of themselves dropped."""
    pattern = rf"(?i)https://{host.replace('.', chr(92) + '.')}/(?:{locale}/)?(?:{'|'.join(kinds)})/[A-Za-z0-9_-]+"
    rows = captures.select(*keep, F.posexplode(all_matches(F.col(source), pattern)).alias("pos", "mention"))
    path = F.regexp_replace(urls.url_path(F.col("mention")), rf"(?i)\A/{locale}(?=/)", "")
    parts = F.split(F.regexp_replace(path, r"\A/+|/+\z", ""), "/")
    rows = rows.withColumn("kind", F.get(parts, 0)).withColumn("slug", F.get(parts, 1)).filter(
        (F.size(parts) == 2)
        & F.col("kind").isin(*kinds)
        & ~F.lower("slug").startswith(self_prefix)
    )
    slug_key = F.lower("slug")
    first = first_by(rows.withColumn("slug_key", slug_key), [*keep, "slug_key"], [F.col("pos")])
    return first.withColumn("detail_url", F.concat(F.lit(f"https://{host}/{locale}/"), "kind", F.lit("/"), "slug"))


def pagination_links(captures: DataFrame, key: str, url: str, path: str, source: str = "text") -> DataFrame:
    """``page=N`` links of a listing other than itself, one per canonical URL."""
    pattern = rf"""(?i)href=["']({path}\?[^"']*\bpage=\d+[^"']*)["']"""
    base = F.col(url)
    found = F.transform(
        all_matches(F.col(source), pattern, 1),
        lambda h: urls.canonical_url(F.replace(h, F.lit("&amp;"), F.lit("&")), base),
    )
    others = F.array_except(F.array_distinct(found), F.array(urls.canonical_url(base)))
    return captures.select(key, url, F.posexplode(others).alias("pos", "page_url"))


NEXT_DATA = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
CAMPAIGNS_SCHEMA = (
    "struct<props:struct<pageProps:struct<campaigns:array<struct<id:string,attributes:struct<"
    "title:string,label:string,openDate:string,closeDate:string,slug:string>>>>>>"
)


def embedded_campaigns(captures: DataFrame, keep: list[str], label: str, as_of: dt.date | str, source: str = "text") -> DataFrame:
    """Campaigns of the JSON embedded in a page, with this exact label and not yet over."""
    payload = F.from_json(first_match(F.col(source), NEXT_DATA, 1), CAMPAIGNS_SCHEMA)
    rows = captures.select(*keep, F.posexplode(payload["props"]["pageProps"]["campaigns"]).alias("pos", "c"))
    a = F.col("c.attributes")
    title = F.trim(F.replace(F.coalesce(a["title"], F.lit("")), F.lit("&amp;"), F.lit("&")))
    slug = F.coalesce(F.nullif(F.trim(a["slug"]), F.lit("")), title)
    end = dates.strict_date(F.trim(a["closeDate"]))
    return (
        rows.filter(F.lower(F.trim(a["label"])) == label.lower())
        .filter(end.isNull() | (end >= dates.as_date_lit(as_of)))
        .select(
            *keep,
            "pos",
            F.col("c.id").alias("campaign_id"),
            title.alias("title"),
            slug.alias("slug"),
            F.trim(a["openDate"]).alias("start_text"),
            F.trim(a["closeDate"]).alias("end_text"),
        )
        .filter((F.col("title") != "") & (F.col("slug") != ""))
    )


NEWS_SCHEMA = "map<string,map<string,struct<title:string,date:string,content:string>>>"


def explode_news(captures: DataFrame, keep: list[str], n: int | None = None, source: str = "text") -> DataFrame:
    """A {category: {id: record}} map to announcement rows with ``total_found``; with ``n`` the newest ones of each capture."""
    parsed = captures.select(*keep, F.from_json(source, NEWS_SCHEMA).alias("__n"))
    total = F.aggregate(F.map_values("__n"), F.lit(0), lambda acc, m: acc + F.size(m))
    by_cat = parsed.select(*keep, total.alias("total_found"), F.posexplode("__n").alias("cat_pos", "category", "records"))
    rows = by_cat.select(*keep, "total_found", "cat_pos", "category", F.posexplode("records").alias("rec_pos", "record_id", "r"))
    rows = rows.select(
        *keep,
        "total_found",
        "cat_pos",
        "rec_pos",
        "category",
        "record_id",
        F.trim(F.coalesce("r.title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("r.date", F.lit(""))).alias("date_text"),
        F.coalesce("r.content", F.lit("")).alias("content"),
    )
    return rows if n is None else limit_per_group(rows, keep, [F.col("date_text").desc(), F.col("cat_pos"), F.col("rec_pos")], n)


# ---------------------------------------------------------------- links


def link_rules(spark: SparkSession, patterns: dict[str, list[str]], max_links: dict[str, int] | int | None = None) -> DataFrame:
    """Rules (source, patterns, max_links) as rows of a table, the form in which ``discover_links`` takes them."""
    limit = max_links.get if isinstance(max_links, dict) else lambda _: max_links
    return spark.createDataFrame([(s, p, limit(s)) for s, p in sorted(patterns.items())], "source string, patterns array<string>, max_links int")


def discover_links(
    documents: DataFrame,
    rules: DataFrame | dict[str, list[str]],
    max_links: dict[str, int] | int | None = None,
    source: str = "source_id",
    listing_url: str = "final_url",
    domains: list[str] | None = None,
) -> DataFrame:
    """Links of a listing whose URL or anchor fits one of the listing's own patterns.

    ``rules`` (source, patterns, max_links) are rows of the registry and join by
    source, so the plan is the same for ten sources and for ten thousand. A
    listing is one row: filtering, de-duplication and the link limit work on its
    array and only the join moves it, unless the rules are small enough to be
    sent to it. A source's patterns become one regex in its row, which a task
    compiles once for all links of a page. A source without a limit keeps all
    its links; one without rules or patterns has none.
    """
    if isinstance(rules, dict):
        rules = link_rules(documents.sparkSession, rules, max_links)
    alternatives = F.array_join(F.transform("patterns", lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    own = rules.filter(F.size("patterns") > 0).select(
        F.col("source").alias(source), F.concat(F.lit("(?iu)"), alternatives).alias("__regex"), F.col("max_links").alias("__limit")
    )
    documents = documents.join(own, source)

    def wanted(link: Column) -> Column:
        hit = F.regexp_instr(F.concat(link["url"], F.lit("\n"), link["anchor"]), F.col("__regex")) > 0
        hit = hit & urls.url_scheme(link["url"]).isin("http", "https")
        if domains is not None:
            known = F.array(*[F.lit(d.lower().rstrip(".")) for d in domains])
            hit = hit & F.arrays_overlap(urls.host_suffixes(urls.url_host(link["url"])), known)
        return hit

    limit = F.coalesce(F.col("__limit"), F.size("__all"))
    hits = F.transform(
        F.filter("links", wanted),
        lambda x: F.struct(urls.canonical_url(x["url"]).alias("canonical_url"), x["url"].alias("link_url"), x["anchor"].alias("anchor")),
    )
    staged = (
        documents.withColumn("__hits", hits)
        .withColumn("__self", F.array(urls.canonical_url(F.col(listing_url))))
        .withColumn("__urls", F.transform("__hits", lambda h: h["canonical_url"]))
        .withColumn("__all", F.array_except("__urls", "__self"))
        .withColumn(
            "__kept",
            F.transform(
                F.slice("__all", F.lit(1), limit),
                lambda c: F.get("__hits", F.array_position("__urls", c).cast("int") - 1),
            ),
        )
    )
    return staged.select(
        source, listing_url, F.size("__all").alias("total_found"), F.posexplode("__kept").alias("pos", "__k")
    ).select(source, listing_url, "total_found", "pos", "__k.*")


def discover_event_links(edges: DataFrame, key: str, own_id: str, host: str, path: str, id_key: str = "EventId") -> DataFrame:
    """Distinct event ids a page links to, other than its own, at their first position."""
    hits = edges.withColumn("event_id", urls.strict_event_id(F.col("link_url"), host, path, id_key)).filter(
        F.col("event_id").isNotNull() & ~F.col("event_id").eqNullSafe(F.col(own_id))
    )
    return hits.groupBy(key, "event_id").agg(F.min("pos").alias("pos"), F.min_by("anchor", "pos").alias("anchor"))


def overlay_metadata(documents: DataFrame) -> DataFrame:
    """List-page facts on top of a detail text; expects ``start_text, end_text, title_hint, summary_hint``."""
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    meta = F.concat_ws(
        "\n",
        part("startDate", "start_text"),
        part("endDate", "end_text"),
        part("official_api_title", "title_hint"),
        part("official_api_summary", "summary_hint"),
    )
    has = F.col("__meta") != ""
    return (
        documents.withColumn("__meta", meta)
        .withColumn(
            "text",
            F.when(has & (F.coalesce("text", F.lit("")) != ""), F.concat("__meta", F.lit("\n"), "text"))
            .when(has, F.col("__meta"))
            .otherwise(F.col("text")),
        )
        .withColumn("content_hash", F.when(has, urls.content_hash(F.col("content_hash"), F.col("__meta"))).otherwise(F.col("content_hash")))
        .withColumn("title", F.when(has, F.coalesce(F.nullif(F.col("title_hint"), F.lit("")), F.col("title"))).otherwise(F.col("title")))
        .drop("__meta")
    )


# ---------------------------------------------------------------- summaries


def condition_sentences(text: Column, words: tuple[str, ...] = CONDITION_WORDS) -> Column:
    """All key sentences of a text."""
    return F.filter(sentence_list(F.coalesce(text, F.lit(""))), lambda s: s.rlike("|".join(words)))


def condition_summary(text: Column, words: tuple[str, ...] = CONDITION_WORDS) -> Column:
    """All key sentences, joined; what rewards, search and publishing read."""
    return F.array_join(condition_sentences(text, words), " ")


def condition_display(text: Column, words: tuple[str, ...] = CONDITION_WORDS, limit: int = 520, keep: int = 220) -> Column:
    """For display only: first key sentences up to ``limit`` characters, each up to ``keep``. Row-local: a fold, not a window."""
    wanted = condition_sentences(text, words)
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"))
    folded = F.aggregate(
        wanted,
        zero,
        lambda acc, s: F.when(acc["total"] >= limit, acc).otherwise(
            F.struct(
                F.array_append(acc["kept"], F.substring(s, 1, keep)).alias("kept"),
                (acc["total"] + F.least(F.length(s), F.lit(keep))).alias("total"),
            )
        ),
    )
    return F.substring(F.array_join(folded["kept"], " "), 1, limit)


def condition_sections(title: Column, summary: Column) -> Column:
    """All labelled, de-duplicated sections of a summary; a display takes as many as it has room for."""
    text = squash(F.coalesce(summary, F.lit("")))
    marker = rf"(?iU)(?:^|\s)(?:{SECTION_NAMES}):\s*"
    bodies = F.transform(F.split(text, marker), lambda b: F.trim(b))
    names = F.transform(all_matches(text, rf"(?iU)(?:^|\s)({SECTION_NAMES}):\s*", 1), F.lower)
    leading = F.get(bodies, 0)
    parts = F.transform(
        F.arrays_zip(names.alias("n"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))).alias("b")),
        lambda p: F.struct(p["n"].alias("n"), p["b"].alias("b")),
    )
    useful_leading = (leading != "") & (leading != title)
    start = F.struct(
        F.when(useful_leading, F.array(leading)).otherwise(F.array().cast("array<string>")).alias("out"),
        F.when(useful_leading, F.array(leading)).otherwise(F.array().cast("array<string>")).alias("seen"),
    )
    label = lambda n: F.coalesce(*[F.when(n == k, F.lit(f"{v}：")) for k, v in SECTION_LABELS.items()], F.lit(""))
    folded = F.aggregate(
        parts,
        start,
        lambda acc, p: F.when(
            (p["b"] == "") | (p["b"] == title) | F.array_contains(acc["seen"], p["b"]),
            acc,
        ).otherwise(
            F.struct(
                F.array_append(acc["out"], F.concat(label(p["n"]), p["b"])).alias("out"),
                F.array_append(acc["seen"], p["b"]).alias("seen"),
            )
        ),
    )
    whole = F.array(text)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.size(names) == 0, whole)
        .otherwise(F.when(F.size(folded["out"]) > 0, folded["out"]).otherwise(whole))
    )


# ---------------------------------------------------------------- list/detail agreement


def reconcile_detail(listed: DataFrame, detailed: DataFrame, key: str = "external_id", threshold: float = 0.55) -> DataFrame:
    """Listing row ⟕ detail row by id; a detail that is about something else loses to the listing.

    Only pairs that the cheap containment test leaves open reach the Python similarity.
    """
    d = detailed.select(F.col(key), F.col("title").alias("detail_title"))
    pairs = listed.join(d, key, "left").withColumn("__l", titles.comparable_title(F.col("title"))).withColumn(
        "__r", titles.comparable_title(F.coalesce("detail_title", F.lit("")))
    )
    open_pair = (F.col("__l") != "") & (F.col("__r") != "") & ~F.col("__l").contains(F.col("__r")) & ~F.col("__r").contains(F.col("__l"))
    # Titles pairs are scored once each and looked up by title: other rows never reach Python.
    asked = pairs.filter(open_pair).select("__l", "__r").distinct()
    scores = asked.withColumn("__score", sequence_ratio("__l", "__r"))
    scored = pairs.withColumn("__open", open_pair).join(scores, ["__l", "__r"], "left")
    agree = ~F.col("__open") | (F.col("__score") >= threshold)
    return (
        scored.withColumn("titles_agree", agree)
        .withColumn("review_required", ~agree)
        .withColumn("final_title", F.when(agree & (F.coalesce("detail_title", F.lit("")) != ""), F.col("detail_title")).otherwise(F.col("title")))
        .drop("__l", "__r", "__open", "__score")
    )
