"""Publication: supplement, highlights, calendar, provider counts and the digest row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.functions import dates, urls
from offerlens.operators.keys import filter_allowed, first_by, limit_per_group, with_activity_id

# Highlight kinds in order with their sizes, the overall size, calendar and digest wording.
HIGHLIGHT_KINDS = (("high_return", 3), ("upcoming", 2), ("expiring", 2), ("sold_out", 2))
HIGHLIGHT_LIMIT = 8
CALENDAR_LIMIT = 25
NOUNS = {"start": "開跑", "end": "截止"}
VERDICT_LABELS = {"success": "成功", "partial": "部分成功", "failed": "失敗", "unknown": "未知"}
NO_DATA = "無可用資料"
UNKNOWN_PROVIDER, UNKNOWN_CAL_PROVIDER, UNKNOWN_CAL_TITLE = "未知業者", "支付業者待確認", "未命名活動"
NO_SUMMARY = "請查看官方活動辦法。"


def accept_supplement(
    supplement: DataFrame, existing: DataFrame, providers: DataFrame, domains: DataFrame, as_of: dt.date | str
) -> DataFrame:
    """Curated offers that are official, titled, new and not over.

    An unknown status falls back to the default; a missing date asks for review.
    """
    known = supplement.join(providers.select("provider_id", F.col("name").alias("provider_name")), "provider_id")
    official = filter_allowed(known, "url", domains, https_only=True)
    dated = (
        official.withColumn("title", F.trim("title"))
        .filter(F.coalesce("title", F.lit("")) != "")
        .withColumn("start_date", dates.strict_date(F.col("start_date")))
        .withColumn("end_date", dates.strict_date(F.col("end_date")))
    )
    status = F.when(F.col("quota_status").isin(*schemas.QUOTA_STATUSES), F.col("quota_status")).otherwise(
        "not_marked_full"
    )
    live = (
        dated.withColumn("lifecycle", dates.lifecycle(F.col("start_date"), F.col("end_date"), as_of))
        .withColumn("quota_status", status)
        .withColumn("review_required", F.col("start_date").isNull() | F.col("end_date").isNull())
        .withColumn("conditions_summary", F.coalesce("conditions_summary", F.lit("")))
        .withColumn("date_confidence", F.lit("ai_official_source"))
        .filter("lifecycle <> 'ended'")
    )
    keyed = with_activity_id(live, "publish", "publish_key")
    old = with_activity_id(existing, "publish", "publish_key").select("publish_key")
    fresh = keyed.join(old, "publish_key", "left_anti")
    return first_by(fresh, ["publish_key"], [F.col("seq")])


def auto_highlights(acts: DataFrame, legacy_zero_last: bool = False) -> DataFrame:
    """At most eight highlights: per kind the best rows whose URL no earlier kind has taken.

    One pass finds each URL's best row per kind (map-side combined). A kind can
    lose at most as many candidates as earlier kinds select, so its first nine
    URLs suffice; they are cut per map task before the shuffle, and the greedy
    choice runs over that fixed-size list (at most 36 rows).
    """
    sold = F.col("quota_status").isin("sold_out", "partial_sold_out")
    days = lambda c: F.when((F.col(c) == 0) & F.lit(legacy_zero_last), 9999).otherwise(F.col(c)).cast("double")
    zero = F.lit(0.0)
    neg = lambda c: -F.coalesce(c, F.lit(0.0))
    ranks = {
        "high_return": (~sold & F.col("is_high_return"), neg(F.col("max_reward_percent")), neg(F.floor("fixed_reward_amount").cast("double"))),
        "upcoming": (~sold & F.col("is_upcoming"), days("starts_in_days"), zero),
        "expiring": (~sold & F.col("is_expiring_soon"), days("ends_in_days"), zero),
        "sold_out": (sold, zero, zero),
    }
    summary = F.coalesce(F.nullif("human_summary", F.lit("")), F.nullif("conditions_summary", F.lit("")), F.lit(NO_SUMMARY))
    pick = F.struct("provider_name", "title", summary.alias("summary"), "url")
    offers = acts.filter(F.coalesce("url", F.lit("")) != "")
    best = offers.groupBy(F.col("url").alias("__url")).agg(
        *[
            F.min(F.when(cond, F.struct(a.alias("a"), b.alias("b"), F.col("seq").alias("seq"), pick.alias("pick")))).alias(kind)
            for kind, (cond, a, b) in ranks.items()
        ]
    )
    rows = best.select(
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(F.col(kind).isNotNull(), F.struct(F.lit(i).alias("kind_no"), F.lit(kind).alias("kind"), F.lit(k).alias("k"), F.col(kind).alias("o")))
                        for i, (kind, k) in enumerate(HIGHLIGHT_KINDS)
                    ]
                )
            )
        ).alias("r")
    ).select("r.*")
    tops = limit_per_group(rows, ["kind_no"], [F.col("o.a"), F.col("o.b"), F.col("o.seq")], sum(k for _, k in HIGHLIGHT_KINDS))
    ordered = F.array_sort(F.array_agg(F.struct("kind_no", F.col("o.a").alias("a"), F.col("o.b").alias("b"), F.col("o.seq").alias("seq"), "kind", "k", F.col("o.pick").alias("pick"))))
    item = "struct<kind_no:int,a:double,b:double,seq:bigint,kind:string,k:int,pick:struct<provider_name:string,title:string,summary:string,url:string>>"
    picked = F.aggregate(
        F.col("c"),
        F.array().cast(f"array<{item}>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: y["pick"]["url"] == x["pick"]["url"])
            | (F.size(F.filter(acc, lambda y: y["kind_no"] == x["kind_no"])) >= x["k"]),
            acc,
        ).otherwise(F.array_append(acc, x)),
    )
    return (
        tops.agg(ordered.cast(f"array<{item}>").alias("c"))
        .select(F.posexplode(F.slice(picked, 1, HIGHLIGHT_LIMIT)).alias("pos", "h"))
        .select("pos", "h.kind", "h.pick.*")
    )


def curated_highlights(supplement: DataFrame, providers: DataFrame, domains: DataFrame, acts: DataFrame | None = None) -> DataFrame:
    """First eight curated highlights with a known provider, an official https URL, a title and a summary."""
    rows = supplement
    if acts is not None:
        names = acts.groupBy("provider_name").agg(F.max_by("provider_id", "seq").alias("__pid"))
        rows = rows.join(names, "provider_name", "left").withColumn(
            "provider_id", F.coalesce(F.nullif("provider_id", F.lit("")), "__pid")
        ).drop("__pid")
    known = rows.join(providers.select("provider_id"), "provider_id", "left_semi")
    official = filter_allowed(known, "url", domains, https_only=True)
    kept = official.withColumn("title", F.trim("title")).withColumn("summary", F.trim("summary")).filter(
        "coalesce(title, '') <> '' AND coalesce(summary, '') <> ''"
    )
    return kept.orderBy("seq").limit(HIGHLIGHT_LIMIT).select(
        F.coalesce("kind", F.lit("ai_pick")).alias("kind"),
        "provider_name",
        "title",
        "summary",
        "url",
        "seq",
    )


def choose_highlights(curated: DataFrame, automatic: DataFrame) -> DataFrame:
    """Curated ones replace the automatic ones when any survive (both at most eight rows)."""
    cols = ["kind", "provider_name", "title", "summary", "url"]
    none = curated.agg(F.count(F.lit(1))).scalar() == 0
    return (
        curated.select(*cols, F.col("seq").alias("pos"))
        .unionByName(automatic.filter(none).select(*cols, F.col("pos").cast("bigint").alias("pos")))
    )


def overlay_highlights(acts: DataFrame, highlights: DataFrame) -> DataFrame:
    """Marks featured offers by URL; the last highlight of a URL wins."""
    last = highlights.groupBy("url").agg(
        F.max_by("kind", "pos").alias("highlight_kind"),
        F.max_by("summary", "pos").alias("editorial_summary"),
    )
    return acts.join(last, "url", "left").withColumn("is_featured", F.col("highlight_kind").isNotNull())


# ---------------------------------------------------------------- calendar


def calendar_members(acts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Distinct (kind, day, offer) rows: both ends of every dated, live, not sold-out offer from today on."""
    today = dates.as_date_lit(as_of)
    fit = acts.filter(
        ~F.col("lifecycle").isin("ended", "cancelled")
        & (F.col("quota_status") != "sold_out")
        & (F.col("end_date") >= F.col("start_date"))
    )
    identity = urls.identity_text(
        "publish", F.col("provider_id"), F.col("provider_name"), F.col("external_id"), F.col("url"), F.col("title")
    )
    ends = F.explode(
        F.array(
            F.struct(F.lit("start").alias("kind"), F.col("start_date").alias("day")),
            F.struct(F.lit("end").alias("kind"), F.col("end_date").alias("day")),
        )
    )
    rows = fit.withColumn("identity", identity).select(
        "provider_id", "identity", "provider_name", "title", "url", "source_url", "seq", ends.alias("e")
    )
    rows = rows.select("*", "e.kind", "e.day").drop("e").filter(F.col("day") >= today)
    return first_by(rows, ["kind", "day", "provider_id", "identity"], [F.col("seq")])


def _member_order() -> list[Column]:
    return [
        F.lower(F.coalesce("provider_name", F.lit(""))),
        F.lower(F.coalesce("title", F.lit(""))),
        F.coalesce("url", F.lit("")),
    ]


def calendar_events(members: DataFrame, site_url: str = "", listed_up_to: int = CALENDAR_LIMIT) -> DataFrame:
    """One event per (kind, day): count, summary and description.

    ``listed_up_to`` is a choice of form: a description lists that many members,
    above it states their number; ``calendar_members`` has every member of every
    day as rows. So no more rows per event are gathered than a calendar entry
    shows; the count is a plain aggregate.
    """
    counts = members.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("offers"))
    first = limit_per_group(members, ["kind", "day"], _member_order(), listed_up_to + 1)
    p, t = (F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)) for c, d in (("provider_name", UNKNOWN_CAL_PROVIDER), ("title", UNKNOWN_CAL_TITLE)))
    link = F.trim(F.coalesce(F.nullif("url", F.lit("")), F.col("source_url"), F.lit("")))
    shown = (urls.url_scheme(link) == "https") & (urls.url_host(link) != "")
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_member_order())], p.alias("p"), t.alias("t"), F.when(shown, link).alias("u"))
    lists = first.groupBy("kind", "day").agg(F.array_sort(F.array_agg(row)).alias("members"))
    noun = F.when(F.col("kind") == "start", NOUNS["start"]).otherwise(NOUNS["end"])
    entries = F.transform(
        "members",
        lambda m, i: F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), m["p"], F.lit("｜"), m["t"]), m["u"]),
    )
    listed = F.concat_ws(
        "\n",
        F.concat(F.lit("今日"), noun, F.lit("優惠：")),
        F.array_join(entries, "\n"),
        F.lit(""),
        F.lit(f"完整資訊：{site_url}"),
        F.lit("實際優惠與名額以官方公告為準。"),
    )
    many = F.concat(F.lit("共 "), F.col("offers").cast("string"), F.lit(" 檔優惠今日"), noun, F.lit(f"。完整清單：{site_url}"))
    return (
        counts.join(lists, ["kind", "day"])
        .withColumn("summary", F.concat(F.col("offers").cast("string"), F.lit(" 檔優惠今日"), noun))
        .withColumn("description", F.when(F.col("offers") > listed_up_to, many).otherwise(listed))
        .drop("members")
    )


# ---------------------------------------------------------------- counts and digest


def provider_counts(report: DataFrame) -> DataFrame:
    """Offers per provider name, each identity once across sections (the first section names it)."""
    from offerlens.operators.report import section_order, section_rank

    keyed = with_activity_id(report, "digest", "digest_key")
    one = first_by(keyed, ["digest_key"], [section_rank(), *section_order(), F.col("seq")])
    name = F.coalesce(F.nullif("provider_name", F.lit("")), F.nullif("provider_id", F.lit("")), F.lit(UNKNOWN_PROVIDER))
    return one.groupBy(name.alias("provider_name")).agg(F.count(F.lit(1)).alias("offers"))


def activities_per_provider(acts: DataFrame, providers: DataFrame) -> DataFrame:
    """Offer count of every registered provider, zero included."""
    n = acts.groupBy("provider_id").agg(F.count(F.lit(1)).alias("activity_count"))
    return providers.join(n, "provider_id", "left").withColumn(
        "activity_count", F.coalesce("activity_count", F.lit(0).cast("bigint"))
    )


def digest(counts: DataFrame, summary: DataFrame, verdict: Column | str, changes: DataFrame, gaps: DataFrame) -> DataFrame:
    """The notification row. Its provider line is bounded by the registry, not by the offers."""
    line = counts.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.array_agg(F.struct((-F.col("offers")).alias("n"), F.lower("provider_name").alias("l"), "provider_name", "offers"))),
                lambda x: F.concat(x["provider_name"], F.lit(" "), x["offers"].cast("string")),
            ),
            "、",
        )
    ).scalar()
    v = F.lit(verdict) if isinstance(verdict, str) else verdict
    return summary.select(
        v.alias("verdict"),
        F.coalesce(*[F.when(v == k, F.lit(x)) for k, x in VERDICT_LABELS.items()], v).alias("label"),
        "included_non_expired",
        "sold_out_or_partial",
        F.coalesce(F.nullif(line, F.lit("")), F.lit(NO_DATA)).alias("providers"),
        changes.agg(F.count(F.lit(1))).scalar().alias("changes"),
        gaps.agg(F.count(F.lit(1))).scalar().alias("gaps"),
    )


def union_published(scraped: DataFrame, supplemental: DataFrame) -> DataFrame:
    return scraped.unionByName(supplemental, allowMissingColumns=True)
