"""Catalogue search over published offers: filters, categories, score, order, badges, facets, tiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.dates import as_date_lit
from offerlens.functions.text import all_matches
from offerlens.operators.ranking import with_rank
from offerlens.session import spread

UPCOMING_DAYS, ENDING_DAYS = 14, 7
CATEGORIES = ("featured", "high-return", "upcoming", "ending", "sold-out", "all")
# Score of each property and the badge wording.
SCORES = {"explicit": 60, "high_return": 35, "upcoming": 22, "ending": 18, "partial": 10, "sold_out": -25}
LIFECYCLE_BADGES = {"active": "進行中", "upcoming": "即將開始", "ended": "已結束", "unknown": "期間待確認"}
HIGH_RETURN_WORD = "高回饋"


def _key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def search_text(df: DataFrame) -> Column:
    """Prose a query is looked up in, lower case."""
    names = [c for c in ("provider_name", "title", "conditions_summary", "editorial_summary", "human_summary") if c in df.columns]
    parts = [F.nullif(F.col(c), F.lit("")) for c in names]
    if "conditions_display" in df.columns:
        parts.append(F.array_join("conditions_display", " "))
    return F.lower(F.concat_ws(" ", *parts))


def highlight_refs(highlights: DataFrame) -> Column:
    """Normalised ids, URLs and titles of the (at most eight) highlights, as one array value."""
    cols = [F.col(c) for c in ("id", "external_id", "url", "title") if c in highlights.columns]
    return highlights.select(F.explode(F.array(*[_key(c) for c in cols])).alias("r")).filter("r <> ''").agg(
        F.collect_set("r")
    ).scalar()


def with_categories(df: DataFrame, as_of: dt.date | str, highlights: DataFrame | None = None) -> DataFrame:
    """Adds the category flags. With highlights, only those are featured; without, any notable offer is."""
    today = as_date_lit(as_of)
    text = search_text(df)
    ids = [_key(F.col(c)) for c in ("id", "external_id", "url", "title") if c in df.columns]
    if highlights is None:
        explicit, chosen = F.lit(False), F.lit(False)
    else:
        refs = highlight_refs(highlights)
        explicit = F.coalesce(F.arrays_overlap(F.array_compact(F.array(*ids)), refs), F.lit(False))
        chosen = F.size(refs) > 0
    flagged = F.coalesce("is_high_return", F.lit(False)) if "is_high_return" in df.columns else F.lit(False)
    staged = df.withColumn("search_text", text)
    high = (
        flagged
        | F.col("search_text").contains(HIGH_RETURN_WORD)
        | F.exists(
            all_matches(F.col("search_text"), r"(\d+(?:\.\d+)?)\s*%", 1), lambda x: x.cast("double") >= 10
        )
    )
    to_start, to_end = F.datediff("start_date", today), F.datediff("end_date", today)
    up = F.coalesce(to_start.between(1, UPCOMING_DAYS), F.lit(False))
    if "is_upcoming" in df.columns:
        up = F.coalesce("is_upcoming", F.lit(False)) | up
    ending = F.coalesce((F.lower("lifecycle") != "ended") & to_end.between(0, ENDING_DAYS), F.lit(False))
    partial = F.coalesce(F.col("quota_status") == "partial_sold_out", F.lit(False))
    staged = (
        staged.withColumn("is_explicit", explicit)
        .withColumn("cat_high_return", high)
        .withColumn("cat_upcoming", up)
        .withColumn("cat_ending", ending)
        .withColumn("cat_sold_out", F.coalesce(F.col("quota_status").isin("sold_out", "partial_sold_out"), F.lit(False)))
    )
    notable = F.col("cat_high_return") | F.col("cat_upcoming") | F.col("cat_ending") | partial
    return staged.withColumn("cat_featured", F.when(chosen, F.col("is_explicit")).otherwise(notable))


def with_score(df: DataFrame) -> DataFrame:
    pts = lambda cond, name: F.when(cond, SCORES[name]).otherwise(0)
    return df.withColumn(
        "score",
        pts(F.col("is_explicit"), "explicit")
        + pts(F.col("cat_high_return"), "high_return")
        + pts(F.col("cat_upcoming"), "upcoming")
        + pts(F.col("cat_ending"), "ending")
        + pts(F.col("quota_status") == "partial_sold_out", "partial")
        + pts(F.col("quota_status") == "sold_out", "sold_out"),
    )


def search(df: DataFrame, query: str = "", provider: str = "", category: str = "featured") -> DataFrame:
    """Filtered catalogue; expects ``with_categories``. The provider filter reaches the scan."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    out = df
    if provider:
        out = out.filter(F.col("provider_name") == provider)
    if query:
        out = out.filter(F.col("search_text").contains(query.lower()))
    if category != "all":
        out = out.filter(F.col("cat_" + category.replace("-", "_")))
    return out


def result_order(category: str = "featured", collation: str | None = "zh_Hant") -> list[Column]:
    """Score (featured, high-return) or end date (ending), then start date, then title; missing dates last."""
    order: list[Column] = []
    if category in ("featured", "high-return"):
        order.append(F.col("score").desc())
    if category == "ending":
        order.append(F.col("end_date").asc_nulls_last())
    title = F.coalesce("title", F.lit(""))
    return [*order, F.col("start_date").asc_nulls_last(), F.collate(title, collation) if collation else title]


def order_results(df: DataFrame, category: str = "featured", collation: str | None = "zh_Hant") -> DataFrame:
    return df.orderBy(*result_order(category, collation))


def rank_results(df: DataFrame, category: str = "featured", tie: str = "seq", collation: str | None = "zh_Hant") -> DataFrame:
    """Results with their ``rank`` (from 1) in the order of a category; ``tie`` decides between equal ones."""
    return with_rank(df, [*result_order(category, collation), F.col(tie)])


# ---------------------------------------------------------------- search by an index

#: Characters of a gram of the index; shorter queries are looked up by a full scan.
GRAM = 3
#: Rarest grams of a query whose rows are intersected before the text is read.
RAREST = 3


def write_postings(df: DataFrame, path: str, key: str) -> None:
    """The index of ``search_text``: one row (gram, key) per row and distinct gram, every file sorted by gram.

    Written with the catalogue. A file holds the grams of its own rows, so texts are dealt once and their many grams are
    never shuffled; a look-up reads of each file the pages whose range holds its grams.
    """
    text = F.col("search_text")
    narrow = spread(df.select(key, F.coalesce(text, F.lit("")).alias("search_text")))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, GRAM))
    rows = narrow.select(key, F.explode(F.array_distinct(F.when(F.length(text) >= GRAM, grams))).alias("gram"))
    rows.sortWithinPartitions("gram", key).write.parquet(path)


def search_indexed(df: DataFrame, postings: DataFrame, key: str, query: str) -> DataFrame:
    """Rows of the catalogue whose ``search_text`` contains ``query``, any case; the same rows as a full scan.

    The rarest grams of the query are intersected in the index and only rows that have them all are read and verified.
    Queries shorter than a gram, the empty one included, are looked up by a scan.
    """
    wanted = query.lower()
    hit = F.col("search_text").contains(wanted)
    if len(wanted) < GRAM:
        return df.filter(hit)
    grams = sorted({wanted[k : k + GRAM] for k in range(len(wanted) - GRAM + 1)})
    found = postings.filter(F.col("gram").isin(*grams)).groupBy("gram").count().collect()  # a row per gram of the query
    if len(found) < len(grams):
        return df.filter(F.lit(False))
    rarest = [r["gram"] for r in sorted(found, key=lambda r: (r["count"], r["gram"]))[:RAREST]]
    keys = postings.filter(F.col("gram").isin(*rarest)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest))
    return df.join(keys.select(key), key, "left_semi").filter(hit)


def with_badge(df: DataFrame, as_of: dt.date | str) -> DataFrame:
    today = as_date_lit(as_of)
    a, b = F.datediff("start_date", today), F.datediff("end_date", today)
    life = F.lower("lifecycle")
    starting = (
        F.when(a == 0, "今日開始").when(a == 1, "明日開始").when(a > 1, F.concat(a.cast("string"), F.lit(" 天後開始")))
    )
    ending = F.when(b == 0, "今日截止").when(b == 1, "明日截止").otherwise(F.concat(F.lit("剩 "), b.cast("string"), F.lit(" 天")))
    fallback = F.coalesce(*[F.when(life == k, F.lit(v)) for k, v in LIFECYCLE_BADGES.items()], F.lit(LIFECYCLE_BADGES["unknown"]))
    return df.withColumn(
        "badge",
        F.coalesce(F.when(life == "upcoming", starting), F.when(F.col("cat_ending"), ending), fallback),
    )


def provider_facets(acts: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Distinct provider names, case-insensitive, with their offer counts; the smallest spelling represents."""
    names = acts.select(F.trim("provider_name").alias("n"), F.lit(1).alias("one"))
    if providers is not None:
        names = names.unionByName(providers.select(F.trim("name").alias("n"), F.lit(0).alias("one")))
    return (
        names.filter("coalesce(n, '') <> ''")
        .groupBy(F.lower("n").alias("facet_key"))
        .agg(F.min("n").alias("provider_name"), F.sum("one").alias("offers"))
    )


def tile_counts(df: DataFrame) -> DataFrame:
    """Dashboard counts over offers that have not ended; expects ``with_categories``."""
    live = F.lower("lifecycle") != "ended"
    return df.agg(
        F.count_if(live).alias("valid"),
        F.count_if(live & F.col("cat_high_return")).alias("high_return"),
        F.count_if(live & F.col("cat_upcoming")).alias("upcoming"),
        F.count_if(live & F.col("cat_sold_out")).alias("sold_out_reminder"),
    )
