"""Announcement linkage: which offers does a sold-out notice concern?

The naive form compares every announcement of a provider with every offer of
that provider. Here both sides are reduced to *link keys* — an event
identifier, a canonical URL, or a title variant — and meet in equality joins.

Nothing expands pairs inside a key: announcements are first summarised per key
(map-side combined), then each offer looks its keys up. A key shared by a
third of all offers and a third of all announcements therefore costs one
summary row, not a product. Evidence keeps the same shape: ``activity_links``
(offer, key) and ``announcement_links`` (key, announcement) hold every pair
without writing each of them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import dates, titles, urls
from offerlens.operators.similarity import RATIO, sequence_ratio, similar_titles

MIN_CORE = 3
_SEP = "\u0001"


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(_SEP, F.lit(kind), *parts)


def _strings() -> Column:
    return F.array().cast("array<string>")


def _title_fields(df: DataFrame, title: str, text: str) -> DataFrame:
    norm = titles.normal_title(F.col(title))
    months = dates.mentioned_months(F.concat(F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    mask = F.aggregate(months, F.lit(0), lambda acc, m: acc.bitwiseOR(F.pow(F.lit(2), m - 1).cast("int")))
    usable = (norm != "") & ~norm.isin(*titles.GENERIC_MATCH_TITLES)
    return (
        df.withColumn("norm", F.when(usable, norm))
        .withColumn("core", F.when(usable, titles.core_title(F.col(title))))
        .withColumn("months", F.when(usable, mask))
    )


def _title_keys(provider: Column) -> Column:
    """A title is looked up by its normal form and by its core, each with its months as a 12-bit mask.

    All titles of one core and mask are one key, however many numbers or dates
    tell them apart, so a campaign name that a third of the offers share is at
    most 4096 keys.
    """
    mask = F.col("months").cast("string")
    by_core = F.when(F.length("core") >= MIN_CORE, _key("core", provider, F.col("core"), mask))
    return F.array_compact(F.array(_when_titled(_key("norm", provider, F.col("norm"), mask)), _when_titled(by_core)))


def _when_titled(value: Column) -> Column:
    return F.when(F.col("norm").isNotNull(), value)


def keyed_activities(acts: DataFrame) -> DataFrame:
    """Offers with their link keys. Expects ``activity_id, provider_id, url, title, text``."""
    p = F.col("provider_id")
    ids = F.transform(
        urls.event_identifiers(F.col("url"), F.coalesce("text", F.lit(""))), lambda i: _key("id", p, i)
    )
    canon = urls.canonical_url(F.col("url"))
    return (
        _title_fields(acts, "title", "text")
        .withColumn("canonical_url", canon)
        .withColumn("title_keys", _title_keys(p))
        .withColumn("keys", F.concat(ids, F.array(_key("url", p, F.col("canonical_url")))))
    )


def keyed_announcements(anns: DataFrame) -> DataFrame:
    """Sold-out announcements with their link keys. Expects ``announcement_id, provider_id, url, title, text``
    and the classifier's ``quota_status``."""
    p = F.col("provider_id")
    text = F.coalesce("text", F.lit(""))
    ids = F.transform(urls.event_identifiers(F.col("url"), text), lambda i: _key("id", p, i))
    named = F.transform(urls.mentioned_urls(text), lambda u: _key("url", p, urls.canonical_url(u)))
    # Without keys an announcement meets nobody. A filter instead would be pushed
    # below the projection and classify every text twice.
    sold = F.col("quota_status").isin("sold_out", "partial_sold_out")
    return (
        _title_fields(anns, "title", "text")
        .withColumn("canonical_url", urls.canonical_url(F.col("url")))
        .withColumn("title_keys", F.when(sold, _title_keys(p)).otherwise(_strings()))
        .withColumn("keys", F.when(sold, F.array_distinct(F.concat(ids, named))).otherwise(_strings()))
    )


# ---------------------------------------------------------------- title pairs


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))
    )


def contained_cores(left: DataFrame, right: DataFrame, min_core: int = MIN_CORE) -> DataFrame:
    """Pairs of distinct core titles of one provider where the shorter lies inside the longer.

    The shorter one is looked up by its rarest n-gram only; the longer one
    offers all of its n-grams. Every containment shares that n-gram.
    """
    def cores(df: DataFrame) -> DataFrame:
        return df.filter(F.length("core") >= min_core).select("provider_id", "core").distinct()

    a, n = cores(left), cores(right)
    grams = lambda df: df.withColumn("gram", F.explode(_grams(F.col("core"), min_core)))
    ga, gn = grams(a), grams(n)
    freq = ga.unionByName(gn).groupBy("provider_id", "gram").agg(F.count(F.lit(1)).alias("freq"))

    def rarest(g: DataFrame) -> DataFrame:
        return g.join(freq, ["provider_id", "gram"]).groupBy("provider_id", "core").agg(
            F.min_by("gram", F.struct("freq", "gram")).alias("gram")
        )

    a_in_n = (
        rarest(ga).withColumnRenamed("core", "a_core")
        .join(gn.withColumnRenamed("core", "n_core"), ["provider_id", "gram"])
        .filter((F.length("a_core") <= F.length("n_core")) & F.col("n_core").contains(F.col("a_core")))
    )
    n_in_a = (
        rarest(gn).withColumnRenamed("core", "n_core")
        .join(ga.withColumnRenamed("core", "a_core"), ["provider_id", "gram"])
        .filter((F.length("n_core") < F.length("a_core")) & F.col("a_core").contains(F.col("n_core")))
    )
    cols = ["provider_id", "a_core", "n_core"]
    return a_in_n.select(*cols).unionByName(n_in_a.select(*cols))


def _keyed_titles(keyed: DataFrame, kind: str, side: str) -> DataFrame:
    """Distinct (provider_id, value, months, key) of one title form; ``kind`` is norm or core."""
    rows = keyed.select("provider_id", kind, "months", F.explode("title_keys").alias("key"))
    rows = rows.filter(F.col("key").startswith(kind + _SEP)).distinct()
    return rows.withColumnsRenamed({c: f"{side}_{c}" for c in (kind, "months", "key")})


def title_links(acts: DataFrame, anns: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a_key, n_key, score): title keys that match and whose months do not conflict; score is NULL for cores.

    Norms meet by ratio, cores by containment. Rows are pairs of keys, never of
    offers or announcements.
    """
    an, nn = _keyed_titles(acts, "norm", "a"), _keyed_titles(anns, "norm", "n")
    ac, nc = _keyed_titles(acts, "core", "a"), _keyed_titles(anns, "core", "n")
    by_ratio = similar_titles(
        an.select("provider_id", F.col("a_norm").alias("norm")), nn.select("provider_id", F.col("n_norm").alias("norm")), ratio
    )
    by_core = contained_cores(
        ac.select("provider_id", F.col("a_core").alias("core")), nc.select("provider_id", F.col("n_core").alias("core"))
    ).withColumn("score", F.lit(None).cast("double"))
    by_ratio = by_ratio.join(an, ["provider_id", "a_norm"]).join(nn, ["provider_id", "n_norm"])
    by_core = by_core.join(ac, ["provider_id", "a_core"]).join(nc, ["provider_id", "n_core"])
    cols = ["a_key", "n_key", "a_months", "n_months", "score"]
    both = by_ratio.select(*cols).unionByName(by_core.select(*cols))
    a, n = F.col("a_months"), F.col("n_months")
    return both.filter((a == 0) | (n == 0) | (a.bitwiseAND(n) != 0)).select("a_key", "n_key", "score")


# ---------------------------------------------------------------- applying matches


def _summary_columns() -> list[Column]:
    """Per key: the smallest and largest URL of each status.

    Two URLs are enough to know whether some announcement under the key lives
    on a page other than the offer's own.
    """
    url, status = F.col("canonical_url"), F.col("quota_status")
    out = []
    for name, value in (("sold", "sold_out"), ("part", "partial_sold_out")):
        u = F.when(status == value, url)
        out += [F.min(u).alias(f"{name}_min"), F.max(u).alias(f"{name}_max")]
    return out


def _merge_columns() -> list[Column]:
    return [
        f(c).alias(c)
        for n in ("sold", "part")
        for f, c in ((F.min, f"{n}_min"), (F.max, f"{n}_max"))
    ]


def key_summaries(anns: DataFrame, links: DataFrame | None) -> DataFrame:
    """One row per link key; title keys are those of the offer side."""
    direct = anns.select(F.explode("keys").alias("key"), "canonical_url", "quota_status")
    parts = direct.groupBy("key").agg(*_summary_columns())
    if links is not None:
        titled = anns.select(F.explode("title_keys").alias("n_key"), "canonical_url", "quota_status")
        per_key = titled.groupBy("n_key").agg(*_summary_columns())
        by_title = links.join(per_key, "n_key").groupBy(F.col("a_key").alias("key")).agg(*_merge_columns())
        parts = parts.unionByName(by_title)
    return parts


def apply_matches(acts: DataFrame, anns: DataFrame, with_titles: bool = True) -> DataFrame:
    """Offers with the status their announcements give them: sold out wins, partial never downgrades it.

    Takes the outputs of ``keyed_activities`` and ``keyed_announcements``. A
    matched offer's quota evidence is complete; its evidence rows and components
    come from ``evidence_of`` and ``components_of`` over the same links.
    """
    links = title_links(acts, anns) if with_titles else None
    summary = key_summaries(anns, links)
    keys = F.concat("keys", "title_keys") if with_titles else F.col("keys")
    looked = (
        acts.select("activity_id", "canonical_url", F.explode(keys).alias("key"))
        .join(summary, "key")
        .groupBy("activity_id")
        .agg(F.first("canonical_url").alias("__own"), *_merge_columns())
    )
    other = lambda n: F.coalesce(
        (F.col(f"{n}_min") != F.col("__own")) | (F.col(f"{n}_max") != F.col("__own")), F.lit(False)
    )
    flags = looked.select("activity_id", other("sold").alias("__sold"), other("part").alias("__part"))
    sold, part = (F.coalesce(F.col(c), F.lit(False)) for c in ("__sold", "__part"))
    joined = acts.join(flags, "activity_id", "left")
    complete = F.coalesce("quota_evidence_complete", F.lit(False)) if "quota_evidence_complete" in acts.columns else F.lit(False)
    return (
        joined.withColumn("matched", sold | part)
        .withColumn(
            "new_status",
            F.when(sold | (F.col("quota_status") == "sold_out"), "sold_out")
            .when(part, "partial_sold_out")
            .otherwise(F.col("quota_status")),
        )
        .withColumn("quota_evidence_complete", sold | part | complete)
        .drop("__sold", "__part")
    )


def activity_links(acts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Offer side of the evidence: (activity_id, key, method, score)."""
    direct = acts.select("activity_id", F.explode("keys").alias("key")).select(
        "activity_id", "key", F.lit("event_id_or_url").alias("method"), F.lit(1.0).alias("score")
    )
    if links is None:
        return direct
    by_title = (
        acts.select("activity_id", F.explode("title_keys").alias("a_key"))
        .join(links, "a_key")
        .select("activity_id", F.col("n_key").alias("key"), F.lit("normalized_title_period").alias("method"), "score")
    )
    return direct.unionByName(by_title)


def announcement_links(anns: DataFrame) -> DataFrame:
    """Announcement side of the evidence: (key, announcement_id, excerpt, components ...)."""
    facts = [c for c in ("norm", "quota_components", "fetched_at", "content_hash") if c in anns.columns]
    return anns.select(
        F.explode(F.concat("keys", "title_keys")).alias("key"), "announcement_id", "canonical_url", "quota_status", "quota_excerpt", *facts
    )


def _written_pairs(activity_ids: DataFrame, links: DataFrame, notices: DataFrame) -> DataFrame:
    mine = activity_ids.withColumnsRenamed({"canonical_url": "__own", "norm": "__norm"})
    return mine.join(links, "activity_id").join(notices, "key").filter(F.col("canonical_url") != F.col("__own"))


def evidence_of(activity_ids: DataFrame, links: DataFrame, notices: DataFrame) -> DataFrame:
    """Written-out evidence of chosen offers (activity_id, canonical_url, norm): one row per announcement, strongest method.

    A match by core carries the ratio of the two titles, like any title match.
    ``kind`` names method and score.
    """
    pairs = _written_pairs(activity_ids, links, notices)
    best = F.struct(F.col("method") == "event_id_or_url", F.coalesce("score", F.lit(0.0)))
    extra = [c for c in ("fetched_at", "content_hash") if c in notices.columns]
    found = pairs.groupBy("activity_id", "announcement_id").agg(
        F.max_by("method", best).alias("method"),
        F.max_by("score", best).alias("score"),
        F.min("__norm").alias("__a"),
        F.min("norm").alias("__n"),
        F.min("canonical_url").alias("source_url"),
        F.min("quota_status").alias("quota_status"),
        F.min("quota_excerpt").alias("excerpt"),
        *[F.min(c).alias(c) for c in extra],
    )
    by_core = F.col("score").isNull()
    scored = found.withColumn("score", F.coalesce("score", sequence_ratio(F.when(by_core, F.col("__a")), F.when(by_core, F.col("__n")))))
    kind = F.concat_ws(":", F.lit("latest_announcement"), "method", F.format_string("%.2f", "score"))
    return scored.withColumn("kind", kind).drop("__a", "__n")


def components_of(activity_ids: DataFrame, links: DataFrame, notices: DataFrame) -> DataFrame:
    """Sold-out parts that announcements add to chosen offers, as distinct rows (activity_id, status, period, component, evidence)."""
    rows = _written_pairs(activity_ids, links, notices).select("activity_id", F.explode("quota_components").alias("c"))
    return rows.select("activity_id", "c.status", "c.period", "c.component", "c.evidence").distinct()
