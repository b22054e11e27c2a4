"""Coverage and health of runs, sources and providers, from the attempts fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens import schemas


def per_run(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registry row for every run.

    The registry is a config file; its rows travel as one scalar-subquery array
    and are exploded beside each run, so no join product is planned.
    """
    rows = registry.agg(F.array_agg(F.struct(*registry.columns))).scalar()
    return runs.select("run_id", F.explode(rows).alias("__r")).select("run_id", "__r.*")


def _rate(ok: Column, n: Column) -> Column:
    return F.when(n > 0, F.bround(ok / n, 4)).otherwise(F.lit(1.0))


def _status(ok: Column, n: Column) -> Column:
    return F.when((n > 0) & (ok == 0), "unavailable").when(ok == n, "complete").otherwise("partial")


def health_metric(df: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """expected, succeeded, failed, rate and status of any grouping."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count_if(ok).alias("succeeded"))
    return with_metric(g)


def with_metric(g: DataFrame) -> DataFrame:
    n, ok = F.col("expected"), F.col("succeeded")
    return (
        g.withColumn("failed", F.greatest(n - ok, F.lit(0).cast("bigint")))
        .withColumn("rate", _rate(ok, n))
        .withColumn("status", _status(ok, n))
    )


def run_coverage(attempts: DataFrame, by: str = "run_id", pending: DataFrame | None = None) -> DataFrame:
    """Coverage of each run with transport status, systemic-DNS test and overall status.

    One pass of map-side combined counts, whatever the size of a run.
    ``pending`` holds one row per run and provider left over at the crawl cap.
    """
    dns = F.lower(F.coalesce("error", F.lit(""))).rlike("|".join(schemas.DNS_ERROR_MARKERS))
    g = attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(F.col("coverage_issue").isNotNull()).alias("discovery_issues"),
        F.bool_and(F.when(~F.col("ok"), dns)).alias("__dns"),
    )
    if pending is not None:
        left = pending.groupBy(by).agg(F.count(F.lit(1)).alias("__pending"))
        g = g.join(left, by, "left").withColumn(
            "discovery_issues", F.col("discovery_issues") + F.coalesce("__pending", F.lit(0))
        ).drop("__pending")
    n, ok = F.col("expected"), F.col("succeeded")
    gone = (n > 0) & (ok == 0)
    return (
        g.withColumn("failed", n - ok)
        .withColumn("rate", _rate(ok, n))
        .withColumn("transport_status", _status(ok, n))
        .withColumn("systemic_dns_failure", gone & F.coalesce("__dns", F.lit(False)))
        .withColumn(
            "status",
            F.when(gone, "unavailable")
            .when((F.col("failed") == 0) & (F.col("discovery_issues") == 0), "complete")
            .otherwise("partial"),
        )
        .drop("__dns")
    )


# ---------------------------------------------------------------- sources and attempts


def mode_filter(sources: DataFrame, mode: str) -> DataFrame:
    """A status run visits announcement, mixed and status sources only."""
    if mode != "status":
        return sources
    return sources.filter(
        F.col("role").isin(*schemas.STATUS_MODE_ROLES)
        | F.coalesce(F.col("adapter").isin(*schemas.STATUS_MODE_ADAPTERS), F.lit(False))
    )


#: Salts that share out the attempts of one key while its first ones are found.
SALTS = 32


def _first_attempts(attempts: DataFrame, keys: DataFrame) -> DataFrame:
    """(run_id, provider_id, role, form, k, free): per key the first attempts, in order, as many as its role has sources.

    A key with a third of all attempts is cut in salted parts first, then once more as a whole.
    """
    forms = [(0, F.col("source_name")), (1, F.col("url")), (2, F.lit(""))]
    ways = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), k.alias("k")) for f, k in forms])).alias("w")
    rows = attempts.select("run_id", "provider_id", "role", "seq", "ok", ways).select("run_id", "provider_id", "role", "seq", "ok", "w.form", "w.k")
    rows = rows.join(keys, ["provider_id", "role", "form", "k"])
    group = ["run_id", "provider_id", "role", "form", "k"]
    for part in ([*group, F.pmod(F.xxhash64("seq"), F.lit(SALTS))], group):
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy("seq"))).filter(F.col("rn") <= F.col("most"))
    return rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("seq", "ok"))).alias("free"))


def match_sources(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """One-to-one: in the order of the registry each source takes the first attempt of its provider and role that is left.

    A source with a name matches by name, an unnamed one by URL, one with neither any attempt of its role, so forms
    of one role compete. Who gets what in a run depends on the first attempts of each key only, as many as the role has
    sources: these few are walked in one row per run, provider and role, of registry size. Attempts without a provider
    or role match nobody.

    Returns ``run_id, attempt_seq, source_seq, provider_id, role, ok``.
    """
    name, url = F.coalesce("name", F.lit("")), F.coalesce("url", F.lit(""))
    form = F.when(name != "", 0).when(url != "", 1).otherwise(2)
    s = sources.select("provider_id", "role", F.col("seq").alias("source_seq"), form.alias("form"), F.coalesce(F.nullif(name, F.lit("")), url).alias("k"))
    s = s.withColumn("most", F.count(F.lit(1)).over(Window.partitionBy("provider_id", "role")))
    free = _first_attempts(attempts, s.groupBy("provider_id", "role", "form", "k").agg(F.max("most").alias("most")))
    rows = free.join(s, ["provider_id", "role", "form", "k"]).groupBy("run_id", "provider_id", "role").agg(F.array_sort(F.collect_list(F.struct("source_seq", "free"))).alias("walk"))

    def take(taken: Column, source: Column) -> Column:
        left = F.filter(source["free"], lambda a: ~F.exists(taken, lambda x: x["attempt_seq"] == a["seq"]))
        first = F.transform(F.slice(left, 1, 1), lambda a: F.struct(source["source_seq"].alias("source_seq"), a["seq"].alias("attempt_seq"), a["ok"].alias("ok")))
        return F.concat(taken, first)

    kind = {f.name: f.dataType.simpleString() for f in (*s.schema, *attempts.schema)}
    none = F.expr(f"cast(array() as array<struct<source_seq:{kind['source_seq']},attempt_seq:{kind['seq']},ok:{kind['ok']}>>)")
    hits = rows.select("run_id", "provider_id", "role", F.explode(F.aggregate("walk", none, take)).alias("m"))
    return hits.select("run_id", "m.attempt_seq", "m.source_seq", "provider_id", "role", "m.ok")


def extended_checks(attempts: DataFrame, matched: DataFrame, providers: DataFrame) -> DataFrame:
    """Attempts of known providers that no registered source accounts for, with their check group."""
    group = F.coalesce(
        *[F.when(F.col("role") == r, F.lit(g)) for r, g in schemas.CHECK_GROUPS.items()], F.lit("other")
    )
    taken = matched.select("run_id", F.col("attempt_seq").alias("seq"))
    return (
        attempts.join(providers.select("provider_id"), "provider_id", "left_semi")
        .join(taken, ["run_id", "seq"], "left_anti")
        .withColumn("check_group", group)
    )


def request_health(
    sources: DataFrame,
    attempts: DataFrame,
    providers: DataFrame,
    runs: DataFrame,
    mode: str = "full",
    scans: DataFrame | None = None,
    scan_adapter: str = "fullpay_id_scan",
    by_provider: bool = False,
) -> DataFrame:
    """Registered sources versus follow-up checks per run: one row per level and group.

    Scan sources are judged by their scan summary (``scans``: provider_id,
    complete, and run_id if it differs by run), all others by their matched
    attempt. ``mode`` status counts the sources that such a run visits.
    """
    keys = ["run_id", "provider_id"] if by_provider else ["run_id"]
    used = mode_filter(sources, mode)
    is_scan = F.coalesce(F.col("adapter") == scan_adapter, F.lit(False))
    matched = match_sources(used.filter(~is_scan), attempts)
    # Counts of the registry and counts of what succeeded meet per key; the registry is not spread over the runs.
    hits = matched.filter("ok").groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    if scans is not None:
        each = used.filter(is_scan).groupBy("provider_id").agg(F.count(F.lit(1)).alias("n"))
        done = scans.filter("complete").join(each, "provider_id")
        if "run_id" not in scans.columns:
            done = per_run(runs, done.select("provider_id", "n"))
        hits = hits.unionByName(done.groupBy(*keys).agg(F.sum("n").alias("hits"))).groupBy(*keys).agg(F.sum("hits").alias("hits"))
    if by_provider:
        wanted = per_run(runs, used.groupBy("provider_id").agg(F.count(F.lit(1)).alias("expected")))
    else:
        wanted = runs.select("run_id").withColumn("expected", used.agg(F.count(F.lit(1))).scalar())
    zero = F.lit(0).cast("bigint")
    reg = wanted.join(hits, keys, "left").select(
        *keys, "expected", F.coalesce("hits", zero).alias("succeeded"), F.lit("registered").alias("level"), F.lit("all").alias("check_group")
    )
    ext = extended_checks(attempts, matched, providers)
    levels = (
        ext.rollup(*keys, "check_group")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count_if("ok").alias("succeeded"),
            F.grouping_id().alias("__gid"),
        )
        .filter("__gid <= 1")
        .withColumn("check_group", F.when(F.col("__gid") == 1, "all").otherwise(F.col("check_group")))
        .withColumn("level", F.lit("extended"))
        .drop("__gid")
    )
    return with_metric(reg.unionByName(levels))


# ---------------------------------------------------------------- discovery gaps


def listing_yield(listings: DataFrame, found: str = "total_found", limit: str = "max_links", mode: str = "over") -> DataFrame:
    """Yield issue of a listing. ``over``: more candidates than the limit; ``reached``: the limit was hit."""
    n, m = F.col(found), F.col(limit)
    cut = (n > m) if mode == "over" else (n >= m)
    return listings.withColumn("discovered_count", F.least(n, m)).withColumn(
        "coverage_issue", F.when(n == 0, "listing_zero_discovery").when(cut, "listing_reached_max_links")
    )


def coverage_gaps(
    attempts: DataFrame, providers: DataFrame, sources: DataFrame, runs: DataFrame, pending: DataFrame | None = None, mode: str = "full"
) -> DataFrame:
    """Union of listing issues, crawl-cap overflow and missing or partial discovery sources."""
    cols = ["run_id", "provider_id", "source_name", "url", "issue", "discovered_count"]
    listing = attempts.filter(F.col("coverage_issue").isNotNull()).select(
        "run_id", "provider_id", "source_name", "url", F.col("coverage_issue").alias("issue"), F.col("discovered_count").cast("bigint").alias("discovered_count")
    )
    parts = [listing]
    if pending is not None:
        parts.append(pending.select(*cols))
    if mode == "full":
        found = attempts.filter(F.col("role").isin(*schemas.DISCOVERY_ROLES)).groupBy("run_id", "provider_id").agg(
            F.sum("discovered_count").alias("found")
        )
        scoped = discovery_scope(providers, sources)
        scope = per_run(runs, scoped).join(found, ["run_id", "provider_id"], "left")
        parts.append(
            scope.filter(F.col("discovery_sources") == 0).select(
                "run_id", "provider_id", F.lit("業者活動發現來源").alias("source_name"), F.lit("").alias("url"),
                F.lit("no_verified_activity_listing").alias("issue"), F.lit(0).cast("bigint").alias("discovered_count"),
            )
        )
        parts.append(
            scope.filter((F.col("discovery_sources") > 0) & (F.col("complete_sources") == 0)).select(
                "run_id", "provider_id", F.lit("官方主題活動總覽與關聯圖").alias("source_name"), "url",
                F.lit("partial_public_activity_discovery").alias("issue"),
                F.coalesce("found", F.lit(0)).cast("bigint").alias("discovered_count"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discovery_scope(providers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per provider: number of discovery sources, of complete ones, and the first one's URL."""
    finds = sources.filter(F.col("role").isin(*schemas.DISCOVERY_ROLES)).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("discovery_sources"),
        F.count_if(F.coalesce("coverage_scope", F.lit("complete")) == "complete").alias("complete_sources"),
        F.min_by(F.coalesce("display_url", "url"), "seq").alias("url"),
    )
    return providers.select("provider_id").join(finds, "provider_id", "left").select(
        "provider_id",
        F.coalesce("discovery_sources", F.lit(0)).alias("discovery_sources"),
        F.coalesce("complete_sources", F.lit(0)).alias("complete_sources"),
        "url",
    )


def provider_coverage(attempts: DataFrame, gaps: DataFrame, providers: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and provider: request counters, gap count, distinct gap kinds and discovery status.

    Gap kinds are a closed vocabulary, so the array is bounded whatever the
    number of gaps; the gaps themselves stay rows of ``coverage_gaps``.
    """
    failed_find = ~F.col("ok") & F.col("role").isin(*schemas.DISCOVERY_ROLES)
    counts = attempts.groupBy("run_id", "provider_id").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("ok").alias("succeeded"),
        F.bool_or(failed_find).alias("__failed_find"),
    )
    issues = gaps.groupBy("run_id", "provider_id").agg(
        F.count(F.lit(1)).alias("__gaps"), F.collect_set("issue").alias("__kinds")
    )
    zero = F.lit(0).cast("bigint")
    base = (
        per_run(runs, providers.select("provider_id", "name", "public_status_scope"))
        .join(counts, ["run_id", "provider_id"], "left")
        .join(issues, ["run_id", "provider_id"], "left")
    )
    fetch = F.coalesce("__failed_find", F.lit(False))
    kinds = F.coalesce("__kinds", F.array().cast("array<string>"))
    return (
        base.withColumn("expected", F.coalesce("expected", zero))
        .withColumn("succeeded", F.coalesce("succeeded", zero))
        .withColumn("failed", F.col("expected") - F.col("succeeded"))
        .withColumn("gap_count", F.coalesce("__gaps", zero) + fetch.cast("bigint"))
        .withColumn(
            "gap_kinds",
            F.array_sort(F.when(fetch, F.array_append(kinds, F.lit("source_fetch_failed"))).otherwise(kinds)),
        )
        .withColumn("discovery_status", F.when(F.col("gap_count") > 0, "limited").otherwise("complete"))
        .withColumn(
            "public_status_scope",
            F.when(F.col("public_status_scope").isin(*schemas.STATUS_SCOPES), F.col("public_status_scope")).otherwise("unknown"),
        )
        .drop("__failed_find", "__gaps", "__kinds")
    )


def finalize_coverage(coverage: DataFrame, gaps: DataFrame, by: str = "run_id") -> DataFrame:
    """Gaps downgrade a complete run to partial and become its number of discovery issues."""
    n = gaps.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    count = F.coalesce("__n", F.lit(0).cast("bigint"))
    return (
        coverage.join(n, by, "left")
        .withColumn("discovery_issues", count)
        .withColumn("status", F.when((F.col("status") == "complete") & (count > 0), "partial").otherwise(F.col("status")))
        .drop("__n")
    )


def source_health(coverage: DataFrame, health: DataFrame, gaps: DataFrame) -> DataFrame:
    """Published health line per run from registered and extended failures and gaps."""
    reg = health.filter("level = 'registered'").select(
        "run_id", F.col("expected").alias("official_expected"), F.col("succeeded").alias("official_succeeded"), F.col("failed").alias("official_failed")
    )
    ext = health.filter("level = 'extended' AND check_group = 'all'").select("run_id", F.col("failed").alias("extended_failed"))
    n = gaps.groupBy("run_id").agg(F.count(F.lit(1)).alias("needs_review"))
    j = (
        coverage.select("run_id", "expected", "succeeded")
        .join(reg, "run_id", "left")
        .join(ext, "run_id", "left")
        .join(n, "run_id", "left")
        .na.fill(0, ["official_expected", "official_succeeded", "official_failed", "extended_failed", "needs_review"])
    )
    return j.withColumn(
        "health",
        F.when((F.col("official_expected") > 0) & (F.col("official_succeeded") == 0), "unavailable")
        .when((F.col("official_failed") == 0) & (F.col("extended_failed") == 0) & (F.col("needs_review") == 0), "normal")
        .otherwise("partial"),
    )


def infer_status(coverage: DataFrame, gaps: str = "discovery_issues") -> DataFrame:
    """Verdict of a run: failed, partial, success, or unknown when there is no coverage."""
    verdict = (
        F.when(F.col("transport_status").isNull(), "unknown")
        .when((F.col("transport_status") == "unavailable") | F.col("systemic_dns_failure"), "failed")
        .when((F.col("failed") > 0) | (F.col(gaps) > 0), "partial")
        .otherwise("success")
    )
    return coverage.withColumn("verdict", verdict)


def publish_gate(coverage: DataFrame) -> DataFrame:
    """A fully failed run must not publish; a systemic DNS failure asks for one retry."""
    return coverage.withColumn("may_publish", F.col("transport_status") != "unavailable").withColumn(
        "retry_once", F.col("systemic_dns_failure")
    )

