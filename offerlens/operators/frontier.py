"""Numeric id frontier, crawl planning and frontier expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import urls
from offerlens.operators.coverage import mode_filter
from offerlens.operators.keys import first_by
from offerlens.session import staged


# Fixed value: the name under which tasks beyond the crawl cap are reported.
OVERFLOW_SOURCE = "全域擷取上限"


def load_frontier(state: DataFrame) -> DataFrame:
    """State with a missing scan frontier filled from the highest valid id."""
    return state.withColumn(
        "scan_frontier_event_id",
        F.when(F.coalesce("scan_frontier_event_id", F.lit(0)) == 0, F.col("highest_valid_event_id")).otherwise(
            F.col("scan_frontier_event_id")
        ),
    )


def plan_ranges(state: DataFrame, sources: DataFrame) -> DataFrame:
    """Id range to probe per provider: from scratch, or a window behind and a buffer ahead of the frontier.

    ``ids_cut_off``: ids that ``maximum_probe_ids`` leaves for a later run.
    """
    known = state.select(
        "provider_id",
        F.greatest("highest_valid_event_id", F.lit(0)).alias("previous_highest"),
        F.greatest("scan_frontier_event_id", F.lit(0)).alias("previous_frontier"),
    )
    at_least_1 = lambda c, default: F.greatest(F.coalesce(F.col(c), F.lit(default)), F.lit(1))
    s = sources.select(
        "provider_id",
        at_least_1("minimum_event_id", 1).alias("low"),
        F.greatest(at_least_1("bootstrap_end_id", 160), at_least_1("minimum_event_id", 1)).alias("first_end"),
        at_least_1("rescan_window", 128).alias("window"),
        at_least_1("frontier_buffer", 32).alias("buffer"),
        at_least_1("maximum_probe_ids", 220).alias("most"),
    )
    zero = F.lit(0).cast("bigint")
    j = s.join(known, "provider_id", "left").withColumns(
        {
            "previous_highest": F.coalesce("previous_highest", zero),
            "previous_frontier": F.coalesce("previous_frontier", zero),
        }
    )
    started = F.col("previous_frontier") > 0
    start = F.when(started, F.greatest("low", F.col("previous_frontier") - F.col("window") + 1)).otherwise(F.col("low"))
    end = F.when(started, F.col("previous_frontier") + F.col("buffer")).otherwise(F.col("first_end"))
    return (
        j.withColumn("scan_start", start)
        .withColumn("scan_end", F.least(end, F.col("scan_start") + F.col("most") - 1))
        .withColumn("ids_cut_off", F.greatest(end - F.col("scan_end"), F.lit(0)))
        .select("provider_id", "previous_highest", "previous_frontier", "scan_start", "scan_end", "ids_cut_off")
    )


def plan_probe(ranges: DataFrame) -> DataFrame:
    """One row per id to probe."""
    return ranges.filter("scan_end >= scan_start").withColumn(
        "event_id", F.explode(F.sequence("scan_start", "scan_end"))
    )


def classify_probe(captures: DataFrame, text: str = "text", ok_code: str = "0000", empty_code: str = "2001") -> DataFrame:
    """valid, not_found or failure for each probed detail payload."""
    schema = "struct<code:string,data:struct<title:string,activity_start_time:string,activity_end_time:string>>"
    staged = captures.withColumn("__p", F.from_json(text, schema))
    full = lambda c: F.trim(F.coalesce(F.col(f"__p.data.{c}"), F.lit(""))) != ""
    good = (F.col("__p.code") == ok_code) & full("title") & full("activity_start_time") & full("activity_end_time")
    outcome = F.when(F.col("__p.code") == empty_code, "not_found").when(good, "valid").otherwise("failure")
    return staged.withColumn("outcome", outcome).drop("__p")


def scan_summary(ranges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per provider: counts by outcome, completeness, and the ids before and after.

    The last outcome of an id counts. Planned ids without an outcome are
    failures: the planned number is arithmetic on the range, so ids are not
    generated just to be counted.
    """
    last = outcomes.groupBy("provider_id", "event_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    inside = last.join(ranges, "provider_id").filter(F.col("event_id").between(F.col("scan_start"), F.col("scan_end")))
    is_ = lambda v: F.col("outcome") == v
    counted = inside.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("probed_count"),
        F.count_if(is_("valid")).alias("valid_count"),
        F.count_if(is_("not_found")).alias("empty_count"),
        F.count_if(is_("failure")).alias("__failed"),
        F.max(F.when(is_("valid"), F.col("event_id"))).alias("__top"),
    )
    zero = F.lit(0).cast("bigint")
    j = ranges.join(counted, "provider_id", "left")
    for c in ("probed_count", "valid_count", "empty_count", "__failed"):
        j = j.withColumn(c, F.coalesce(c, zero))
    planned = F.greatest(F.col("scan_end") - F.col("scan_start") + 1, zero)
    return (
        j.withColumn("failure_count", F.col("__failed") + planned - F.col("probed_count"))
        .withColumn("complete", F.col("failure_count") == 0)
        .withColumn("highest_valid_event_id", F.greatest("previous_highest", "__top"))
        .withColumn(
            "scan_frontier_event_id",
            F.when(F.col("complete"), F.greatest("previous_frontier", "scan_end")).otherwise(F.col("previous_frontier")),
        )
        .withColumn("frontier_advanced", F.col("scan_frontier_event_id") > F.col("previous_frontier"))
        .drop("__failed", "__top")
    )


def advance_frontier(ranges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New state of providers whose scan answered for every planned id; others keep theirs."""
    return scan_summary(ranges, outcomes).filter("complete").select(
        "provider_id", "highest_valid_event_id", "scan_frontier_event_id"
    )


def unanswered_ids(probe: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Planned minus probed ids."""
    return probe.select("provider_id", "event_id").join(outcomes, ["provider_id", "event_id"], "left_anti")


# ---------------------------------------------------------------- crawl plan


def task_key(provider: Column, fetch_url: Column, external: Column | None = None) -> Column:
    base = F.concat(provider, F.lit("\0"), urls.canonical_url(fetch_url))
    if external is None:
        return base
    return F.concat(base, F.coalesce(F.concat(F.lit("#external_id="), F.nullif(external, F.lit(""))), F.lit("")))


# History that its own listing refreshes, and the detail adapter of each family.
LISTED_FAMILIES = ("easywallet", "ipassmoney", "jkopay")
SYNTHETIC_FAMILIES = ("famipay",)
RECHECK_ADAPTERS = {
    "taiwanpay": "taiwanpay_detail",
    "fullpay": "fullpay_detail",
    "easywallet": "easywallet_detail",
    "ipassmoney": "ipass_detail",
    "jkopay": "jkopay_detail",
}
SHARED_PROVIDER, SHARED_API, SHARED_PAGE, SHARED_ADAPTER = (
    "pxpay",
    "GetEventList",
    "/campaign/pxpay-card/",
    "pxmart_campaign_detail",
)


def plan_rechecks(targets: DataFrame, providers: DataFrame, mode: str = "full") -> DataFrame:
    """Known live offers to visit again, with the adapter their family needs."""
    fetch = F.coalesce(F.nullif("source_url", F.lit("")), F.col("url"))
    p = F.col("provider_id")
    skip = p.isin(*SYNTHETIC_FAMILIES) | ((p == SHARED_PROVIDER) & fetch.contains(SHARED_API))
    if mode == "full":
        skip = skip | p.isin(*LISTED_FAMILIES)
    adapter = F.coalesce(
        *[F.when(p == k, F.lit(v)) for k, v in RECHECK_ADAPTERS.items()],
        F.when((p == SHARED_PROVIDER) & fetch.contains(SHARED_PAGE), F.lit(SHARED_ADAPTER)),
        F.lit(""),
    )
    return (
        targets.filter(~skip)
        .join(providers.select("provider_id"), "provider_id", "left_semi")
        .withColumn("fetch_url", fetch)
        .withColumn("adapter", adapter)
    )


# What a task carries along for the operators that read its capture.
TASK_FACTS = {
    "source_name": "string",
    "display_url": "string",
    "external_id": "string",
    "adapter": "string",
    "title_hint": "string",
    "link_patterns": "array<string>",
    "max_links": "int",
    "start_date": "string",
    "end_date": "string",
}
PLAN_ORDER = ("tier", "provider_seq", "kind", "seq")
PLAN_COLUMNS = ("provider_id", "role", "fetch_url", *TASK_FACTS, *PLAN_ORDER)


def initial_tasks(
    providers: DataFrame,
    sources: DataFrame,
    seeds: DataFrame | None,
    rechecks: DataFrame | None,
    probes: DataFrame | None,
    mode: str,
    scan_adapter: str = "fullpay_id_scan",
) -> DataFrame:
    """Tasks in crawl order: provider by provider its sources and then its seeds, then rechecks, probes last.

    ``providers`` (provider_id, seq) gives the providers' order. In full mode a
    source that scans ids is probed and has no task of its own.
    """
    places = providers.select("provider_id", F.col("seq").cast("bigint").alias("provider_seq"))

    def shaped(df: DataFrame, tier: int, kind: int, **fixed: Column) -> DataFrame:
        df = df.withColumns(fixed | {"tier": F.lit(tier), "kind": F.lit(kind)})
        missing = {n: F.lit(None).cast(k) for n, k in TASK_FACTS.items() if n not in df.columns}
        df = df.withColumns(missing).withColumn("display_url", F.coalesce("display_url", "fetch_url"))
        if tier == 0:
            df = df.drop("provider_seq").join(places, "provider_id", "left")
        else:
            df = df.withColumn("provider_seq", F.lit(0).cast("bigint"))
        return df.select(*PLAN_COLUMNS)

    used = mode_filter(sources, mode)
    if mode == "full":
        used = used.filter(F.coalesce("adapter", F.lit("")) != scan_adapter)
    plan = shaped(used, 0, 0, fetch_url=F.col("url"), source_name=F.col("name"))
    if mode == "full" and seeds is not None:
        named = seeds.withColumn("source_name", F.col("name") if "name" in seeds.columns else F.lit("seed"))
        hint = F.col("title") if "title" in seeds.columns else F.lit(None).cast("string")
        plan = plan.unionByName(
            shaped(named, 0, 1, fetch_url=F.coalesce("fetch_url", "url"), display_url=F.col("url"), title_hint=hint, role=F.lit("activity_detail"))
        )
    if rechecks is not None:
        plan = plan.unionByName(shaped(rechecks, 2, 0, role=F.lit("activity_detail")))
    if mode == "full" and probes is not None:
        plan = plan.unionByName(shaped(probes, 3, 0, role=F.lit("activity_probe")))
    return plan


def distinct_tasks(plan: DataFrame) -> DataFrame:
    """First task of each key in crawl order."""
    keyed = plan.withColumn("task_key", task_key(F.col("provider_id"), F.col("fetch_url"), F.col("external_id")))
    return first_by(keyed, ["task_key"], [F.col(c) for c in PLAN_ORDER])


def crawl_plan(plan: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` distinct tasks: a distributed top-k, no global window."""
    return distinct_tasks(plan).orderBy(*PLAN_ORDER, "task_key").limit(cap)


def pending_overflow(plan: DataFrame, cap: int, run_id: Column | str) -> DataFrame:
    """Distinct tasks beyond the cap per provider, as gap rows of the run: ``coverage_gaps`` takes them as they are.

    The cut is the last planned task's sort key, a single value; everything
    after it overflows. Nothing is ranked globally. ``url`` is the address a
    reader would open for the first of them.
    """
    tasks = distinct_tasks(plan).withColumn("__o", F.struct(*PLAN_ORDER, "task_key"))
    cut = tasks.orderBy("__o").limit(cap).agg(F.max("__o")).scalar()
    return (
        tasks.filter(F.col("__o") > cut)
        .groupBy("provider_id")
        .agg(F.count(F.lit(1)).alias("discovered_count"), F.min_by("display_url", "__o").alias("url"))
        .withColumn("issue", F.lit("crawl_reached_max_total_pages"))
        .withColumn("source_name", F.lit(OVERFLOW_SOURCE))
        .withColumn("run_id", F.lit(run_id) if isinstance(run_id, str) else run_id)
    )


def next_round(edges: DataFrame, seen: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Distinct links not seen before."""
    return edges.select(key).distinct().join(seen.select(key), key, "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Pages reachable from the seeds with the hop they were first seen at; with ``rounds`` only so many hops.

    ``seeds`` has ``page``; ``edges`` has ``src, dst``. Each hop is one table in
    the shared folder and is met again only as part of their union, so nothing
    that grows is rewritten and a lost executor costs at most one hop. Without
    ``rounds`` it ends when a hop finds nothing new.
    """
    hops = [staged(seeds.select("page").distinct().withColumn("hop", F.lit(0)), "hop")]
    while rounds is None or len(hops) <= rounds:
        seen = reduce(DataFrame.unionByName, hops).select("page")
        found = (
            edges.join(hops[-1].select(F.col("page").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("page"))
            .distinct()
            .join(seen, "page", "left_anti")
        )
        found = staged(found.withColumn("hop", F.lit(len(hops))), "hop")
        if found.isEmpty():
            break
        hops.append(found)
    return reduce(DataFrame.unionByName, hops)
