"""Query registration and the mapping of the driver tables onto the offer model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import prepare, spread

AS_OF = "1998-06-01"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Lazy readers of one scale factor's tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its ANSI-SQL equivalent."""

    def register(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(Tables(prepare(spark), root))

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return fn

    return register


def text(*parts: Column | str) -> Column:
    """String concatenation with literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def day(c: str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(c, fmt)


# ---------------------------------------------------------------- orders as offers

STATUS_SQL = """CASE WHEN o_orderstatus = 'F' THEN 'sold_out' WHEN o_orderstatus = 'P' THEN 'partial_sold_out'
  WHEN o_orderpriority = '1-URGENT' THEN 'confirmed_available'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'unknown_source_failure'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown_app_only' ELSE 'not_marked_full' END"""


def offer_status() -> Column:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        F.when(s == "F", "sold_out")
        .when(s == "P", "partial_sold_out")
        .when(p == "1-URGENT", "confirmed_available")
        .when(p == "3-MEDIUM", "unknown_source_failure")
        .when(p == "4-NOT SPECIFIED", "unknown_app_only")
        .otherwise("not_marked_full")
    )


def offers(t: Tables) -> DataFrame:
    """orders ⟕ last ship date as offers of the customer's nation."""
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key = F.col("o_orderkey")
    url = text("https://shop", F.col("c_nationkey"), ".example.com/offer?utm_source=feed&z=1&id=", key)
    return rows.select(
        key.alias("seq"),
        text("p", F.col("c_nationkey")).alias("provider_id"),
        F.col("n_name").alias("provider_name"),
        key.cast("string").alias("external_id"),
        text("Offer ", F.col("o_orderpriority"), " #", key).alias("title"),
        url.alias("url"),
        url.alias("source_url"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.col("last_ship").cast("date").alias("end_date"),
        offer_status().alias("quota_status"),
        (F.col("o_orderpriority") == "5-LOW").alias("review_required"),
        (F.col("o_totalprice") / 10000).alias("max_reward_percent"),
        F.col("o_totalprice").alias("fixed_reward_amount"),
    )


OFFERS_SQL = f"""ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey),
offers AS (SELECT o_orderkey AS seq, 'p' || c_nationkey AS provider_id, n_name AS provider_name,
  CAST(o_orderkey AS VARCHAR) AS external_id, 'Offer ' || o_orderpriority || ' #' || o_orderkey AS title,
  'https://shop' || c_nationkey || '.example.com/offer?utm_source=feed&z=1&id=' || o_orderkey AS url,
  CAST(o_orderdate AS DATE) AS start_date, CAST(last_ship AS DATE) AS end_date,
  {STATUS_SQL} AS quota_status, o_orderpriority = '5-LOW' AS review_required,
  o_totalprice / 10000 AS max_reward_percent, o_totalprice AS fixed_reward_amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN ship ON o_orderkey = l_orderkey)"""


def lifecycle_sql(as_of: str = AS_OF, start: str = "start_date", end: str = "end_date") -> str:
    return (
        f"CASE WHEN {start} > DATE '{as_of}' THEN 'upcoming' WHEN {end} < DATE '{as_of}' THEN 'ended' "
        f"WHEN {start} IS NOT NULL OR {end} IS NOT NULL THEN 'active' ELSE 'unknown' END"
    )


SECTION_SQL = """CASE WHEN review_required OR lifecycle = 'unknown' OR quota_status = 'unknown_source_failure' THEN 'review_required'
  WHEN quota_status = 'unknown_app_only' THEN 'app_only_unknown'
  WHEN quota_status IN ('partial_sold_out', 'sold_out') THEN 'sold_out'
  WHEN lifecycle = 'upcoming' THEN 'upcoming' ELSE 'active_public' END"""

LIVE_SQL = f"""{OFFERS_SQL},
lived AS (SELECT *, {lifecycle_sql()} AS lifecycle FROM offers),
sectioned AS (SELECT *, {SECTION_SQL} AS section FROM lived)"""


# ---------------------------------------------------------------- events as attempts

ROLES = {
    "click": "activity_listing",
    "view": "activity_detail",
    "signup": "announcement_listing",
    "purchase": "activity_probe",
    "error": "status_page",
}


def attempts(t: Tables) -> DataFrame:
    """events as source attempts: one run per day, 15 providers, three source names."""
    k = F.get_json_object("props", "$.k").cast("int")
    role = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(r)) for e, r in ROLES.items()])
    e = t.events.withColumn("k", k)
    ok = F.col("k") % 7 != 0
    listing = F.col("event_type").isin("click", "signup")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        text("p", F.col("user_id") % 15).alias("provider_id"),
        text("s", F.col("k") % 3).alias("source_name"),
        role.alias("role"),
        text("https://p", F.col("user_id") % 15, ".example.com/feed/", F.col("event_id")).alias("url"),
        ok.alias("ok"),
        F.when(~ok, F.when(F.col("k") % 2 == 0, "[Errno -2] Name or service not known").otherwise("timed out")).alias("error"),
        F.col("k").alias("discovered_count"),
        F.when(listing & (F.col("k") < 5), "listing_zero_discovery")
        .when(listing & (F.col("k") > 95), "listing_reached_max_links")
        .alias("coverage_issue"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


ATTEMPTS_SQL = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
attempts AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, 'p' || (user_id % 15) AS provider_id, 's' || (k % 3) AS source_name,
  CASE event_type WHEN 'click' THEN 'activity_listing' WHEN 'view' THEN 'activity_detail' WHEN 'signup' THEN 'announcement_listing'
    WHEN 'purchase' THEN 'activity_probe' WHEN 'error' THEN 'status_page' END AS role,
  'https://p' || (user_id % 15) || '.example.com/feed/' || event_id AS url, k % 7 <> 0 AS ok,
  CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN '[Errno -2] Name or service not known' ELSE 'timed out' END END AS error,
  k AS discovered_count,
  CASE WHEN event_type IN ('click', 'signup') AND k < 5 THEN 'listing_zero_discovery'
    WHEN event_type IN ('click', 'signup') AND k > 95 THEN 'listing_reached_max_links' END AS coverage_issue,
  event_id AS seq, ts FROM ev)"""


def registry(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nation as (providers, domains, sources): registry-sized tables."""
    n = F.col("n_nationkey")
    providers = t.nation.select(
        text("p", n).alias("provider_id"),
        F.col("n_name").alias("name"),
        F.when(n % 4 == 0, "public").when(n % 4 == 1, "partial").when(n % 4 == 2, "app_only").otherwise("odd").alias("public_status_scope"),
    )
    domains = t.nation.select(text("p", n).alias("provider_id"), text("shop", n, ".example.com").alias("domain"))
    s = F.explode(
        F.array(
            F.struct(F.lit(0).alias("no"), F.lit("s0").alias("name"), F.lit("activity_listing").alias("role"), F.lit("partial").alias("coverage_scope")),
            F.struct(F.lit(1).alias("no"), F.lit("s1").alias("name"), F.lit("activity_listing").alias("role"), F.when(n % 3 == 0, "partial").otherwise("complete").alias("coverage_scope")),
            F.struct(F.lit(2).alias("no"), F.lit("s0").alias("name"), F.lit("announcement_listing").alias("role"), F.lit(None).cast("string").alias("coverage_scope")),
            F.struct(F.lit(3).alias("no"), F.lit("s0").alias("name"), F.lit("announcement_listing").alias("role"), F.lit(None).cast("string").alias("coverage_scope")),
        )
    )
    sources = t.nation.select(n, s.alias("s")).filter((n % 5 != 4) | (F.col("s.no") >= 2)).select(
        text("p", n).alias("provider_id"),
        (n.cast("bigint") * 10 + F.col("s.no")).alias("seq"),
        "s.name",
        "s.role",
        "s.coverage_scope",
        text("https://shop", n, ".example.com/list/", F.col("s.no")).alias("url"),
        F.lit(None).cast("string").alias("display_url"),
        F.lit("").alias("adapter"),
    )
    return providers, domains, sources


REGISTRY_SQL = """providers AS (SELECT 'p' || n_nationkey AS provider_id, n_name AS name,
  CASE n_nationkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'partial' WHEN 2 THEN 'app_only' ELSE 'odd' END AS public_status_scope FROM nation),
sources AS (SELECT 'p' || n_nationkey AS provider_id, CAST(n_nationkey * 10 + s.no AS BIGINT) AS seq, s.name, s.role,
  CASE WHEN s.no = 0 THEN 'partial' WHEN s.no = 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN 'partial' ELSE 'complete' END END AS coverage_scope,
  'https://shop' || n_nationkey || '.example.com/list/' || s.no AS url
  FROM nation CROSS JOIN (VALUES (0, 's0', 'activity_listing'), (1, 's1', 'activity_listing'),
    (2, 's0', 'announcement_listing'), (3, 's0', 'announcement_listing')) s(no, name, role)
  WHERE n_nationkey % 5 <> 4 OR s.no >= 2)"""


# ---------------------------------------------------------------- orders as listing pages

PAGE_SIZE = 20


def order_pages(t: Tables, item: Column, sep: str = "") -> DataFrame:
    """Listing pages rendered from orders: twenty consecutive keys per page, so a page is bounded."""
    row = F.struct(F.col("o_orderkey").alias("k"), item.alias("v"))
    # Orders are dealt by page before pages are written: rows are narrow, pages are costly to read.
    orders = spread(t.orders.withColumn("page_id", F.floor(F.col("o_orderkey") / PAGE_SIZE)), "page_id")
    return (
        orders.groupBy("page_id")
        .agg(F.array_sort(F.array_agg(row)).alias("rows"))
        .select("page_id", F.array_join(F.transform("rows", lambda r: r["v"]), sep).alias("items"))
    )
