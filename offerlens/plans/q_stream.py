"""Stream jobs run to completion over the events table."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.plans.base import ATTEMPTS_SQL, Tables, attempts, query
from offerlens.plans.q_state import SEEN_SQL, STICKY_SQL, observations
from offerlens.session import new_table_dir
from offerlens.streaming import jobs, keyed


class StreamTables(Tables):
    """The same tables; ``events`` is read as a stream."""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.root}/events.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(self.root)


def _stream(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.root)


@query("stream_status_tracker", f"WITH {STICKY_SQL}")
def stream_status_tracker(t: Tables):
    out = jobs.run_tracker(t.spark, observations(_stream(t)), ["activity_id"], "quota_status", ["ts", "event_id"])
    return out.select("activity_id", "quota_status", "observations")


@query(
    "stream_health_windows",
    f"""WITH {ATTEMPTS_SQL} SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, provider_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded FROM attempts GROUP BY ALL""",
)
def stream_health_windows(t: Tables):
    w = jobs.health_windows(attempts(_stream(t)), "ts", ["provider_id"], "6 hours", "1 hour")
    log = jobs.run_to_table(t.spark, w, "health", "update")
    # Update mode logs a window once per batch that touched it: the last one is current.
    latest = log.groupBy("window_start", "provider_id").agg(F.max_by(F.struct("expected", "succeeded"), "batch_id").alias("r"))
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "provider_id", "r.expected", "r.succeeded")


@query("stream_dedupe", "SELECT user_id, count(DISTINCT event_id) AS observations FROM events GROUP BY user_id")
def stream_dedupe(t: Tables):
    """Every event delivered twice; each is kept once."""
    events = _stream(t).events.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    kept = jobs.dedupe_stream(twice, "ts", ["event_id"], "1 hour").select("user_id", "event_id")
    return jobs.run_to_table(t.spark, kept, "dedupe", "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("observations"))


# ---------------------------------------------------------------- many batches, late rows, restarts

#: Events arrive in batches of eight days, every tenth one a batch late; rows older than the watermark are dropped.
BATCHES, BATCH_DAYS, LATE_DAYS, IDLE_DAYS = 5, 8, 4, 6
ARRIVALS_SQL = f"""arrivals AS MATERIALIZED (SELECT *, (day(ts) - 1) // {BATCH_DAYS} + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS batch FROM events)"""


def _mark_sql(batch: int) -> str:
    """The watermark after a batch: the greatest time seen so far, in milliseconds, less the lateness."""
    return f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {LATE_DAYS} DAY FROM arrivals WHERE batch <= {batch})"


class ReplayTables(Tables):
    """The same tables; ``events`` is a stream over a folder that fills batch by batch."""

    folder = ""

    @property
    def events(self):
        schema = self.spark.read.parquet(f"{self.root}/events.parquet").schema
        return self.spark.readStream.schema(schema).parquet(self.folder)


def replay(t: Tables, step: Callable[[ReplayTables], None], copies: int = 1) -> None:
    """Run ``step`` after each batch of arrivals; it starts its query anew and goes on from its checkpoint.

    With ``copies`` 2 each event is delivered again with the next batch.
    """
    stream = ReplayTables(t.spark, t.root)
    stream.folder, sorted_dir = new_table_dir(t.spark, "arrivals"), new_table_dir(t.spark, "batches")
    batch = F.floor((F.dayofmonth("ts") - 1) / BATCH_DAYS) + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    again = F.explode(F.array(*[F.lit(k) for k in range(copies)]))
    rows = t.events.withColumn("batch", batch).withColumn("copy", again)
    rows.withColumn("batch", F.col("batch") + F.col("copy")).drop("copy").write.partitionBy("batch").parquet(sorted_dir)
    for k in range(BATCHES + copies - 1):
        t.spark.read.schema(t.events.schema).parquet(f"{sorted_dir}/batch={k}").write.mode("append").parquet(stream.folder)
        step(stream)


def tracked(t: Tables, every: int) -> str:
    """The log folder of the keyed tracker after all batches."""
    table, checkpoint = new_table_dir(t.spark, "tracker"), new_table_dir(t.spark, "tracker-ckpt")

    def step(stream: ReplayTables) -> None:
        seen = observations(stream).select("activity_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "quota_status")
        jobs._finish(keyed.track(seen, "activity_id", f"{LATE_DAYS} days", IDLE_DAYS * 86_400_000, table, checkpoint, every))

    replay(t, step)
    return table


_FOLD = """list_reduce(list_transform(list_sort(obs), lambda x: x.quota_status), lambda s, x: CASE WHEN s IN ('sold_out', 'partial_sold_out') AND x IN ('not_marked_full', 'unknown_app_only', 'unknown_source_failure') THEN s
  WHEN s = 'unknown_app_only' AND x = 'not_marked_full' THEN s ELSE x END)"""


def _tracker_sql() -> str:
    """Batch by batch: rows newer than the watermark join the living keys; keys idle for too long leave."""
    steps = [f"{SEEN_SQL}", ARRIVALS_SQL, "seen AS MATERIALIZED (SELECT o.*, a.batch FROM o JOIN arrivals a USING (event_id))"]
    steps.append("alive_start AS (SELECT '' AS activity_id, '' AS status, [{'ts': TIMESTAMP '2000-01-01', 'event_id': 0::BIGINT, 'quota_status': ''}] AS obs WHERE false)")
    before = "alive_start"
    for b in range(BATCHES):
        fresh = f" AND ts > {_mark_sql(b - 1)}" if b else ""
        idle = f"epoch_ms(last) + {IDLE_DAYS * 86_400_000} <= epoch_ms({_mark_sql(b)})"
        steps.append(f"in_{b} AS (SELECT activity_id, list({{'ts': ts, 'event_id': event_id, 'quota_status': quota_status}}) AS obs FROM seen WHERE batch = {b}{fresh} GROUP BY 1)")
        steps.append(
            f"key_{b} AS MATERIALIZED (SELECT *, {_FOLD} AS status, list_max(list_transform(obs, lambda x: x.ts)) AS last FROM (SELECT activity_id, p.status AS was, n.obs IS NOT NULL AS touched,"
            f" list_concat(coalesce(p.obs, []), coalesce(n.obs, [])) AS obs FROM {before} p FULL JOIN in_{b} n USING (activity_id)))"
        )
        steps.append(f"alive_{b} AS (SELECT activity_id, status, obs, last FROM key_{b} WHERE NOT ({idle}))")
        steps.append(
            f"log_{b} AS (SELECT activity_id, CASE WHEN was IS NULL THEN 'new' WHEN was = status THEN 'same' ELSE 'change' END AS kind, was AS from_status, status AS to_status, len(obs) AS observations, last AS last_seen"
            f" FROM key_{b} WHERE touched UNION ALL SELECT activity_id, 'expired', status, NULL, len(obs), last FROM key_{b} WHERE {idle})"
        )
        before = f"alive_{b}"
    return ", ".join(steps)


@query("stream_status_log", f"WITH {_tracker_sql()} " + " UNION ALL ".join(f"SELECT * FROM log_{b}" for b in range(BATCHES)))
def stream_status_log(t: Tables):
    """What became of each key in each batch, restarted after every one: first seen, changed, unchanged, expired."""
    log = t.spark.read.parquet(f"{tracked(t, every=100)}/log")
    return log.select("activity_id", "kind", "from_status", "to_status", "observations", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("stream_status_current", f"WITH {_tracker_sql()} SELECT activity_id, status AS quota_status, len(obs) AS observations FROM alive_{BATCHES - 1}")
def stream_status_current(t: Tables):
    """Statuses of the living keys from the compacted log, a version after every second batch."""
    now = keyed.current_status(t.spark, tracked(t, every=2), "activity_id")
    return now.select("activity_id", F.col("to_status").alias("quota_status"), "observations")


def _after_sql(late: str) -> str:
    """Arrivals that are not late: ``late`` tells from the watermark ``m`` before the batch."""
    return f"""{ARRIVALS_SQL}, marks AS (SELECT b AS batch, CASE b {" ".join(f"WHEN {b} THEN {_mark_sql(b - 1)}" for b in range(1, BATCHES + 1))} END AS m FROM range(0, {BATCHES + 1}) r(b)),
ontime AS (SELECT a.* FROM arrivals a JOIN marks USING (batch) WHERE m IS NULL OR NOT ({late}))"""


@query(
    "stream_health_late",
    f"""WITH {_after_sql("time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= m")}, {ATTEMPTS_SQL.replace("FROM events", "FROM ontime")}
SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, provider_id, count(*) AS expected, count(*) FILTER (ok) AS succeeded FROM attempts GROUP BY ALL""",
)
def stream_health_late(t: Tables):
    """Coverage per window over five batches with restarts; an attempt counts unless its whole window is older than the watermark."""
    table, checkpoint = new_table_dir(t.spark, "health"), new_table_dir(t.spark, "health-ckpt")

    def step(stream: ReplayTables) -> None:
        w = jobs.health_windows(attempts(stream), "ts", ["provider_id"], "6 hours", f"{LATE_DAYS} days")
        jobs._finish(jobs._log_batches(w, table, checkpoint, "update"))

    replay(t, step)
    log = t.spark.read.parquet(table)
    latest = log.groupBy("window_start", "provider_id").agg(F.max_by(F.struct("expected", "succeeded"), "batch_id").alias("r"))
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "provider_id", "r.expected", "r.succeeded")


@query("stream_dedupe_late", f"WITH {_after_sql('ts <= m')} SELECT user_id, count(*) AS observations FROM ontime GROUP BY user_id")
def stream_dedupe_late(t: Tables):
    """Each event comes again with the next batch; kept is the first delivery, unless it is late itself."""
    table, checkpoint = new_table_dir(t.spark, "dedupe"), new_table_dir(t.spark, "dedupe-ckpt")

    def step(stream: ReplayTables) -> None:
        rows = stream.events.withColumn("ts", F.col("ts").cast("timestamp"))
        kept = jobs.dedupe_stream(rows, "ts", ["event_id"], f"{LATE_DAYS} days").select("user_id", "event_id")
        jobs._finish(jobs._log_batches(kept, table, checkpoint, "append"))

    replay(t, step, copies=2)
    return t.spark.read.parquet(table).groupBy("user_id").agg(F.count(F.lit(1)).alias("observations"))
