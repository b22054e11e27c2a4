"""Status tracker with keyed state and timers: sticky status, change feed and expiry inside the stream, and a compacted log.

State of a key is the three newest observations that the sticky rules depend on, its status, and when it was last seen.
Keys are held together in ``BUCKETS`` buckets, as each call to the state store costs far more than the work on a key: a batch
reads and writes a bucket once. Each batch emits one row per touched key that says what became of it, so the change feed
is a filter of the log and not a join with earlier batches. A key that nobody observed for long enough leaves the state
through the event-time timer of its bucket, which is set to the earliest of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from offerlens.operators.state import STICKY
from offerlens.sources import versions

DECISIVE = (*STICKY, "confirmed_available")
NOTHING = "not_marked_full"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN = ("decisive", "telling", "last")
STATE = ", ".join(f"{n}_ts bigint, {n}_seq bigint, {n}_status string" for n in _SEEN) + ", observations bigint, status string, due bigint"
#: Buckets of keys; fixed for the life of a checkpoint.
BUCKETS = 256
LOG = "kind string, from_status string, to_status string, observations bigint, last_seen timestamp"


def sticky(newest: dict[str, tuple | None]) -> str:
    """Status of a key from its newest decisive, telling and last observation (time, number, status)."""
    told, sure = newest["telling"], newest["decisive"]
    if told is None:
        return NOTHING
    if sure is not None and sure[2] in STICKY:
        return sure[2]
    return told[2] if told == newest["last"] or told[2] == "unknown_app_only" else NOTHING


class StatusProcessor(StatefulProcessor):
    """Folds observations (key, ts, seq, quota_status) of the keys of a bucket; ``idle_ms`` after its last one a key is forgotten."""

    def __init__(self, key: str, kind: str, idle_ms: int) -> None:
        self.key, self.kind, self.idle_ms = key, kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("keys", f"k {self.kind}, {STATE}")
        self.timer = handle.getValueState("timer", "due bigint")

    def _held(self) -> dict:
        """Key to (newest decisive, telling and last observation, observations, status, due)."""
        held = {}
        for row in self.state.get() if self.state.exists() else ():
            newest = [None if row[3 * k + 1] is None else tuple(row[3 * k + 1 : 3 * k + 4]) for k in range(len(_SEEN))]
            held[row[0]] = (newest, *row[10:13])
        return held

    def _keep(self, held: dict) -> None:
        """Write the keys and set the timer to the earliest one that would be forgotten."""
        rows = [(key, *[v for seen in newest for v in (seen or (None, None, None))], *rest) for key, (newest, *rest) in held.items()]
        if rows:
            self.state.put(rows)
        elif self.state.exists():
            self.state.clear()
        before = self.timer.get()[0] if self.timer.exists() else None
        due = min((h[3] for h in held.values()), default=None)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
                self.timer.clear()
            if due is not None:
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        rows = [(*row, pd.Timestamp(last_us, unit="us")) for *row, last_us in rows]
        return pd.DataFrame(rows, columns=[self.key, "kind", "from_status", "to_status", "observations", "last_seen"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        whole = self.kind in ("tinyint", "smallint", "int", "bigint")
        found: dict = {}
        for frame in rows:
            for k, ts, seq, status in zip(frame[self.key], frame["ts"], frame["seq"], frame["quota_status"]):
                k = None if pd.isna(k) else int(k) if whole else k
                if k not in found:
                    # An observation without a status does not outlast its batch.
                    before, count = held[k][:2] if k in held else ([None] * len(_SEEN), 0)
                    found[k] = [[seen if seen and seen[2] is not None else None for seen in before], count]
                newest = found[k][0]
                found[k][1] += 1
                status = None if pd.isna(status) else status
                seen = (ts.value // 1000, int(seq), status)
                for n, counts in enumerate((status in DECISIVE, status != NOTHING, True)):
                    if counts and (newest[n] is None or seen > newest[n]):
                        newest[n] = seen
        out = []
        for k, (newest, count) in found.items():
            now, before, last_us = sticky(dict(zip(_SEEN, newest))), held[k][2] if k in held else None, newest[-1][0]
            out.append((k, "new" if k not in held else "same" if before == now else "change", before, now, count, last_us))
            held[k] = (newest, count, now, last_us // 1000 + self.idle_ms)
        self._keep(held)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer that has run out is gone; those of other keys of the bucket may be due as well.
        self.timer.clear()
        held, mark = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = {k for k, h in held.items() if h[3] <= mark}
        out = [(k, "expired", held[k][2], None, held[k][1], held[k][0][-1][0]) for k in gone]
        self._keep({k: h for k, h in held.items() if k not in gone})
        yield self._rows(out)

    def close(self) -> None:
        pass


def _compact(spark: SparkSession, table: str, key: str, upto: int) -> None:
    """A new version of the current statuses: the last one and the batches since; expired keys leave it."""
    versions.commit_run(spark, f"{table}/current", upto, {"status": _latest(spark, table, key, upto)})


def _latest(spark: SparkSession, table: str, key: str, upto: int) -> DataFrame:
    """Current row of every key after batch ``upto``, from the newest version and the batches behind it."""
    done = versions.latest(spark, f"{table}/current")
    first = -1 if done is None else done
    recent = [f"{table}/log/batch_id={n}" for n in range(first + 1, upto + 1)]
    out = None if done is None else versions.read_state(spark, f"{table}/current", "status", done)
    if recent:
        new = spark.read.option("basePath", f"{table}/log").parquet(*recent)
        out = new if out is None else out.unionByName(new)
    rest = [c for c in out.columns if c != key]
    # An expiry follows the rows of its own batch.
    best = F.max_by(F.struct(*rest), F.struct("batch_id", (F.col("kind") == "expired").cast("int")))
    return out.groupBy(key).agg(best.alias("r")).select(key, "r.*").filter("kind <> 'expired'")


def last_batch(spark: SparkSession, table: str) -> int | None:
    fs, root, _ = versions._fs(spark, f"{table}/log")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]
    return max(found, default=None)


def track(observations: DataFrame, key: str, lateness: str, idle_ms: int, table: str, checkpoint: str, every: int = 8) -> StreamingQuery:
    """Run the tracker over what is available: ``observations`` (key, ts, seq, quota_status) is a stream.

    Each batch is logged in a folder of its own, a replayed one replaces itself. After every ``every`` batches the log is
    merged into a version of current statuses, so that reading these takes one version and fewer than ``every`` batches
    however long the stream has run. Rows older than the watermark (greatest ``ts`` less ``lateness``) are dropped.
    """
    spark = observations.sparkSession
    rows = observations.select(key, "ts", F.col("seq").cast("bigint").alias("seq"), "quota_status").withWatermark("ts", lateness)
    kind = rows.schema[key].dataType.simpleString()
    buckets = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("__bucket")
    found = buckets.transformWithStateInPandas(StatusProcessor(key, kind, idle_ms), f"`{key}` {kind}, {LOG}", "Append", "eventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/log/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            _compact(spark, table, key, batch_id)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # read when the query starts
    try:
        return found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)


def current_status(spark: SparkSession, table: str, key: str) -> DataFrame:
    """(key, to_status, observations, last_seen ...) of every key in the state."""
    upto = last_batch(spark, table)
    if upto is None:
        raise ValueError("the tracker has not run")
    return _latest(spark, table, key, upto)


def change_feed(spark: SparkSession, table: str) -> DataFrame:
    """All status changes, as they were logged."""
    return spark.read.parquet(f"{table}/log").filter("kind = 'change'")
