"""The keyed status tracker: late rows, expiry, restarts, and a log that stays small to read."""

import datetime as dt
import os

from pyspark.sql import functions as F

from offerlens.operators import state
from offerlens.streaming import jobs, keyed

SCHEMA = "k string, ts timestamp, seq bigint, quota_status string"
DAY = 86_400_000


def add(spark, folder, rows):
    data = [(k, dt.datetime.fromisoformat(t), s, q) for k, t, s, q in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, table, checkpoint, every=3, files=None):
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    jobs._finish(keyed.track(stream, "k", "1 day", 10 * DAY, table, checkpoint, every))


BATCHES = [
    [("a", "2024-01-02", 1, "not_marked_full"), ("b", "2024-01-02", 2, "unknown_app_only"), ("c", "2024-01-02", 3, "sold_out")],
    [("a", "2024-01-03", 4, "sold_out"), ("b", "2024-01-01T12:00", 5, "confirmed_available"), ("c", "2024-01-03", 6, "not_marked_full")],
    [("a", "2024-01-04", 7, "not_marked_full"), ("d", "2024-01-20", 8, "sold_out"), ("b", "2023-12-01", 9, "sold_out")],
]
LOG = [
    ("a", "change", "not_marked_full", "sold_out", 2), ("a", "expired", "sold_out", None, 3), ("a", "new", None, "not_marked_full", 1), ("a", "same", "sold_out", "sold_out", 3),
    ("b", "expired", "unknown_app_only", None, 2), ("b", "new", None, "unknown_app_only", 1), ("b", "same", "unknown_app_only", "unknown_app_only", 2),
    ("c", "expired", "sold_out", None, 2), ("c", "new", None, "sold_out", 1), ("c", "same", "sold_out", "sold_out", 2), ("d", "new", None, "sold_out", 1),
]


def logged(spark, table):
    rows = spark.read.parquet(f"{table}/log").select("k", "kind", "from_status", "to_status", "observations").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_restarts_late_rows_and_expiry(spark, tmp_path):
    """Late rows go, idle keys expire, and stopping after each batch or not makes no difference."""
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    for rows in BATCHES:
        add(spark, src, rows)
        run(spark, src, table, ckpt)
    run(spark, src, table, ckpt)  # nothing new
    assert logged(spark, table) == sorted(LOG, key=repr)
    whole = str(tmp_path / "whole")
    run(spark, src, whole, str(tmp_path / "ckpt2"), files=1)
    assert logged(spark, whole) == logged(spark, table)
    assert [(r.k, r.to_status) for r in keyed.current_status(spark, table, "k").collect()] == [("d", "sold_out")]
    assert [(r.k, r.from_status, r.to_status) for r in keyed.change_feed(spark, table).collect()] == [("a", "not_marked_full", "sold_out")]


def test_reading_takes_one_version_and_few_batches(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    read = []
    for n in range(6):
        add(spark, src, [("a", f"2024-01-{n + 2:02}", n, "sold_out" if n else "not_marked_full"), (f"k{n}", f"2024-01-{n + 2:02}", 100 + n, "unknown_app_only")])
        run(spark, src, table, ckpt, every=4)
        now = keyed.current_status(spark, table, "k")
        read.append(len({os.path.dirname(f) for f in now.inputFiles()}))
        assert now.count() == n + 2
    assert max(read[2:]) <= 4
    batch = state.sticky_status(spark.read.parquet(src), ["k"], "quota_status", ["ts", "seq"]).select("k", F.col("quota_status").alias("to_status"))
    assert now.select("k", "to_status").exceptAll(batch).count() == 0


def test_keys_share_state_calls_and_timers(spark, tmp_path):
    """Many keys are held in few buckets: state is called once per bucket and batch, not once per key, and results stay per key."""
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    many = 3 * keyed.BUCKETS
    add(spark, src, [(f"k{n}", f"2024-01-0{n % 3 + 1}", n, "sold_out" if n % 2 else "not_marked_full") for n in range(many)] + [(None, "2024-01-02", many, "sold_out")])
    run(spark, src, table, ckpt, every=100)
    add(spark, src, [("late", "2024-01-13T12:00", many + 1, "sold_out"), ("k1", "2024-01-13", many + 2, "not_marked_full")])
    run(spark, src, table, ckpt, every=100)
    log = spark.read.parquet(f"{table}/log")
    # The watermark is 01-12T12:00: keys seen on 01-01 and 01-02 have expired, those of 01-03 and the newer ones live.
    gone = {r.k for r in log.filter("kind = 'expired'").collect()}
    assert gone == {None} | {f"k{n}" for n in range(many) if n % 3 < 2 and n != 1}
    assert {r.k for r in keyed.current_status(spark, table, "k").collect()} == {"late", "k1"} | {f"k{n}" for n in range(many) if n % 3 == 2}
    stores = log.filter("kind = 'same'").collect()
    assert [(r.k, r.from_status, r.to_status, r.observations) for r in stores] == [("k1", "sold_out", "sold_out", 2)]


def test_a_key_of_null_statuses_expires(spark, tmp_path):
    """An observation without a status is not told apart from none by later batches, yet its key is forgotten like any other."""
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    for rows in ([("n", "2024-01-02", 1, None)], [("d", "2024-01-20", 2, "sold_out")]):
        add(spark, src, rows)
        run(spark, src, table, ckpt)
    log = spark.read.parquet(f"{table}/log").filter("k = 'n'").collect()
    assert {(r.kind, r.last_seen) for r in log} == {("new", dt.datetime(2024, 1, 2)), ("expired", dt.datetime(2024, 1, 2))}
