"""Stream jobs: sticky status tracker, attempt-health windows and re-delivery de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlens.operators import state
from offerlens.session import new_table_dir


def _log_batches(stream: DataFrame, table: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch into its own folder, so a replayed batch replaces itself. Nothing reaches the driver."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def track_status(observations: DataFrame, keys: list[str], status: str, order: list[str], table: str, checkpoint: str) -> StreamingQuery:
    """Sticky status per key as native streaming aggregation; changed keys are appended per batch.

    State holds three small structs per key. Late observations need no guard:
    the aggregate orders by event time, not by arrival.
    """
    agg = observations.groupBy(*keys).agg(*state.sticky_aggregates(status, order))
    return _log_batches(state.sticky_result(agg, keys), table, checkpoint, "update")


def current_status(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Latest logged row of every key."""
    log = spark.read.parquet(table)
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r")).select(*keys, "__r.*")


def change_feed(spark: SparkSession, table: str, keys: list[str], batch_id: int) -> DataFrame:
    """Keys whose status changed in a batch; keys first seen in it are not changes."""
    log = spark.read.parquet(table)
    now = log.filter(F.col("batch_id") == batch_id).select(*keys, F.col("quota_status").alias("to_status"))
    before = (
        log.filter(F.col("batch_id") < batch_id)
        .groupBy(*keys)
        .agg(F.max_by("quota_status", "batch_id").alias("from_status"))
    )
    return now.join(before, keys).filter("to_status <> from_status")


def health_windows(attempts: DataFrame, ts: str, keys: list[str], window: str, lateness: str) -> DataFrame:
    """Coverage counts per key and tumbling window."""
    w: Column = F.window(ts, window)
    return (
        attempts.withWatermark(ts, lateness)
        .groupBy(w.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("expected"), F.count_if("ok").alias("succeeded"))
        .select(F.col("w.start").alias("window_start"), *keys, "expected", "succeeded")
    )


def dedupe_stream(observations: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """Drops re-deliveries of a key that arrive within the allowed lateness."""
    return observations.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is available now and return what it logged."""
    table, checkpoint = new_table_dir(spark, name), new_table_dir(spark, name + "-ckpt")
    _finish(_log_batches(stream, table, checkpoint, mode))
    return spark.read.parquet(table)


def run_tracker(spark: SparkSession, observations: DataFrame, keys: list[str], status: str, order: list[str]) -> DataFrame:
    table, checkpoint = new_table_dir(spark, "tracker"), new_table_dir(spark, "tracker-ckpt")
    _finish(track_status(observations, keys, status, order, table, checkpoint))
    return current_status(spark, table, keys)
