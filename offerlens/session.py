"""Session set-up shared by the bench, the tests and the query catalogue."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("offerlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what changes results (time zone) and what bounds Python workers (batch size).

    One captured page may be 8 MB, so the default of 10 000 rows per Arrow
    batch would not fit a worker.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``. Only a session whose executors are the
    driver itself (tests) gets a temporary folder when it is unset; on a cluster
    that is an error, because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = _local_dir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="offerlens-"))
    return _LOCAL[0]


def new_table_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a loop's plan does not grow and lost executors do not replay it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    For results of per-row text work that several joins use: the work runs once,
    survives lost executors, and null checks that joins infer on derived keys
    test stored columns instead of repeating the work below the projection.
    """
    path = new_table_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal narrow rows over all cores, by ``keys`` if any, for costly work behind it.

    A file of one row group is read by one task, and a shuffle of narrow rows is coalesced by its size; what later
    grows out of a row counts in neither.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
