"""State tables as immutable versions. A run's tables become visible together, when its marker is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import staged

MARKER = "_COMMITTED"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, root, jvm = _fs(spark, base)
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), MARKER)):
            out.append(int(name[2:]))
    return sorted(out)


def latest(spark: SparkSession, base: str) -> int | None:
    found = versions(spark, base)
    return found[-1] if found else None


def read_state(spark: SparkSession, base: str, table: str, version: int | None = None) -> DataFrame | None:
    """A table as of a committed version (the latest by default)."""
    version = latest(spark, base) if version is None else version
    return None if version is None else spark.read.parquet(f"{base}/v={version}/{table}")


def commit_run(
    spark: SparkSession, base: str, version: int, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None
) -> bool:
    """Write all tables of a run, then its marker. Readers see all of it or nothing.

    Repeating a committed version is a no-op; an uncommitted leftover of a lost
    driver is overwritten. One writer at a time.
    """
    fs, marker, _ = _fs(spark, f"{base}/v={version}/{MARKER}")
    if fs.exists(marker):
        return False
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{base}/v={version}/{name}")
    fs.create(marker, False).close()
    return True


# ---------------------------------------------------------------- tables in buckets


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_versions(spark: SparkSession, base: str, table: str, version: int | None = None) -> dict[int, int]:
    """Bucket -> the version whose files hold it, as of a committed version; a table has few buckets."""
    manifest = read_state(spark, base, f"{table}.buckets", version)
    return {} if manifest is None else {r["bucket"]: r["version"] for r in manifest.collect()}


def read_buckets(spark: SparkSession, base: str, table: str, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """A bucketed table, or some of its buckets, as of a committed version; None if nothing is stored."""
    held = bucket_versions(spark, base, table, version)
    paths = [f"{base}/v={v}/{table}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def commit_buckets(
    base: str, version: int, table: str, batch: DataFrame, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = 64
) -> set[int]:
    """Commit a version of which only the buckets with keys of ``batch`` are written; returns these.

    ``merge`` makes the new rows of these buckets from the stored ones (None if there are none) and the batch. All other
    buckets are carried by reference: the version's manifest names for each bucket the version that holds it, so versions
    must not be deleted while a manifest names them. ``buckets`` stays the same for the life of a table. Repeating a
    committed version writes nothing.
    """
    spark = batch.sparkSession
    if version in versions(spark, base):
        return set()
    held = bucket_versions(spark, base, table)
    batch = staged(batch.withColumn("bucket", _bucket(key, buckets)), "batch")
    touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}
    new = merge(read_buckets(spark, base, table, None, touched) if held else None, batch.drop("bucket"))
    new = new.withColumn("bucket", _bucket(key, buckets))
    manifest = spark.createDataFrame(sorted((held | dict.fromkeys(touched, version)).items()), "bucket int, version int")
    # Rows of a bucket go to one task and one file.
    commit_run(spark, base, version, {table: new.repartition("bucket"), f"{table}.buckets": manifest.coalesce(1)}, {table: ["bucket"]})
    return touched


def append_fact(df: DataFrame, path: str, run_id: str) -> None:
    """Facts of one run in their own partition folder; writing the run again replaces only that folder."""
    df.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def write_report(df: DataFrame, path: str, run_id: str) -> None:
    """Immutable per-run copy, visible once its marker is written; nothing is ever replaced by a half-written one."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}/run_id={run_id}")
    fs, marker, _ = _fs(spark, f"{path}/run_id={run_id}/{MARKER}")
    fs.create(marker, True).close()


def read_latest_report(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The report of the last run (by its id) whose marker exists, with its ``run_id``."""
    fs, root, jvm = _fs(spark, path)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("run_id=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{MARKER}"))]
    if not done:
        return None
    run_id = max(done)[len("run_id=") :]
    return spark.read.schema(schema).json(f"{path}/run_id={run_id}").withColumn("run_id", F.lit(run_id))


def write_catalogue(df: DataFrame, path: str) -> None:
    """Published offers as JSON lines, insights and highlights nested; many files, no single writer task."""
    df.write.mode("overwrite").json(path)
