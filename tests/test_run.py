"""The composed run and the bucketed history."""

from pyspark.sql import functions as F

from offerlens.operators import keys, run, state
from offerlens.sources import versions

CAPTURES = "capture_id string, url string, body string, provider_id string, provider_name string, external_id string, fetched_at string, seq bigint"
ATTEMPTS = "run_id string, provider_id string, source_name string, role string, url string, ok boolean, error string, discovered_count int, coverage_issue string, seq bigint"
SOURCES = "provider_id string, seq bigint, name string, role string, coverage_scope string, url string, display_url string, adapter string"


def page(title, *lines):
    return f"<html><head><title>{title}</title></head><body>{''.join(f'<p>{x}</p>' for x in lines)}</body></html>"


def inputs(spark, bodies):
    caps = [(f"c{k}", f"https://e.example.com/{k}", b, "p", "P", str(k), "d2", k) for k, b in enumerate(bodies)]
    attempts = spark.createDataFrame([("r", "p", "s0", "activity_listing", "https://e", True, None, 3, None, 1)], ATTEMPTS)
    providers = spark.createDataFrame([("p", "P", "public")], "provider_id string, name string, public_status_scope string")
    sources = spark.createDataFrame([("p", 1, "s0", "activity_listing", "complete", "https://e", None, "")], SOURCES)
    return spark.createDataFrame(caps, CAPTURES), attempts, providers, sources


def history(spark, rows):
    schema = "provider_id string, provider_name string, external_id string, title string, url string, source_url string, start_date date, end_date date, quota_status string, quota_evidence_complete boolean, review_required boolean, fetched_at string, first_seen_at string, last_seen_at string, seq bigint"
    return keys.with_activity_id(spark.createDataFrame(rows, schema)).select(*run.HISTORY)


def test_run_on_empty_and_on_known_history(spark):
    bodies = [page("Summer offer", "活動期間：2026/05/01～2026/08/31", "本活動回饋已全數額滿。"), page("Winter offer", "活動期間：2025/01/01～2025/02/01"), "x" * 9_000_000]
    first = run.monitor(*inputs(spark, bodies), history(spark, []), "2026-06-01", mode="status")
    assert first.mode == "full"  # nothing was known
    assert [(r.title, r.section) for r in first.report.collect()] == [("Summer offer", "sold_out")]
    assert (first.changes.count(), first.history.count(), first.quarantined.count(), first.parsed.count()) == (0, 2, 1, 2)
    assert first.coverage.first().verdict == "success"

    bodies = [page("Summer offer", "活動期間：2026/05/01～2026/08/31"), bodies[1]]
    second = run.monitor(*inputs(spark, bodies), first.history, "2026-06-01", mode="status", documents=first.documents)
    assert second.mode == "status"
    assert {r.external_id for r in second.parsed.collect()} == {"0"}  # the other page is as it was
    assert {r.external_id: (r.quota_status, r.first_seen_at) for r in second.history.collect()} == {"0": ("sold_out", "d2"), "1": ("not_marked_full", "d2")}
    assert second.changes.count() == 0 and second.documents.count() == 2


def test_run_without_captures(spark):
    caps, attempts, providers, sources = inputs(spark, [page("A", "b")])
    old = [("p", "P", "7", "Old offer", "https://e.example.com/7", "https://e.example.com/7", None, None, "sold_out", True, False, "d1", "d1", "d1", 1)]
    out = run.monitor(caps.limit(0), attempts, providers, sources, history(spark, old), "2026-06-01", documents=None)
    assert out.history.count() == 1 and out.changes.count() == 0 and out.report.first().section == "review_required"


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    base = str(tmp_path / "state")
    row = lambda k, seen: (f"k{k}", "x", seen)
    cols = "activity_id string, quota_status string, fetched_at string"
    first = spark.createDataFrame([row(k, "d1") for k in range(500)], cols)
    merge = lambda old, rows: rows if old is None else state.upsert(old, rows)
    every = versions.commit_buckets(base, 1, "t", first, "activity_id", merge, 16)
    assert every == set(range(16))
    batch = spark.createDataFrame([row(3, "d2"), row(999, "d2")], cols)
    touched = versions.commit_buckets(base, 2, "t", batch, "activity_id", merge, 16)
    assert touched == {r.b for r in batch.select(versions._bucket("activity_id", 16).alias("b")).collect()}
    held = versions.bucket_versions(spark, base, "t")
    assert {b for b, v in held.items() if v == 2} == touched and set(held) == every
    assert versions.commit_buckets(base, 2, "t", batch, "activity_id", merge, 16) == set()
    now = {r.activity_id: r.fetched_at for r in versions.read_buckets(spark, base, "t").collect()}
    assert now == {f"k{k}": "d1" for k in range(500)} | {"k3": "d2", "k999": "d2"}
    before = versions.read_buckets(spark, base, "t", 1)
    assert before.count() == 500 and before.filter(F.col("fetched_at") == "d2").count() == 0
    assert versions.read_buckets(spark, str(tmp_path / "none"), "t") is None
