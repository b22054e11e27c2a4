import random
import json

import pytest
from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.operators import coverage, frontier, publish, state
from offerlens.sources import captures, registry, versions

CONFIG = {
    "schema_version": 1,
    "providers": [
        {
            "id": "a",
            "name": "Alpha",
            "official_domains": ["a.example.com"],
            "public_status_scope": "public",
            "sources": [
                {"name": "list", "role": "activity_listing", "url": "https://a.example.com/l", "max_links": 3, "link_patterns": ["x"]},
                {"name": "news", "role": "announcement_listing", "url": "https://a.example.com/n"},
            ],
            "seeds": [{"name": "seed", "url": "https://a.example.com/s"}],
        },
        {"id": "b", "name": "Beta", "official_domains": [], "sources": [], "seeds": []},
    ],
}


def test_registry_tables(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps(CONFIG))
    reg = registry.read_registry(spark, str(path))
    assert [r.provider_id for r in reg.providers.orderBy("seq").collect()] == ["a", "b"]
    assert [(r.name, r.max_links) for r in reg.sources.orderBy("seq").collect()] == [("list", 3), ("news", None)]
    assert reg.domains.count() == reg.seeds.count() == 1
    path.write_text(json.dumps({**CONFIG, "schema_version": 2}))
    with pytest.raises(ValueError):
        registry.read_registry(spark, str(path))


def test_supplement_scan(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"generated_at": "t", "highlights": [{"kind": "k", "url": "u"}], "supplemental_activities": [{"title": "x"}, {"title": "y"}]}))
    highlights, offers = registry.read_supplement(spark, str(path))
    assert highlights.first().kind == "k"
    assert [(r.seq, r.title) for r in offers.orderBy("seq").collect()] == [(0, "x"), (1, "y")]


def test_capture_gate(spark, tmp_path):
    rows = [("u1", "u1", 200, bytearray(b"abc"), "abc", "text/html", None), ("u2", "u2", 200, bytearray(b"x" * 50), "x", "", None)]
    spark.createDataFrame(rows, schemas.CAPTURES).write.parquet(str(tmp_path / "c"))
    good, bad = captures.read_captures(spark, str(tmp_path / "c"), 10)
    assert [r.final_url for r in good.collect()] == ["u1"] and [r.final_url for r in bad.collect()] == ["u2"]
    assert good.first().content_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_commit_is_all_or_nothing_and_idempotent(spark, tmp_path):
    base = str(tmp_path / "state")
    one = spark.createDataFrame([("k", "sold_out")], "activity_id string, quota_status string")
    assert versions.read_state(spark, base, "activities") is None
    assert versions.commit_run(spark, base, 1, {"activities": one, "runs": one})
    two = one.withColumn("quota_status", F.lit("other"))
    assert not versions.commit_run(spark, base, 1, {"activities": two})
    # A version without its marker is invisible.
    two.write.parquet(f"{base}/v=2/activities")
    assert versions.latest(spark, base) == 1
    assert versions.read_state(spark, base, "activities").first().quota_status == "sold_out"
    assert versions.commit_run(spark, base, 2, {"activities": two})
    assert versions.versions(spark, base) == [1, 2]
    assert versions.read_state(spark, base, "activities").first().quota_status == "other"


def test_facts_and_reports_replace_their_own_run(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1)], "run_id string, n int")
    for _ in range(2):
        versions.append_fact(df, str(tmp_path / "f"), "r1")
    versions.append_fact(df, str(tmp_path / "f"), "r2")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    versions.write_report(df, str(tmp_path / "rep"), "r1")
    versions.write_report(df.union(df), str(tmp_path / "rep"), "r2")
    (tmp_path / "rep" / "run_id=r3").mkdir()  # not committed
    assert [r.run_id for r in versions.read_latest_report(spark, str(tmp_path / "rep"), "n int").collect()] == ["r2", "r2"]
    assert versions.read_latest_report(spark, str(tmp_path / "none"), "n int") is None
    versions.write_catalogue(df, str(tmp_path / "cat"))
    assert spark.read.json(str(tmp_path / "cat")).first().n == 1


HIST = "activity_id string, quota_status string, quota_evidence_complete boolean"


def _merge(spark, before, now, evidence=None, exempt=None):
    h = spark.createDataFrame([("k", before, True)], HIST)
    b = spark.createDataFrame([("k", now, True), ("new", now, True)], HIST)
    ev = spark.createDataFrame([("k", e) for e in evidence], "activity_id string, excerpt string") if evidence else None
    return {r.activity_id: r for r in state.merge_sticky(b, h, ev, exempt).collect()}


@pytest.mark.parametrize(
    "before,now,want",
    [
        ("sold_out", "unknown_source_failure", "sold_out"),
        ("partial_sold_out", "not_marked_full", "partial_sold_out"),
        ("sold_out", "confirmed_available", "confirmed_available"),
        ("unknown_app_only", "not_marked_full", "unknown_app_only"),
        ("unknown_app_only", "unknown_source_failure", "unknown_source_failure"),
        ("not_marked_full", "sold_out", "sold_out"),
    ],
)
def test_sticky_transitions(spark, before, now, want):
    got = _merge(spark, before, now)
    assert got["k"].quota_status == want
    assert got["new"].quota_status == now and got["new"].previous_status is None


def test_sticky_exceptions(spark):
    kept = _merge(spark, "sold_out", "not_marked_full", ["本活動回饋已全數額滿", "若額滿則停止回饋"])["k"]
    assert (kept.quota_status, kept.carry_evidence) == ("sold_out", True)
    retracted = _merge(spark, "sold_out", "not_marked_full", ["若額滿則停止回饋"])["k"]
    assert (retracted.quota_status, retracted.carry_evidence) == ("not_marked_full", False)
    freed = _merge(spark, "unknown_app_only", "not_marked_full", exempt=F.lit(True))["k"]
    assert (freed.quota_status, freed.carry_evidence) == ("not_marked_full", False)


def test_evidence_order_is_reversed_in_front(spark):
    cols = "activity_id string, ord bigint, source_url string, excerpt string"
    cur = spark.createDataFrame([("k", 0, "u", "c0")], cols)
    prev = spark.createDataFrame([("k", 0, "u", "p0"), ("k", 1, "u", "p1"), ("k", 2, "u", "p0"), ("k", 3, "u", "c0"), ("x", 0, "u", "q")], cols)
    carry = spark.createDataFrame([("k",)], "activity_id string")
    out = state.merge_evidence(cur, prev, carry)
    assert [r.excerpt for r in out.orderBy("ord").collect()] == ["p1", "p0", "c0"]
    again = state.merge_evidence(cur, out, carry)
    assert {r.excerpt for r in again.collect()} == {"p0", "p1", "c0"}


def test_upsert_is_idempotent(spark):
    h = spark.createDataFrame([("a", "old", "e1", "t0", "t0", "t0"), ("b", "old", None, "t0", "t0", "t0")], "activity_id string, title string, external_id string, fetched_at string, first_seen_at string, last_seen_at string")
    b = spark.createDataFrame([("a", "new", None, "t1"), ("c", "new", "e3", "t1")], "activity_id string, title string, external_id string, fetched_at string")
    once = state.upsert(h, b)
    rows = {r.activity_id: r for r in once.collect()}
    assert (rows["a"].title, rows["a"].external_id, rows["a"].first_seen_at, rows["a"].last_seen_at) == ("new", "e1", "t0", "t1")
    assert rows["b"].last_seen_at == "t0" and rows["c"].first_seen_at == "t1"
    assert sorted(map(tuple, state.upsert(once, b).collect())) == sorted(map(tuple, once.collect()))


def test_frontier_golden(spark):
    src = spark.createDataFrame([("p", 1, 7, 3, 2, 220)], "provider_id string, minimum_event_id bigint, bootstrap_end_id bigint, rescan_window bigint, frontier_buffer bigint, maximum_probe_ids bigint")
    st = spark.createDataFrame([("p", 5, 0, "t")], schemas.FRONTIER)
    ranges = frontier.plan_ranges(frontier.load_frontier(st), src)
    assert tuple(ranges.select("scan_start", "scan_end").first()) == (3, 7)

    def outcomes(rows):
        return spark.createDataFrame([("p", i, o, s) for s, (i, o) in enumerate(rows)], "provider_id string, event_id bigint, outcome string, seq bigint")

    good = outcomes([(3, "valid"), (4, "valid"), (5, "valid"), (6, "not_found"), (7, "valid")])
    assert tuple(frontier.advance_frontier(ranges, good).first()) == ("p", 7, 7)
    bad = outcomes([(3, "valid"), (4, "failure"), (5, "valid"), (6, "not_found"), (7, "valid")])
    assert frontier.advance_frontier(ranges, bad).count() == 0
    missing = outcomes([(3, "valid")])
    row = frontier.scan_summary(ranges, missing).first()
    assert (row.failure_count, row.complete, row.highest_valid_event_id) == (4, False, 5)


def test_attempts_are_conserved(spark):
    """Registered matches plus extended checks are all attempts of known providers."""
    from offerlens.plans.base import Tables, attempts, registry as reg

    t = Tables(spark, "/root/testdata/sf0.001")
    providers, _, sources = reg(t)
    a = attempts(t)
    m = coverage.match_sources(sources, a)
    known = a.join(providers, "provider_id", "left_semi").count()
    assert m.count() + coverage.extended_checks(a, m, providers).count() == known
    # Shuffled input, same matches.
    again = coverage.match_sources(sources.orderBy(F.rand(1)), a.orderBy(F.rand(2)))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))


def test_match_forms(spark):
    """Named sources by name, unnamed by URL, bare ones take what is left."""
    s = spark.createDataFrame([("p", "r", 1, "n", ""), ("p", "r", 2, "", "u2"), ("p", "r", 3, "", "")], "provider_id string, role string, seq bigint, name string, url string")
    a = spark.createDataFrame([("run", "p", "r", "x", "u9", True, 1), ("run", "p", "r", "n", "u1", True, 2), ("run", "p", "r", "y", "u2", False, 3)], "run_id string, provider_id string, role string, source_name string, url string, ok boolean, seq bigint")
    got = {(r.source_seq, r.attempt_seq) for r in coverage.match_sources(s, a).collect()}
    assert got == {(1, 2), (2, 3), (3, 1)}


def greedy(sources, attempts):
    """The walk: sources in registry order, each with its first attempt that is left, run by run."""
    out = set()
    for run in {a[0] for a in attempts}:
        taken = set()
        for provider, role, seq, name, url in sorted(sources, key=lambda s: s[2]):
            for r, p, ro, source_name, u, ok, at in sorted(attempts, key=lambda a: a[6]):
                if r == run and (p, ro) == (provider, role) and at not in taken and (not name or source_name == name) and (name or not url or u == url):
                    taken.add(at)
                    out.add((run, at, seq, p, ro, ok))
                    break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixed_forms_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    sources = [(rng.choice("pq"), rng.choice("rs"), k, rng.choice(("", "", "n1", "n2")), rng.choice(("", "u1", "u2"))) for k in range(24)]
    attempts = [(f"run{rng.randrange(3)}", rng.choice("pqx"), rng.choice("rst"), rng.choice(("n1", "n2", "n3")), rng.choice(("u1", "u2", "u3")), rng.random() < 0.5, k) for k in range(150)]
    s = spark.createDataFrame(sources, "provider_id string, role string, seq bigint, name string, url string")
    a = spark.createDataFrame(attempts, "run_id string, provider_id string, role string, source_name string, url string, ok boolean, seq bigint")
    assert {tuple(r) for r in coverage.match_sources(s, a).collect()} == greedy(sources, attempts)
    assert coverage.match_sources(s.limit(0), a).count() == 0


def test_health_by_mode_and_scan(spark):
    """Scan sources go by their summary, a status run counts what it visits, per provider and per run alike."""
    s = spark.createDataFrame(
        [("p", "activity_listing", 1, "a", "", ""), ("p", "activity_probe", 2, "b", "", "fullpay_id_scan"), ("q", "announcement_listing", 3, "c", "", ""), ("q", "activity_listing", 4, "d", "", "famipay_listing")],
        "provider_id string, role string, seq bigint, name string, url string, adapter string",
    )
    a = spark.createDataFrame(
        [("r", "p", "activity_listing", "a", "", True, 1), ("r", "p", "activity_probe", "b", "", False, 2), ("r", "q", "announcement_listing", "c", "", False, 3), ("r", "q", "activity_listing", "d", "", True, 4)],
        "run_id string, provider_id string, role string, source_name string, url string, ok boolean, seq bigint",
    )
    providers, runs = s.select("provider_id").distinct(), a.select("run_id").distinct()

    def health(mode, scans, **kw):
        out = coverage.request_health(s, a, providers, runs, mode, scans, **kw)
        return {(r.asDict().get("provider_id"), r.level, r.check_group): (r.expected, r.succeeded) for r in out.collect()}

    scans = spark.createDataFrame([("p", True), ("q", True)], "provider_id string, complete boolean")
    assert health("full", scans)[None, "registered", "all"] == (4, 3)
    assert health("full", scans)[None, "extended", "numeric_probe"] == (1, 0)
    assert health("full", scans.filter("provider_id = 'q'"))[None, "registered", "all"] == (4, 2)
    assert health("full", None)[None, "registered", "all"] == (4, 2)
    assert health("full", scans.withColumn("run_id", F.lit("other")))[None, "registered", "all"] == (4, 2)
    assert health("status", scans)[None, "registered", "all"] == (2, 1)
    by = health("full", scans, by_provider=True)
    assert (by["p", "registered", "all"], by["q", "registered", "all"]) == ((2, 2), (2, 1))


def test_calendar_switches_to_count(spark):
    rows = [(f"p{i}", "P", f"T{i:02d}", f"https://e/{i}", None, "2026-08-01", "2026-08-31" if i < 26 else "2026-09-01", "active", "not_marked_full", i) for i in range(28)]
    df = spark.createDataFrame(rows, "provider_id string, provider_name string, title string, url string, external_id string, s string, e string, lifecycle string, quota_status string, seq int").select(
        "*", F.col("url").alias("source_url"), F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date")
    )
    out = {str(r.day): r for r in publish.calendar_events(publish.calendar_members(df, "2026-08-16"), "https://x/").collect()}
    assert out["2026-08-31"].description.startswith("共 26 檔優惠今日截止") and out["2026-08-31"].offers == 26
    assert out["2026-09-01"].description.split("\n")[1:3] == ["1. P｜T26", "https://e/26"]


def test_vocabulary_check(spark):
    df = spark.createDataFrame([("active",), (None,)], "x string")
    schemas.require_members(df, "x", schemas.LIFECYCLES)
    with pytest.raises(ValueError):
        schemas.require_members(spark.createDataFrame([("odd",)], "x string"), "x", schemas.LIFECYCLES)
