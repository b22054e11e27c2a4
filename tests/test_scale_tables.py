"""Ranks, the search index, stored verdicts and registry rules as tables."""

import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import quota
from offerlens.operators import extract, ranking, search, state


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_ranks_equal_a_sort(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([None, *range(5)]), rng.choice("abc"), k) for k in range(rows)]
    df = spark.createDataFrame(data, "a int, part string, k int")
    got = ranking.with_rank(df, [F.col("a").desc_nulls_last(), F.col("part"), F.col("k")])
    want = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))
    assert got.columns == ["a", "part", "k", "rank"]
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == want
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, rows + 1))


def test_equal_rows_get_different_ranks(spark):
    got = ranking.with_rank(spark.createDataFrame([(1,)] * 50, "a int"), [F.col("a")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 51))
    with pytest.raises(ValueError):
        ranking.with_rank(got, [F.col("a")])


def test_indexed_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc 夜市", k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, search_text string").cache()
    path = str(tmp_path / "postings")
    search.write_postings(df, path, "id")
    postings = spark.read.parquet(path).cache()
    asked = ["", "a", "市", "ab", "xyz", "ABC"]
    for size in range(1, 21):
        text = rng.choice([t for t in texts if t and len(t) >= size])
        at = rng.randrange(len(text) - size + 1)
        asked.append(text[at : at + size])
    for query in asked:
        got = {r["id"] for r in search.search_indexed(df, postings, "id", query).collect()}
        assert got == {k for k, t in enumerate(texts) if t is not None and query.lower() in t}, query


def test_only_new_excerpts_are_judged(spark):
    rows = [("a", "本活動回饋已全數額滿"), ("a", "若額滿則停止回饋"), ("b", "若額滿則停止回饋"), ("c", None)]
    first = spark.createDataFrame(rows, "activity_id string, excerpt string")
    stored = state.judge_excerpts(first)
    assert stored.count() == 2 and stored.filter("is_new").count() == 2
    more = first.unionByName(spark.createDataFrame([("d", "回饋已額滿")], "activity_id string, excerpt string"))
    again = state.judge_excerpts(more, stored.drop("is_new"))
    assert (again.count(), again.filter("is_new").count()) == (3, 1)
    flags = {r["activity_id"]: r["conditional_only"] for r in state.conditional_only(more, verdicts=again).collect()}
    assert flags == {r["activity_id"]: r["conditional_only"] for r in state.conditional_only(more).collect()}
    assert flags == {"a": False, "b": True, "c": True, "d": False}
    # After a change of rules nothing that is stored counts.
    other = quota.RulePack({k: v for k, v in list(quota.ZH_PACK.rules.items())[1:]})
    assert state.pack_hash(other) != state.pack_hash()
    assert state.judge_excerpts(more, again.drop("is_new"), other).filter("is_new").count() == 3


def test_link_rules_do_not_grow_the_plan(spark):
    docs = spark.createDataFrame([(f"s{k}", "https://e.example.com/list", [(f"https://e.example.com/event/{j}", f"n{j}") for j in range(4)]) for k in range(20)], "source_id string, final_url string, links array<struct<url:string,anchor:string>>")
    sizes, found = [], []
    for n in (10, 10_000):
        rules = {f"s{k}": ["event/[0-2]", "n3"] if k % 2 else ["event/1"] for k in range(n)}
        out = extract.discover_links(docs, rules, {"s1": 2})
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        found.append({(r["source_id"], r["link_url"][-1]) for r in out.collect()})
    assert abs(sizes[0] - sizes[1]) < 200
    assert {x for s, x in found[0] if s == "s1"} == {"0", "1"} and {x for s, x in found[0] if s == "s3"} == {"0", "1", "2", "3"} and {x for s, x in found[0] if s == "s2"} == {"1"}
    assert {s for s, _ in found[0]} == {f"s{k}" for k in range(10)} and {s for s, _ in found[1]} == {f"s{k}" for k in range(20)}
    assert extract.discover_links(docs, {"s1": []}).count() == 0


def test_pages_and_evidence_are_dealt_over_all_cores(spark, tmp_path):
    """One row group of orders or customers is one task to read; pages and excerpts made of them lie in many."""
    from offerlens.plans import base, q_state

    spark.range(400).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    tables, cores = base.Tables(spark, str(tmp_path)), spark.sparkContext.defaultParallelism
    pages = base.order_pages(tables, base.text("<", F.col("o_orderkey"), ">"))
    assert pages.rdd.getNumPartitions() >= cores
    assert {(r["page_id"], r["items"]) for r in pages.collect()} == {(p, "".join(f"<{p * 20 + k}>" for k in range(20))) for p in range(20)}
    merged = q_state.evidence_identity(tables)
    assert "Repartition" in merged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((int(r["activity_id"]), r["variant"]) for r in merged.collect()) == [(k, v) for k in range(40) for v in "ab"]
