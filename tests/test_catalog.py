"""Every registered query against its SQL on the smallest tables."""

import re

import pytest
from oracle import compare, connect

from offerlens.plans.catalog import load_queries

QUERIES = load_queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    ok, message = compare(spark, con, name, QUERIES[name], sf)
    assert ok, message


def test_every_query_has_sql():
    assert {n for n, q in QUERIES.items() if not q.sql} == set()


# Pages and payloads need a parser; the title ratio runs on pruned pairs.
PYTHON = {
    "page_extract", "page_text", "page_links", "link_indegree", "listing_links", "event_links", "json_documents", "chunk_recovery", "next_round",
    "detail_reconcile", "announcement_evidence", "link_titles_similar", "link_document_titles", "apply_title_matches",
    "title_evidence_links",
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_product_and_python_only_where_stated(spark, sf, name):
    plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert name in PYTHON or not re.search("InPandas|InArrow|EvalPython", plan)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.queries()) >= set(e.oracle_sql())
