"""Columns of any name beside the documents' own pass through operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerlens.llm import decontaminate, linededup
from offerlens.llm.common import spare

SF = "/root/testdata/sf0.001"
LINE = "a line that is long enough to be compared"
EXTRA = ("_id", "_row", "_gone", "_ID_", "id", "of", "h1", "first", "near", "n", "key", "fp", "u", "root", "component_id", "score", "ids", "hash")


@pytest.fixture
def crowded(documents):
    rows = [(1, f"{LINE}\nother words stand here and there"), (2, f"{LINE}\nmore"), (3, None), (None, ""), (4, "Too short")]
    return documents(rows).drop(*EXTRA).withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)})


def test_spare_names(crowded):
    assert spare(crowded, "_id", "_row", "plain", "plain") == ["_id__", "_row_", "plain", "plain_"]


def test_line_dedup_and_decontamination(spark, crowded):
    out = linededup.dedup_lines(crowded)
    assert out.columns == [*crowded.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["_gone"]) for r in out.collect()}[2] == ("more", 2)
    bench = spark.createDataFrame([(1, "Too short")], "item_id bigint, text string")
    kept = decontaminate.remove_contaminated(crowded, bench)
    assert kept.columns == crowded.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, crowded, name, stage):
    out = stage(spark, crowded, SF)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) or name == corpus_pipeline.STAGES[-1][0]
    assert out.count() >= 2
