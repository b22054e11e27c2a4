import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs, with columns that clash with names the operators use."""

    def make(rows):
        extra = "score double, row string, hash string, n int, v string, key string, u bigint"
        data = [(i, t, "en", "s", len(t) if t else 0, 0.5, "r", "h", 1, "v", "k", 7) for i, t in rows]
        return spark.createDataFrame(data, f"{DOCS}, {extra}")

    return make


@pytest.fixture
def rng():
    return random.Random(5)
