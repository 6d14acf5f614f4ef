import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(os.path.join(SF, f"{name}.parquet"))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) with the other columns of the table and some whose names clash with results."""

    def make(rows, lang=None):
        full = [(i, t, (lang or {}).get(i), f"src{k % 3}", len(t or ""), "x", 7) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, shard int")

    return make
