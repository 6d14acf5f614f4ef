import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palisade import session

    s = session.build(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Rows from tuples: rows("a string, b long", [...])."""

    def make(schema, data):
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def plan():
    """Final physical plan text of a DataFrame."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
