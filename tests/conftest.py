import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        4,
        **{
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as dicts, ordered by the given columns."""

    def collect(df, *order):
        return [row.asDict() for row in (df.orderBy(*order) if order else df).collect()]

    return collect


@pytest.fixture(scope="session")
def text_frame(spark):
    """A feed as it comes from CSV: every column a string."""

    def build(records):
        names = list(dict.fromkeys(name for record in records for name in record))
        data = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records]
        return spark.createDataFrame(data, ", ".join(f"`{name}` string" for name in names))

    return build
