import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from seriesmill.schema import SERIES  # noqa: E402
from seriesmill.session import build_session  # noqa: E402

START = dt.date(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of daily series from ``{key: values}`` (None skips the day)."""

    def build(series: dict, order=None):
        rows = [
            (key, START + dt.timedelta(days=at), None if value is None else float(value))
            for key, values in series.items() for at, value in enumerate(values) if value is not None
        ]
        return spark.createDataFrame(order(rows) if order else rows, SERIES)

    return build
