import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratafold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def large_paths(spark):
    """Send every size-checked operator down its large-data path."""
    names = ["windowRows", "inlineEdges", "broadcastRows"]
    for n in names:
        spark.conf.set(f"spark.stratafold.{n}", "0")
    yield
    for n in names:
        spark.conf.unset(f"spark.stratafold.{n}")
