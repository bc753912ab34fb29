import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewarden.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
