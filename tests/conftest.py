import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    s = local_session("*", 4, "4g", **{"spark.sql.streaming.metricsEnabled": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def run(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    return run
