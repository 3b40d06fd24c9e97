import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridsight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "gridsight-tests")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Collects a result as a sorted list of tuples."""

    def collect(df, *columns):
        return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)

    return collect
