import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newslens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan(spark):
    """The executed plan of a DataFrame as text, without reuse of earlier results."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def rows():
    """Sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(v is not None, str(v)) for v in t])
