import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from buildgraph.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(map(repr, r)))

    return collect
