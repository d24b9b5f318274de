import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def table(spark):
    """A table of strings from rows and column names."""

    def make(columns, rows):
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns.split()))

    return make


@pytest.fixture(params=[None, 0], ids=["broadcast", "shuffled"])
def max_bytes(request):
    """Both forms of a lookup."""
    from meibo.operators.lookup import BROADCAST_MAX_BYTES

    return BROADCAST_MAX_BYTES if request.param is None else 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
