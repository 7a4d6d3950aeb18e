import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from starledger.session import get_session
    s = get_session("local[*]", 8, app_name="starledger-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples for the given columns (all columns when none)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
