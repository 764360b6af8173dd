import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reviewlake.session import get_session
    s = get_session("local[4]", 4, app_name="reviewlake-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` (or all) as a list of tuples, in the frame's order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
