import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Collects a frame as sorted plain tuples, doubles rounded."""
    def go(df, *cols):
        def plain(v):
            return round(v, 6) if isinstance(v, float) else v
        d = df.select(*cols) if cols else df
        return sorted((tuple(plain(v) for v in r) for r in d.collect()), key=repr)
    return go
