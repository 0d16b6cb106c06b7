import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from cindermap.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted so that missing values come first."""
    got = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(got, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
