import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidebars.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain dicts in a fixed order."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
