import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from surveyframe.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_DIR


def rows(df, *cols):
    """Rows as a set of tuples of the named columns."""
    return {tuple(r[c] for c in cols) for r in df.collect()}
