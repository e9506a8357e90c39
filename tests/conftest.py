import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", partitions=4, memory="4g")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    at = Path("/root/testdata/sf0.001")
    if not at.exists():
        pytest.skip("no test data here")
    return str(at)
