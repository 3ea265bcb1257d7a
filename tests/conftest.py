import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tapeloom.session import local_session, utc


@pytest.fixture(scope="session")
def spark():
    session = utc(local_session(4, "6g", "tapeloom-tests"))
    yield session
    session.stop()
