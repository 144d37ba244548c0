import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vigil.functions.session import local_session  # noqa: E402
from vigil.functions.storage import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "vigil-tests")
    ship_package(session)  # workers import the package whatever folder the tests start in
    return session
