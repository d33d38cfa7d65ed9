import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))

from ledgerloom import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(build_session("local[8]", 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
