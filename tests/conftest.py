from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from probelake.session import local_session, sweep

    session = local_session(4, 2, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    sweep(session)
    session.stop()


SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not SF.exists():
        pytest.skip("no test tables here")
    return str(SF)
