from __future__ import annotations

import pytest

from slabmill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "8", 4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a frame as a list of plain dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
