import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import local_session

    session = local_session(4, "4g", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
