import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from timbre.session import local_session

    session = local_session("timbre-tests", cpus=4, partitions=4)
    yield session
    session.stop()
