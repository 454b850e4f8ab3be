import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=8, memory="6g", folder=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
