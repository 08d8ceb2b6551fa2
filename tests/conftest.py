import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from loomrank.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = prepare(local_session(8, "6g", 4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
