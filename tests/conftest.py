import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from lumbre.session import local_session

    session = local_session("8", "lumbre-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
