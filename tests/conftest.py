import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import get_spark, ship

    s = get_spark("tests", cores=8)
    ship(s)
    yield s
    s.stop()
