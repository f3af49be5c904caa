import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from siloml.functions.shipping import ship
    from workload.check import session

    s = session("8")
    ship(s)
    yield s
    s.stop()
