import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from revtrace.session import local_session, steady_unions
    s = local_session("4")
    steady_unions(s)
    return s
