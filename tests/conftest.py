import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import get_spark

    session = get_spark("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
