import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from noteloom import session

    s = session.build("tests", cores=4, partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
