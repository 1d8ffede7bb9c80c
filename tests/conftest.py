import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from arborlake.session import session

    s = session("tests", cores=8, partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
