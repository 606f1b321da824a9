import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("STRATAVEC_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from stratavec.session import local_session, ship

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


def sf(name: str = "sf0.001") -> str:
    return f"/root/testdata/{name}"
