import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from tidegauge.session import get_spark

    s = get_spark("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)


@pytest.fixture(scope="session")
def sf01():
    d = DATA / "sf0.01"
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)
