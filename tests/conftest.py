import pytest

from tickforge.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
