import os

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session(os.environ.get("TEST_CPUS", "8"))
    # Literal graphs are tiny; correctness must not depend on the number of partitions.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def out(tmp_path):
    """A folder of this test's own."""
    return str(tmp_path)
