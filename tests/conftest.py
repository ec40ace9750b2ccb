from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lettermill.session import fresh_dir, local_session  # noqa: E402
from lettermill.sinks.store import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def store(spark):
    return Store(spark, fresh_dir(spark, "test-store"), buckets=4)
