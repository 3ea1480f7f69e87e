"""One local session for all tests, and helpers to compare with DuckDB."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("STROPHE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strophe.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "8"), 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
