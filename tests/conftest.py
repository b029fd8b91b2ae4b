from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from offerlake.session import local_session  # noqa: E402
from offerlake.sources.fixtures import DriverTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "tests")


@pytest.fixture(scope="session")
def tables(spark):
    return DriverTables(spark, SMALL)
