from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]

from ticketlens.plans.standin import StandInTables  # noqa: E402
from ticketlens.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "local[8]",
        4,
        **{"spark.driver.memory": "8g", "spark.checkpoint.dir": str(shared)},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return StandInTables(spark, sf_dir)


@pytest.fixture(scope="session")
def rows_of():
    """Sorted rows of a frame, columns by name: equal lists mean equal tables."""

    def collect(df):
        return sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))

    return collect
