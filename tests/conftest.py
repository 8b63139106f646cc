from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scriptorium.session import build_session, ensure_checkpoint_dir, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", "4g", **{"spark.sql.shuffle.partitions": "4"})
    ensure_checkpoint_dir(session)
    ship_package(session)
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not DATA.is_dir():
        pytest.skip("the test tables are not here")
    return str(DATA)
