from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

TESTDATA = Path(os.environ.get("STOCKLINE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from stockline.session import local_session

    session = local_session("*", shuffle_partitions=8, app="stockline-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    path = TESTDATA / os.environ.get("STOCKLINE_TEST_SF", "sf0.001")
    if not path.exists():
        pytest.skip(f"test data not found at {path}")
    return str(path)
