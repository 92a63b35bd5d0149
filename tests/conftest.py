"""One local session for all tests; Python workers find the package through PYTHONPATH."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from paperloom.session import STATE_STORE_SETTING, local_session

    session = local_session(8, "paperloom-tests", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set(*STATE_STORE_SETTING)
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh scratch folder, left in place afterwards."""
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
