from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from ledgermill.session import build_session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = build_session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
