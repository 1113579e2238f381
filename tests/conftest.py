from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from slipstack.session import clear_scratch, local_session

    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(autouse=True)
def small_large_keys(monkeypatch):
    """Keys of more than twenty rows count as large, so both ways are exercised."""
    from slipstack.operators import ordered

    monkeypatch.setattr(ordered, "HOT_ROWS", 20)


@pytest.fixture
def rows(spark):
    """rows(list of tuples, schema) -> DataFrame."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make
