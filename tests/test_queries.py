"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


def _names():
    import __spark_entry__ as entry

    return list(entry.queries())


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", _names())
def test_query(spark, tables, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, FOLDER).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert len(got) > 0
    else:
        assert compare(tables, text, got) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
