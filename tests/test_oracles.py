"""Every registered query against its SQL, at the smallest scale."""

import importlib.util
import os

import pytest

from paths import SMALL
from panelweave.catalog import QUERIES

_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check_oracles.py")
_spec = importlib.util.spec_from_file_location("check_oracles", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    outcome = check.compare(spark, con, name, SMALL)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
