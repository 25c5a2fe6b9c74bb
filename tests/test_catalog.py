"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from checks import catalog
from checks.compare import compare, duck

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
catalog.load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note
    assert "TYPES" not in note, note


def test_every_query_without_sql_is_a_job_sql_cannot_state():
    from checks import learning  # noqa: F401

    without = set(catalog.QUERIES) - set(catalog.ORACLES)
    learned = {n for n, q in catalog.QUERIES.items() if q.__module__ == "checks.learning"}
    assert without == learned | {"file_fingerprint"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) == 15 and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
