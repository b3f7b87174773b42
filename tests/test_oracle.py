"""Every query of the analytics library against its SQL, on a small folder of test tables."""
import pytest

from framelark.plans import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(duckdb_at):
    return duckdb_at(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, compare, tables, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        want = tables.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare(got) == compare(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "event_id", "filtered"]
