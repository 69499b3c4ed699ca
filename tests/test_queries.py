"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_sql_has_no_stray_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    outcome, _ = compare(spark, db, FOLDER, name)
    assert outcome.startswith(("equal", "no SQL")), outcome
    assert "types" not in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).count() == 40
