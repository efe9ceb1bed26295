"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as contract
from alertfold_checks.oracles import ORACLES
from alertfold_checks.queries import registered
from alertfold_checks.verify import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registered()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["chat_id", "near_pairs"] and frame.count() > 0


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, con, name):
    good, note = compare(spark, con, SF_DIR, name)
    assert good, note


def test_only_what_sql_cannot_say_has_no_check():
    assert set(registered()) - set(ORACLES) == {"compact", "compact_notes", "compact_stream", "multibyte_guard"}
