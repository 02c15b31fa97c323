"""Every registered query with SQL equals that SQL, run by another engine on the same files."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__
from gridlens.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    note, same = compare(spark, duck, FOLDER, QUERIES[name], ORACLES[name])
    assert same, note


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[0] == "user_id"


@pytest.mark.parametrize("name", ["qq_points", "normality_ks", "welch_psd", "perturb_projected", "event_iforest", "iforest", "principal_rule"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
