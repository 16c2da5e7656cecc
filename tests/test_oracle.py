"""Every registered query against its DuckDB text, whole results."""

import os

import pytest

import harness
from rowflow.queries import ORACLES, QUERIES

FOLDER = os.environ.get("ROWFLOW_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return harness.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    columns, got = harness.spark_rows(QUERIES[name](spark, FOLDER))
    if name not in ORACLES:
        assert sum(got.values()) > 0
        return
    want_columns, want = harness.duck_rows(duck, ORACLES[name])
    assert columns == want_columns
    assert got == want


def test_only_metadata_queries_lack_a_check():
    assert set(QUERIES) - set(ORACLES) == {"src_file_inventory"}
