"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract
from evidence_engine.plans.oracles import ORACLES
from evidence_engine.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return compare.duck(SF_DIR)


def test_entry(spark):
    hits = contract.entry(spark)
    assert hits.columns == ["query_id", "rank", "chunk_id", "document_id", "source", "text", "score"]
    assert hits.count() > 0


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    assert compare.differences(contract.queries()[name](spark, SF_DIR), tables, contract.oracle_sql()[name]) == []
