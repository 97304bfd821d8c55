"""The registered queries against their SQL."""

import compare
import pytest

from evidence_engine.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare.differences(QUERIES[name](spark, sf_dir), compare.duck(sf_dir), ORACLES[name]) == []
