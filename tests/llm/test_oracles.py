"""Registered queries of this folder against their oracles, where they have one."""

import pytest

from evalspark.llm.queries import QUERIES

from ..compare import connect, difference


@pytest.mark.parametrize("name", [name for name, (_, oracle) in QUERIES.items() if oracle])
def test_query_equals_its_oracle(spark, sf_dir, name):
    run, oracle = QUERIES[name]
    assert difference(run(spark, sf_dir), connect(sf_dir), oracle) is None
