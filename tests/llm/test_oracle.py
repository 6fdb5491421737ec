"""Every query of the subpackage that has SQL must equal it."""

import pytest

from evispark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert not differences(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
