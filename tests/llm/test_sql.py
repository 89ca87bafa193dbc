from __future__ import annotations

import pytest
from compare import check

from tilewright.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, q.QUERIES[name], q.ORACLE_SQL[name], SF)
