from __future__ import annotations

import pytest
from compare import connect, difference

from habitus.llm.oracles import ORACLES
from habitus.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sample, name):
    assert difference(QUERIES[name](spark, sample), connect(sample), ORACLES[name]) is None
