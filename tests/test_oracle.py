"""Every deterministic query against its independent DuckDB SQL (row count, columns,
order-insensitive values) on the smallest fixture."""

import pytest

from tests.conftest import SF_SMALL


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck_small, name):
    from __spark_entry__ import oracle_sql, queries
    from tools.check_oracle import compare
    res = compare(spark, duck_small, SF_SMALL, name, queries()[name], oracle_sql()[name])
    assert res.startswith("OK"), res
