import pytest

from plenum.llm.queries import ORACLES, QUERIES
from tests.test_queries import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):  # noqa: F811
    df = QUERIES[name](spark, small)
    rel = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
