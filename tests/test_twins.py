"""Every query with a SQL twin gives the twin's rows."""

import pytest
from conftest import DATA
from opsgraph.plans import registry

QUERIES, TWINS = registry.queries(), registry.oracle_sql()


def rows(frame, columns):
    text = lambda v: "" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(TWINS[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
