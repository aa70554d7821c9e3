"""Every query that SQL can express gives what SQL gives."""

import pytest

from leadline.plans import objects, problems, survey

SQL = {**problems.SQL, **survey.SQL, **objects.SQL}
QUERIES = {**problems.QUERIES, **survey.QUERIES, **objects.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_names_and_stubs():
    assert set(SQL) <= set(QUERIES)
