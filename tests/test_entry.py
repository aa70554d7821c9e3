"""The driver's contract."""

import __spark_entry__ as entry
import pytest


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    for n in (1, 2, 3, 6):
        assert f"p{n}_found" in queries


def test_flagship(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["tile_x", "tile_y", "resolution", "row", "col", "depth", "density", "vertical_uncertainty", "horizontal_uncertainty"] and df.count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p1_flags", "cube_grid", "total_uncertainty_histogram"])
def test_queries_without_sql(name, spark, data):
    assert entry.queries()[name](spark, data).count() > 0
