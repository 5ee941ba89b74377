"""Every query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from pulsegrid.plans import catalogue
from tests.conftest import DATA, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert name in catalogue.ORACLE
    names, rows = rows_of(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert (names, rows) == rows_of_sql(duck, catalogue.ORACLE[name])
