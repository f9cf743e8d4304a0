"""Queries of the training-data operators that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest
from comparing import rows_of, rows_of_sql

from proofmill.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_are_those_of_sql(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    names, rows = rows_of_sql(duck, oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == rows
