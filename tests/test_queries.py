"""Every query of the core against its SQL on the smallest tables; queries without SQL must run."""

from __future__ import annotations

import pytest
from compare import connect, same

from textloom import queries as core


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, small, con, name):
    df = core.queries()[name](spark, small)
    if name in core.oracle_sql():
        same(con, df, core.oracle_sql()[name])
    else:
        df.collect()


def test_entry_works_without_the_optional_subpackage(spark, small):
    assert core.entry(spark, small).count() > 0
