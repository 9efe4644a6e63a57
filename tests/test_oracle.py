"""Every query against its SQL over whole tables."""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"tree_models"}
# Queries of the text subpackage have tests of their own beside it.
TEXT = re.compile(r"op[0-9]+_|pipeline$")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if not TEXT.match(n)))
def test_same_rows(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert differences(got, duck.sql(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - set(oracle_sql()) - SLOW if not TEXT.match(n)))
def test_runs(spark, name):
    assert queries()[name](spark, SF_DIR).columns


def test_entry(spark):
    assert entry(spark).count() > 0
