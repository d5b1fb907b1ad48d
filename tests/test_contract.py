import os

import pytest

import __spark_entry__ as entry
from verify import compare, connect

BASE = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("p1_", "p3_", "p6_", "p8_", "p9_", "p10_"))])
def test_equals_sql(spark, name):
    ok, said = compare(spark, connect(BASE), BASE, name, entry.oracle_sql()[name])
    assert ok, said
