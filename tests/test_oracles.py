import os

import pytest
from oracle import assert_same

from quarry import catalogue

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.SQL:
        n = assert_same(spark, catalogue.QUERIES[name], catalogue.SQL[name], SF)
    else:
        n = catalogue.QUERIES[name](spark, SF).count()
    assert n > 0 or name in catalogue.MAY_BE_EMPTY
