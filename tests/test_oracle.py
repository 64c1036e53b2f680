import os

import pytest

from nodeweft.plans import queries as core
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, core.queries()[name], core.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
