"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import differences

from leafmill import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_agrees_with_sql(spark, name):
    assert differences(plans.queries()[name](spark, SF), plans.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, name):
    found = plans.queries()[name](spark, SF)
    assert found.columns and len(found.collect()) > 0
