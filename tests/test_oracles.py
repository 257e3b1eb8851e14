"""Every registered query of the sensor engine against its oracle, at a small size."""

import pytest
from oracle import differences

from chanspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"state_machine_tuning"}))
def test_query_without_oracle_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
