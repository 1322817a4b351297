import os

import pytest

from residua.plans import catalog, ensemble, fields, records, sweeps
from tests.compare import oracle, shown

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - {"seed_hops", "hop_explained_variance", "subset_scores"}))
def test_equals_sql(spark, name):
    assert shown(catalog.QUERIES[name](spark, SF).toPandas()) == shown(oracle(catalog.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(ensemble.ORACLES))
def test_ensemble_equals_sql(spark, name):
    assert shown(ensemble.QUERIES[name](spark, SF).toPandas()) == shown(oracle(ensemble.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(records.ORACLES))
def test_records_equal_sql(spark, name):
    assert shown(records.QUERIES[name](spark, SF).toPandas()) == shown(oracle(records.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(fields.ORACLES))
def test_fields_equal_sql(spark, name):
    assert shown(fields.QUERIES[name](spark, SF).toPandas()) == shown(oracle(fields.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(sweeps.ORACLES))
def test_sweeps_equal_sql(spark, name):
    assert shown(sweeps.QUERIES[name](spark, SF).toPandas()) == shown(oracle(sweeps.ORACLES[name], SF))
