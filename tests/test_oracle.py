"""Every registered query of the library against its SQL twin, on the smallest tables."""

import os

import pytest

from oracle import difference, duck
from paperloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, con, name):
    assert difference(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name]) == ""


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0


def test_no_row_at_a_time_python(spark):
    """No query runs row-at-a-time Python, and keyed joins are no Cartesian products."""
    for name in ("h4_related_papers", "f8_fuzzy_title_join", "f10_containment_match", "f21_neighbours", "e8_metrics"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "BatchEvalPython" not in plan, name
        assert "CartesianProduct" not in plan, name
