"""Every registered query against its SQL, on the smallest tables."""

import importlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402
import workload  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(workload.QUERIES) - set(workload.ORACLES))
USES_PYTHON = {"score_units_batches"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_sql(spark, con, name):
    fn = workload.QUERIES[name]
    assert oracle.compare(spark, con, name, fn, workload.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    df = workload.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ("Python" in plan or "MapInPandas" in plan) == (name in USES_PYTHON)
    assert df.count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["fused_label", "n", "pct"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
