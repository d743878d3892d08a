"""Every registered query: against its SQL where there is one, and its plan."""

import pytest
from compare import duck, duck_rows, spark_rows, type_differences

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
# Those of the training-data subpackage have tests of their own.
QUERIES, ORACLES = entry_point.REGISTRY_QUERIES, entry_point.REGISTRY_ORACLES


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def check_plan(df):
    """No cross join, and nothing but partial aggregates (one row per task) may meet in a single task."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "Aggregate" in lines[i + 1], plan


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    df = QUERIES[name](spark, SMALL)
    check_plan(df)
    assert type_differences(df, connection, ORACLES[name]) == {}
    assert spark_rows(df) == duck_rows(connection, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert len(QUERIES[name](spark, SMALL).collect()) > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 6


def test_known_values_of_the_medium_tables(spark):
    funnel = {r.stage: r.sessions for r in QUERIES["funnel"](spark, MEDIUM).collect()}
    assert funnel == {"Visit": 3996, "Product View": 1603, "Add to Cart": 1063, "Begin Checkout": 865,
                      "Payment Info": 475, "Purchase": 475}
    split = {r["sample"]: (r.sessions, r.purchases) for r in QUERIES["split_summary"](spark, MEDIUM).collect()}
    assert split == {"Train": (2795, 329), "Test": (1201, 146)}
    row = QUERIES["model_metrics_nb"](spark, MEDIUM).first()
    assert (row.pr_auc, row.roc_auc) == (0.134251, 0.504428)
    deciles = sorted((r.score_decile, r.sessions, r.purchases) for r in QUERIES["decile_lift_nb"](spark, MEDIUM).collect())
    assert [d[1] for d in deciles] == [121] + [120] * 9
    assert [d[2] for d in deciles] == [17, 16, 17, 8, 16, 8, 13, 22, 18, 11]
    for name, rows, positives in (("early_features", 2964, 221), ("early_features_wide", 3182, 189)):
        got = QUERIES[name](spark, MEDIUM).selectExpr("count(*) AS n", "sum(converted) AS y").first()
        assert (got.n, got.y) == (rows, positives)
