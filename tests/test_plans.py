"""Physical-plan properties of the registered plans."""

import pytest

from escalade.plans.catalog import PLANS

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
# plans allowed to run Python: the McNemar p-value (one row per comparison), a user's
# scoring function, and Arrow batches that map token arrays to ids or dense features
PYTHON_OK = {"mcnemar", "scores_user_model", "fixed_length_ids", "lr_fit_score", "lr_predictions",
             "subword_ids", "subword_ids_truncated", "lazy_cascade", "lazy_sweep"}


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, fn in sorted(PLANS.items()):
        out[name] = executed(fn(spark, SF))
    return out


def test_no_pairwise_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_where_intended(plans):
    bad = [n for n, p in plans.items() if any(k in p for k in PYTHON_NODES) and n not in PYTHON_OK]
    assert bad == []


def test_bounded_tier_model_is_broadcast(plans):
    assert "BroadcastHashJoin" in plans["scores_tier1"]
    assert "BroadcastExchange" in plans["scores_tier1"]


def test_few_shot_limits_before_shuffle(plans):
    assert "WindowGroupLimit" in plans["few_shot_sampled"]


def test_parquet_scans_prune_columns(spark):
    df = PLANS["bytes_sent"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
