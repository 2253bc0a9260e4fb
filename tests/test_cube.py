import random

import pytest
from pyspark.sql import functions as F

from escalade.operators import analysis as A
from escalade.operators import cube as K
from escalade.operators import metrics as M
from escalade.operators import routing as R
from escalade.operators.labels import fixed_dictionary


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(11)
    conf = lambda: rng.choice([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, rng.random()])
    rows = [(i, rng.randrange(3), rng.randrange(200), rng.randrange(-1, 3), conf(), rng.randrange(-1, 3), conf(), rng.randrange(-1, 3), 1.0)
            for i in range(700)]
    return spark.createDataFrame(rows, "sample_id long, gold_label int, bytes_sent int, pred1 int, conf1 double, pred2 int, conf2 double,"
                                       " pred3 int, conf3 double")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_reports_of_the_cube_are_those_of_the_rows(spark, wide):
    grid = K.Grid((0.0, 0.65, 1.0), (0.7, 0.3), 0.55)
    each = R.decisions_from_wide(wide, theta1s=grid.theta1s, theta2s=grid.theta2s, two_tier_theta=grid.two_tier_theta)
    own = K.outcomes(K.decision_cube(wide, grid), grid=grid)
    names = fixed_dictionary(spark, ["a", "b"])
    reports = [A.escalation_rates, A.summarise, A.tier_counts, lambda d: A.bytes_per_correct(d, None), A.errors_by_tier,
               lambda d: A.errors_by_class(d, names), A.escalation_effect, M.confusion, M.macro_f1,
               lambda d: M.macro_f1_fixed(d, names), lambda d: M.classification_report(d, names)]
    for report in reports:
        a, b = report(each), report(own)
        assert a.dtypes == b.dtypes and rows(a) == rows(b)
    a = grid.cells()[0][0]
    cube = K.decision_cube(wide, grid)
    for b in ("ablation_tier3_only", "ablation_two_tier"):
        assert rows(A.mcnemar(each, a, b)) == rows(K.mcnemar(cube, a, b, grid))
    assert rows(A.tier_counts(R.decisions_from_wide(wide))) == rows(A.tier_counts(K.outcomes(K.decision_cube(wide))))


def test_cube_size_does_not_follow_the_rows(wide):
    cube = K.decision_cube(wide)
    assert cube.agg(F.sum("n")).first()[0] == 700
    assert K.decision_cube(wide.unionByName(wide)).count() == cube.count()


def test_unreached_tiers_need_no_score(spark):
    cols = "sample_id long, gold_label int, bytes_sent int, pred1 int, conf1 double, pred2 int, conf2 double, pred3 int, conf3 double"
    sure = spark.createDataFrame([(1, 0, 5, 0, 0.95, None, None, 1, 1.0)], cols)
    assert {r.tier_used for r in K.outcomes(K.decision_cube(sure)).filter("theta1 is not null").collect()} == {1}
    lost = spark.createDataFrame([(1, 0, 5, 0, 0.6, 1, 0.4, None, None)], cols)
    with pytest.raises(Exception, match="no score of tier 3"):
        K.outcomes(K.decision_cube(lost)).collect()
    for bad in ((1, 0, 5, 0, 1.5, 1, 0.4, 1, 1.0), (1, 0, 5, 0, 0.6, 1, float("nan"), 1, 1.0), (1, 0, 5, 0, None, 1, 0.5, 1, 1.0)):
        with pytest.raises(Exception, match="outside 0 to 1"):
            K.decision_cube(spark.createDataFrame([bad], cols)).collect()
    with pytest.raises(ValueError, match="no configuration"):
        K.outcomes(K.decision_cube(sure), configs=["x"])
    with pytest.raises(Exception, match="no samples"):
        K.mcnemar(K.decision_cube(sure.limit(0)), "ablation_tier1_only", "ablation_two_tier").collect()


def test_report_plans_explode_no_documents(spark):
    from escalade.plans.catalog import PLANS
    sf = "/root/testdata/sf0.001"
    for name in ("escalation_rates", "summarise", "tier_counts", "bytes_per_correct", "mcnemar", "errors_by_tier", "errors_by_class",
                 "escalation_effect", "confusion", "macro_f1", "macro_f1_fixed", "classification_report", "tier_quality"):
        text = PLANS[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "decision-cube" in text and "wide-scores" not in text, name
