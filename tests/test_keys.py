import random

import pytest
from pyspark.sql import functions as F

from escalade.operators import completeness as K
from escalade.operators import routing as R
from escalade.operators.indexing import positional_index
from escalade.operators.labels import label_dictionary, label_encode


def keyed(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"sample_id {kind}").repartition(3)


def test_complete_whatever_the_order(spark):
    ids = list(range(200)) + [5, 5, None]
    a, b = keyed(spark, ids), keyed(spark, random.Random(1).sample(ids, len(ids)), "int")
    K.check_complete(a, b)
    assert tuple(K.completeness(a, b, ["sample_id"]).first()) == (203, 203, True, 0, 0, 0)
    assert K.key_digest(a, ["sample_id"]) != K.key_digest(keyed(spark, ids[:-1] + [0]), ["sample_id"])


@pytest.mark.parametrize("scores,found", [
    ([1, 2, 3], (4, 3, False, 1, 0, 0)),  # missing
    ([1, 2, 3, 4, 5], (4, 5, False, 0, 1, 0)),  # extra
    ([1, 2, 3, 4, 4], (4, 5, False, 0, 0, 1)),  # repeated
    ([1, 2, 3, 3], (4, 4, False, 1, 0, 1)),  # as many, not the same
    ([], (4, 0, False, 4, 0, 0)),
])
def test_differences_are_counted_and_raise(spark, scores, found):
    a, b = keyed(spark, [1, 2, 3, 4]), keyed(spark, scores)
    assert tuple(K.completeness(a, b, ["sample_id"]).first()) == found
    with pytest.raises(ValueError, match="differ in"):
        K.check_complete(a, b)


def test_several_keys_with_nulls(spark):
    rows = lambda r: spark.createDataFrame(r, "a long, b string")
    assert K.completeness(rows([(1, None), (None, "1")]), rows([(None, "1"), (1, None)]), ["a", "b"]).first().complete
    assert not K.completeness(rows([(1, None)]), rows([(None, None)]), ["a", "b"]).first().complete


def scorer(spark, rows):
    table = spark.createDataFrame(rows, "sample_id long, label int, proba array<double>, confidence double")
    return lambda samples: table


@pytest.mark.parametrize("rows,message", [
    ([(1, 0, [1.0], 1.0)], "no score for sample 2"),
    ([(1, 0, [1.0], 1.0), (2, 0, [1.0], 1.0), (3, 0, [1.0], 1.0)], "a score for sample 3"),
    ([(1, 0, [1.0], 1.0), (2, 0, [1.0], 1.0), (2, 0, [1.0], 1.0)], "2 scores for sample 2"),
])
def test_scores_that_do_not_fit_the_samples_fail(spark, rows, message):
    samples = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "sample_id long, gold_label int, bytes_sent int")
    c = R.Cascade(*[scorer(spark, rows)] * 3)
    for run in (lambda: R.ablation_tier1(c, samples), lambda: R.ablation_tier3(c, samples), lambda: R.ablation_two_tier(c, samples),
                lambda: R.route(c, samples, 0.5, 0.5)):
        with pytest.raises(Exception, match="confidence lies outside|" + message):
            run().collect()


def test_positions_are_those_of_a_sort(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50) if rng.random() < .9 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, i long").repartition(7)
    for ranges in (1, 4, 40):
        got = positional_index(df, ["v", "i"], ranges=ranges).collect()
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.position)] == want
        assert sorted(r.position for r in got) == list(range(500))
    down = positional_index(df, [F.col("v").desc(), "i"], "n", start=1).collect()
    assert sorted(r.n for r in down) == list(range(1, 501))
    assert [r.v for r in sorted(down, key=lambda r: r.n)] == sorted((r[0] for r in rows), key=lambda v: (v is None, -(v or 0)))
    with pytest.raises(ValueError, match="already"):
        positional_index(df, ["v"], "v")
    assert positional_index(df.limit(0), ["v"]).count() == 0


def test_equal_rows_spread_over_the_ranges(spark):
    """A third of all rows equal: no range holds much more than its share, and positions stay gapless."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("v")).repartition(8)
    out = positional_index(df, ["v"], ranges=10)
    assert sorted(r.position for r in out.collect()) == list(range(3000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    sizes = [r["count"] for r in out.groupBy(F.floor(F.col("position") / 300)).count().collect()]
    assert sizes == [300] * 10


def test_dictionaries_of_many_values(spark):
    df = spark.range(30_000).select(F.concat(F.lit("l"), F.col("id") % 12_000).alias("name"), "id")
    d = label_dictionary(df, "name")
    rows = sorted((r.label_id, r.label) for r in d.collect())
    assert [r[1] for r in rows] == sorted({f"l{i}" for i in range(12_000)}) and [r[0] for r in rows] == list(range(12_000))
    assert label_encode(df, "name", d).filter("label_id is null").count() == 0
    assert "Window" not in d._jdf.queryExecution().executedPlan().toString()
