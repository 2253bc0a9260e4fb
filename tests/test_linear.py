import numpy as np
import pytest
from pyspark.sql import functions as F

from escalade.operators import learned
from escalade.operators import linear as LN


def made(spark, n=240, features=12, classes=3, folds=3, seed=0):
    rng = np.random.default_rng(seed)
    true = rng.normal(size=(features, classes)) * 2
    rows = []
    for i in range(n):
        at = np.sort(rng.choice(features, rng.integers(0, 6), replace=False))
        x = rng.normal(size=len(at))
        gold = int((x @ true[at] + rng.gumbel(size=classes)).argmax())
        rows.append((i, int(rng.integers(folds)), gold, at.tolist(), x.tolist()))
    return rows, spark.createDataFrame(rows, "id long, fold int, gold int, positions array<int>, values array<double>").repartition(4)


def dense(rows, features):
    x = np.zeros((len(rows), features + 1))
    for i, (_, _, _, at, v) in enumerate(rows):
        x[i, at] = v
    x[:, -1] = 1
    return x


def test_gradient_is_zero_by_numpy_and_by_joins(spark):
    rows, df = made(spark)
    model = LN.fit(df, 12, 3, 3)
    x, gold, fold = dense(rows, 12), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for k in range(3):
        own = fold != k
        z = x[own] @ model.weights[k]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(own.sum()), gold[own]] -= 1
        g = x[own].T @ p / own.sum()
        g[:-1] += model.weights[k][:-1] / own.sum()
        assert np.abs(g).max() < 2e-8 and model.rows[k] == own.sum()
    stated = LN.conditions(df, model, "id").collect()
    assert len(stated) == 3 * 3 * 13 and max(abs(r.value) for r in stated) < 2e-8
    # weights that are off are told
    off = LN.LinearModel(model.weights + np.eye(13, 3) * 0.1, model.penalty, model.rows, 0.0, 0)
    assert max(abs(r.value) for r in LN.conditions(df, off, "id").collect()) > 1e-3


def test_scores_are_those_of_spark_ml(spark):
    rows, df = made(spark, seed=1)
    model = LN.fit(df, 12, 3, 3, c=2.0)
    got = {r.id: r for r in LN.score(df, model, ["id"]).collect()}
    wide = spark.createDataFrame([(r[0], r[1], float(r[2]), v[:-1].tolist()) for r, v in zip(rows, dense(rows, 12))],
                                 "id long, fold int, gold double, x array<double>")
    for k in range(3):
        for r in learned.lr_fit_score(wide.where(F.col("fold") != k), wide.where(F.col("fold") == k), "x", "gold", c=2.0).collect():
            assert np.allclose(got[r.id].proba, r.proba, atol=1e-5) and got[r.id].label == r.label
            assert abs(got[r.id].confidence - max(got[r.id].proba)) < 1e-15


def test_partial_sums_are_added_in_rounds(spark, monkeypatch):
    rows, df = made(spark, n=120)
    one = LN.fit(df.coalesce(1), 12, 3, 3)
    monkeypatch.setattr(LN, "FAN", 2)
    many = LN.fit(df.repartition(7), 12, 3, 3)
    assert np.allclose(one.weights, many.weights, atol=1e-6)


def test_bad_inputs(spark):
    rows, df = made(spark, n=30)
    with pytest.raises(ValueError, match="no training rows"):
        LN.fit(df.withColumn("fold", F.lit(0)), 12, 3, 1)
    with pytest.raises(ValueError, match="numbers"):
        LN.fit(df, 10 ** 9, 3, 3)
    with pytest.raises(RuntimeError, match="no convergence"):
        LN.fit(df, 12, 3, 3, max_passes=3)


def test_sparse_rows(spark):
    voc = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id int")
    w = spark.createDataFrame([(1, "c", 0.5), (1, "a", 0.25), (2, "b", 1.0), (2, "z", 9.0)], "id long, term string, weight double")
    out = LN.sparse_rows(spark.createDataFrame([(1,), (2,), (3,)], "id long"), w, voc, "id").orderBy("id").collect()
    assert [(list(r.positions), list(r["values"])) for r in out] == [([0, 2], [0.25, 0.5]), ([1], [1.0]), ([], [])]


def test_passes_do_not_follow_the_scale_of_features(spark, monkeypatch):
    rows, df = made(spark, n=300, seed=2)
    df = df.withColumn("values", F.expr("transform(values, (v, i) -> v * pow(10, positions[i] % 3 - 1))")).coalesce(1)
    model = LN.fit(df, 12, 3, 3, c=10.0, max_passes=45)
    assert model.gradient <= 1e-8
    monkeypatch.setattr(LN, "GRAM", 0)  # without the curvature
    with pytest.raises(RuntimeError, match="no convergence"):
        LN.fit(df, 12, 3, 3, c=10.0, max_passes=45)
