import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from escalade.operators import lazy as L
from escalade.operators import routing as R


def recording(folder, tier, answers, n_classes=2, batch_size=4):
    """A model that notes its loads and calls; ``answers``: text -> probabilities."""
    def load():
        with open(f"{folder}/load-{tier}-{os.getpid()}", "a") as f:
            f.write("1\n")

        def predict(texts):
            with open(f"{folder}/call-{tier}-{os.getpid()}", "a") as f:
                f.write("|".join(texts) + "\n")
            rows = [answers[t] for t in texts]
            return [max(range(n_classes), key=r.__getitem__) for r in rows], rows
        return predict
    return L.BatchModel(load, n_classes, batch_size)


def notes(folder, kind, tier):
    """{worker: lines} of a model's notes."""
    return {n: open(f"{folder}/{n}").read().splitlines() for n in os.listdir(folder) if n.startswith(f"{kind}-{tier}-")}


def made(spark, tmp_path, n=203, parts=3, sizes=(16, 8, 4)):
    rng = random.Random(n)
    texts = [f"t{i}" for i in range(n)]
    answers = [{t: (lambda p: [p, 1 - p])(rng.randrange(0, 11) / 10) for t in texts} for _ in range(3)]
    models = [recording(str(tmp_path), k + 1, a, batch_size=s) for k, (a, s) in enumerate(zip(answers, sizes))]
    rows = [(i, t, rng.randrange(2), len(t)) for i, t in enumerate(texts)]
    samples = spark.createDataFrame(rows, "sample_id long, text string, gold_label int, bytes_sent int").repartition(parts)
    return texts, answers, models, samples


def test_one_pass_is_the_staged_cascade(spark, tmp_path):
    texts, answers, models, samples = made(spark, tmp_path)
    lazy = L.model_cascade(models)
    staged = R.Cascade(lazy.tier1, lazy.tier2, lazy.tier3)
    for t1, t2 in ((0.7, 0.8), (0.0, 0.0), (1.0, 1.0)):
        a = sorted(map(tuple, R.route(lazy, samples, t1, t2).collect()))
        assert a == sorted(map(tuple, R.route(staged, samples, t1, t2).collect())) and len(a) == len(texts)
    a = R.sweep_summary(lazy, samples).orderBy("config").collect()
    assert a == R.sweep_summary(staged, samples).orderBy("config").collect()


def test_a_tier_sees_escalated_rows_only_in_full_batches(spark, tmp_path):
    texts, answers, models, samples = made(spark, tmp_path, n=400, parts=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        R.route(L.model_cascade(models), samples, 0.8, 0.9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [set(texts)]
    want.append({t for t in texts if max(answers[0][t]) < 0.8})
    want.append({t for t in want[1] if max(answers[1][t]) < 0.9})
    for k in (1, 2, 3):
        calls = [c.split("|") for lines in notes(tmp_path, "call", k).values() for c in lines]
        assert sorted(t for c in calls for t in c) == sorted(want[k - 1])
        sizes = [len(c) for c in calls]
        # Arrow batches of 7 rows are regrouped: only the last call of a partition is smaller
        assert max(sizes) == models[k - 1].batch_size and sum(s < models[k - 1].batch_size for s in sizes) <= 2


def test_a_worker_loads_a_model_once(spark, tmp_path):
    _, _, models, samples = made(spark, tmp_path, parts=12)
    for _ in range(3):  # three jobs of twelve tasks
        R.route(L.model_cascade(models), samples, 1.0, 1.0).collect()
    for k in (1, 2, 3):
        loads = notes(tmp_path, "load", k)
        assert loads and all(lines == ["1"] for lines in loads.values())
        assert sum(len(c) for c in notes(tmp_path, "call", k).values()) >= 36


def test_plan_has_no_join_and_no_shuffle(spark, tmp_path):
    _, _, models, samples = made(spark, tmp_path)
    plan = R.route(L.model_cascade(models), samples.coalesce(2), 0.7, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_model_scorer_contract(spark, tmp_path):
    texts, answers, models, samples = made(spark, tmp_path)
    out = L.model_scorer(models[0], 2, keep=["gold_label"])(samples)
    assert out.columns == ["sample_id", "gold_label", "tier", "label", "proba", "confidence"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.proba) == answers[0][f"t{r.sample_id}"] and r.confidence == max(r.proba) and r.tier == 2


def test_bad_models_fail(spark, tmp_path):
    samples = spark.createDataFrame([(1, None, 0, 0), (2, "b", 0, 1)], "sample_id long, text string, gold_label int, bytes_sent int")
    with pytest.raises(TypeError, match="loads it"):
        L.BatchModel("model", 2)
    with pytest.raises(ValueError, match="three tiers"):
        L.model_cascade([L.BatchModel(lambda: None, 2)])
    with pytest.raises(TypeError, match="tier 2"):
        R.Cascade(lambda s: s, "x", lambda s: s)
    short = L.BatchModel(lambda: lambda texts: ([0], [[1.0, 0.0]]), 2)
    with pytest.raises(Exception, match="for 2 texts"):
        L.model_scorer(short, 1)(samples.coalesce(1)).collect()
    wrong = L.BatchModel(lambda: lambda texts: ([0] * len(texts), [[1.5, 0.0]] * len(texts)), 2)
    with pytest.raises(Exception, match="outside 0 to 1"):
        R.route(L.model_cascade([wrong] * 3), samples, 0.5, 0.5).collect()
    fine = L.BatchModel(lambda: lambda texts: ([len(t) for t in texts], [[1.0, 0.0]] * len(texts)), 2)
    # a null text is an empty one
    assert {r.sample_idx: r.prediction for r in R.route(L.model_cascade([fine] * 3), samples, 0.5, 0.5).collect()} == {1: 0, 2: 1}
    assert R.route(L.model_cascade([fine] * 3), samples.limit(0), 0.5, 0.5).count() == 0


def test_regrouping_keeps_order_and_rows():
    import pyarrow as pa
    rng = random.Random(3)
    for size in (1, 3, 10):
        q, out, given = L.Regrouped(size), [], 0
        for _ in range(20):
            n = rng.randrange(0, 9)
            for full in q.put(pa.table({"x": pa.array(range(given, given + n), pa.int64())})):
                assert full.num_rows == size
                out += full["x"].to_pylist()
            given += n
        for last in q.rest():
            out += last["x"].to_pylist()
        assert out == list(range(given))
