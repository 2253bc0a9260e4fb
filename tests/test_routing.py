import random

import pytest
from pyspark.sql import functions as F

from escalade.operators import analysis as A
from escalade.operators import routing as R

# sample, gold, text, T1 proba, T2 proba, T3 label
F3 = [(0, 0, "ab", [.8, .1, .1], [.1, .8, .1], 1),
      (1, 1, "é", [.7, .2, .1], [.1, .8, .1], 1),
      (2, 1, "abc", [.4, .3, .3], [.2, .6, .2], 2),
      (3, 2, "a b", [.4, .4, .2], [.5, .3, .2], 2),
      (4, 2, "", [.4, .4, .2], [.5, .3, .2], -1)]


def fixture_cascade(spark, rows, costs=(1.0, 10.0, 100.0), seen=None):
    from escalade.functions.proba import argmax, pseudo_proba
    s1 = spark.createDataFrame([(r[0], r[3]) for r in rows], "sample_id long, proba array<double>")
    s2 = spark.createDataFrame([(r[0], r[4]) for r in rows], "sample_id long, proba array<double>")
    s3 = spark.createDataFrame([(r[0], r[5]) for r in rows], "sample_id long, label int")
    s3 = s3.withColumn("proba", pseudo_proba(F.col("label"), 3, "uniform"))

    def scorer(table, tier):
        def f(samples):
            if seen is not None:
                seen[tier] = samples
            j = samples.select("sample_id").join(table, "sample_id")
            if "label" not in table.columns:
                j = j.withColumn("label", argmax(F.col("proba")))
            return j.withColumn("confidence", F.array_max("proba"))
        return f
    return R.Cascade(scorer(s1, 1), scorer(s2, 2), scorer(s3, 3), costs)


def samples_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], len(r[2].encode())) for r in rows],
                                 "sample_id long, gold_label int, text string, bytes_sent int")


def test_route_fixture(spark):
    seen = {}
    c = fixture_cascade(spark, F3, seen=seen)
    d = R.route(c, samples_of(spark, F3), 0.7, 0.6).orderBy("sample_idx").collect()
    assert [r.tier_used for r in d] == [1, 1, 2, 3, 3]
    assert [r.prediction for r in d] == [0, 0, 1, 2, -1]
    assert [round(r.confidence, 6) for r in d] == [0.8, 0.7, 0.6, 1.0, round(1 / 3, 6)]
    assert [r.latency_ms for r in d] == [1, 1, 11, 111, 111]
    assert sum(r.correct for r in d) == 3
    # laziness: tier 2 saw only the escalated rows, tier 3 only theirs
    assert sorted(r.sample_id for r in seen[2].collect()) == [2, 3, 4]
    assert sorted(r.sample_id for r in seen[3].collect()) == [3, 4]


def test_ablations_fixture(spark):
    c = fixture_cascade(spark, F3)
    s = samples_of(spark, F3)
    t1 = R.ablation_tier1(c, s).orderBy("sample_idx").collect()
    assert [r.prediction for r in t1] == [0] * 5 and {r.latency_ms for r in t1} == {1.0}
    t3 = R.ablation_tier3(c, s).orderBy("sample_idx").collect()
    assert [r.prediction for r in t3] == [1, 1, 2, 2, -1] and {r.latency_ms for r in t3} == {100.0}
    tt = R.ablation_two_tier(c, s).orderBy("sample_idx").collect()
    assert [r.tier_used for r in tt] == [1, 1, 2, 2, 2]
    assert [r.prediction for r in tt] == [0, 0, 1, 0, 0]
    assert [r.latency_ms for r in tt] == [1, 1, 11, 11, 11]


def test_bytes_and_cost(spark):
    c = fixture_cascade(spark, F3)
    d = R.with_config(R.route(c, samples_of(spark, F3), 0.7, 0.6), "x")
    bpc = A.bytes_per_correct(d, dp=None).collect()[0].bytes_per_correct
    assert abs(bpc - 10 / 3) < 1e-12
    rates = A.escalation_rates(d).collect()[0]
    assert rates.mean_latency_ms == pytest.approx(47.0)


def test_invalid_threshold(spark):
    c = fixture_cascade(spark, F3)
    with pytest.raises(ValueError):
        R.route(c, samples_of(spark, F3), 1.5, 0.5)


def test_nan_confidence_fails(spark):
    rows = [(0, 0, "a", [float("nan"), .5, .5], [.1, .8, .1], 1)]
    c = fixture_cascade(spark, rows)
    with pytest.raises(Exception):
        R.route(c, samples_of(spark, rows), 0.5, 0.5).collect()


def _random_rows(n, seed):
    rnd = random.Random(seed)
    grid = [0.5, 0.6, 0.7, 0.8, 0.9]
    rows = []
    for i in range(n):
        def vec():
            # confidences sometimes exactly on a threshold
            top = rnd.choice(grid) if rnd.random() < 0.3 else rnd.uniform(0.34, 1.0)
            rest = (1 - top) / 2
            v = [top, rest, rest]
            rnd.shuffle(v)
            return v
        rows.append((i, rnd.randrange(3), "t" * rnd.randrange(1, 5), vec(), vec(), rnd.randrange(-1, 3)))
    return rows


def test_binned_sweep_equals_expanded(spark):
    rows = _random_rows(300, 1)
    c = fixture_cascade(spark, rows)
    s = samples_of(spark, rows)
    expanded = A.escalation_rates(R.sweep_decisions(c, s))
    binned = R.sweep_summary(c, s)
    cols = ["config", "n_tier1", "n_tier2", "n_tier3", "accuracy", "mean_latency_ms"]
    e = {r.config: r for r in expanded.select(*cols).collect()}
    b = {r.config: r for r in binned.select(*cols).collect()}
    assert e.keys() == b.keys() and len(e) == 25
    for k in e:
        assert (e[k].n_tier1, e[k].n_tier2, e[k].n_tier3) == (b[k].n_tier1, b[k].n_tier2, b[k].n_tier3)
        assert e[k].accuracy == pytest.approx(b[k].accuracy)
        assert e[k].mean_latency_ms == pytest.approx(b[k].mean_latency_ms)


def test_sweep_brute_force(spark):
    rows = _random_rows(120, 2)
    c = fixture_cascade(spark, rows)
    got = {(r.config, r.sample_idx): (r.tier_used, r.prediction) for r in
           R.sweep_decisions(c, samples_of(spark, rows)).collect()}
    for t1 in R.DEFAULT_THETAS:
        for t2 in R.DEFAULT_THETAS:
            for r in rows:
                p1, p2 = r[3], r[4]
                if max(p1) >= t1:
                    exp = (1, p1.index(max(p1)))
                elif max(p2) >= t2:
                    exp = (2, p2.index(max(p2)))
                else:
                    exp = (3, r[5])
                assert got[(R.config_name(t1, t2), r[0])] == exp


def test_monotone_escalation(spark):
    rows = _random_rows(200, 3)
    c = fixture_cascade(spark, rows)
    summ = {r.theta1: r for r in R.sweep_summary(c, samples_of(spark, rows)).where("theta2 = 0.5").collect()}
    esc = [summ[t].n_tier2 + summ[t].n_tier3 for t in sorted(summ)]
    assert esc == sorted(esc)
    for r in summ.values():
        assert abs(r.rate_tier1 + r.rate_tier2 + r.rate_tier3 - 1) < 1e-9


def test_missing_score_fails(spark):
    c = fixture_cascade(spark, F3[:3])
    with pytest.raises(Exception):
        R.ablation_tier1(c, samples_of(spark, F3)).collect()


def test_length_rule(spark):
    df = spark.createDataFrame([("a b c",), ("a b",)], "text string")
    rule = R.length_rule(2)
    assert [r.e for r in df.select(rule(F.col("text"), F.lit(None)).alias("e")).collect()] == [True, False]
    with pytest.raises(ValueError):
        R.length_rule(-1)
    conf = R.confidence_rule(0.7)
    p = spark.createDataFrame([([0.65, 0.35],), ([0.7, 0.3],)], "proba array<double>")
    assert [r.e for r in p.select(conf(F.lit(None), F.col("proba")).alias("e")).collect()] == [True, False]


def test_pandas_scorer_is_lazy(spark):
    """A Python (Arrow) tier 3 in the staged cascade scores only escalated rows."""
    from pyspark.sql import types as T

    from escalade.operators.scoring import pandas_scorer
    acc = spark.sparkContext.accumulator(0)

    def predict(texts):
        acc.add(len(texts))
        return [1] * len(texts), [[0.0, 1.0, 0.0]] * len(texts)

    base = fixture_cascade(spark, F3)
    c = R.Cascade(base.tier1, base.tier2, pandas_scorer(predict, 3, 3), base.costs)
    d = R.route(c, samples_of(spark, F3), 0.7, 0.6).orderBy("sample_idx").collect()
    assert [r.tier_used for r in d] == [1, 1, 2, 3, 3]
    assert [r.prediction for r in d][3:] == [1, 1]
    assert acc.value == 2


def test_strategy_dispatch(spark):
    df = spark.createDataFrame([("a b c", [0.65, 0.35])], "text string, proba array<double>")
    conf = R.strategy("confidence", theta=0.7)
    length = R.strategy("length", limit=20)
    r = df.select(conf(F.col("text"), F.col("proba")).alias("c"), length(F.col("text"), F.col("proba")).alias("l")).collect()[0]
    assert r.c is True and r.l is False
    with pytest.raises(ValueError):
        R.strategy("nope")


def test_save_report(spark, tmp_path):
    from escalade.sources.results import save_report
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "config string, v double")
    out = str(tmp_path / "rep")
    save_report(df, out)
    files = [f for f in __import__("os").listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    assert spark.read.option("header", True).csv(out).count() == 2


def test_fit_text_cascade_on_any_table(spark):
    """The cascade fits on any labelled text table and its report is whole."""
    from escalade.operators import analysis as A
    from escalade.plans.cascade import fit_text_cascade
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet") \
        .withColumn("uid", F.col("conv_id") * 1000 + F.col("turn"))
    dc = fit_text_cascade(conv, id_col="uid", text_col="text", label_col="role", vocab1=8, vocab2=64)
    rates = A.escalation_rates(dc.decisions()).collect()
    n = conv.count()
    assert len(rates) == 28 and all(r.n_tier1 + r.n_tier2 + r.n_tier3 == n for r in rates)
