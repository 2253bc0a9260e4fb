import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from escalade.operators import features as FT
from escalade.operators import metrics as M
from escalade.operators import sampling as S
from escalade.operators.labels import fixed_dictionary


def test_tfidf_fixture(spark):
    docs = spark.createDataFrame([("a1", "aa aa bb"), ("a2", "bb cc")], "id string, text string")
    tc = FT.tokenize(docs, "id")
    w = {(r.id, r.term): r.weight for r in FT.tfidf(tc, "id").collect()}
    assert w[("a1", "aa")] == pytest.approx(0.921907, abs=1e-6)
    assert w[("a1", "bb")] == pytest.approx(0.387411, abs=1e-6)
    assert w[("a2", "bb")] == pytest.approx(0.579739, abs=1e-6)
    assert w[("a2", "cc")] == pytest.approx(0.814802, abs=1e-6)
    voc = FT.vocabulary(tc, 2).collect()
    assert [(r.term_id, r.term, r.term_count) for r in voc] == [(0, "aa", 2), (1, "bb", 2)]


def test_fixed_length_windows_cover_text(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "zz")], "id int, text string")
    voc = FT.vocabulary(FT.tokenize(docs, "id"), 2)
    rows = sorted(FT.fixed_length_ids(docs, "id", voc, 2).collect(), key=lambda r: (r.id, r.window))
    assert [(r.id, r.window) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert rows[2].input_ids[1] == FT.PAD_ID and rows[2].attention_mask == [1, 0]
    assert all(len(r.input_ids) == 2 for r in rows)


def test_stratified_split_exact(spark):
    rows = [(i, "a" if i % 10 < 6 else ("b" if i % 10 < 9 else "c")) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, y string")
    out = S.stratified_split(df, "y", "id", 0.25, seed=3).collect()
    assert len(out) == 997 and len({r.id for r in out}) == 997
    test = Counter(r.y for r in out if r.split == "test")
    n = Counter(y for _, y in rows)
    total = math.ceil(997 * 0.25)
    assert sum(test.values()) == total
    for c in n:
        assert abs(test[c] - total * n[c] / 997) < 1.0
    again = {r.id: r.split for r in S.stratified_split(df, "y", "id", 0.25, seed=3).collect()}
    assert again == {r.id: r.split for r in out}


def test_few_shot(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "id long, y string")
    head = S.few_shot_head(df, "y", "id", 2).collect()
    assert sorted((r.y, r.id) for r in head) == [("x", 0), ("x", 3), ("y", 1), ("y", 4), ("z", 2), ("z", 5)]
    smp = S.few_shot_sampled(df, "y", "id", 4, seed=1, labels=["x", "y"]).collect()
    assert Counter(r.y for r in smp) == {"x": 4, "y": 4}
    assert S.few_shot_sampled(df, "y", "id", 0).count() == 0


def test_macro_f1_brute(spark):
    gold = [0, 0, 1, 1, 2, 2, 2, 1]
    pred = [0, 1, 1, 1, 2, 0, -1, 1]
    df = spark.createDataFrame([("c", g, p) for g, p in zip(gold, pred)], "config string, gold_label int, prediction int")
    labels = sorted(set(gold) | set(pred))

    def f1(l):
        tp = sum(1 for g, p in zip(gold, pred) if g == p == l)
        pp = sum(1 for p in pred if p == l)
        sp = sum(1 for g in gold if g == l)
        pr = tp / pp if pp else 0.0
        rc = tp / sp if sp else 0.0
        return 2 * pr * rc / (pr + rc) if pr + rc else 0.0
    r = M.macro_f1(df).collect()[0]
    assert r.f1_macro == pytest.approx(sum(f1(l) for l in labels) / len(labels))
    dic = fixed_dictionary(spark, ["a", "b", "c"])
    r2 = M.macro_f1_fixed(df, dic).collect()[0]
    assert r2.f1_macro == pytest.approx(sum(f1(l) for l in [0, 1, 2]) / 3)
    assert r2.accuracy == pytest.approx(5 / 8)
    rep = {r["class"]: r for r in M.classification_report(df, dic).collect()}
    assert rep["accuracy"].f1 == pytest.approx(5 / 8) and rep["unknown"].support == 0


def test_stratified_split_errors(spark):
    one = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b")], "id long, y string")
    with pytest.raises(Exception):
        S.stratified_split(one, "y", "id", 0.5).collect()
    few = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "id long, y string")
    with pytest.raises(Exception):
        S.stratified_split(few, "y", "id", 0.1).collect()  # ceil(0.9) = 1 test row < 3 classes


def test_grouped_split_keeps_copies_together(spark):
    rows = [(i, "ab"[i % 2], f"t{i % 37}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y string, g string")
    out = S.stratified_split(df, "y", "id", 0.3, seed=5, group_col="g").collect()
    side = {}
    for r in out:
        side.setdefault((r.y, r.g), set()).add(r.split)
    assert all(len(v) == 1 for v in side.values())
    n = Counter(r.y for r in out if r.split == "test")
    assert sum(n.values()) >= math.ceil(400 * 0.3)
