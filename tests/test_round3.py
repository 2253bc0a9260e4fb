import numpy as np
from pyspark.sql import functions as F

from escalade.functions import text as T
from escalade.operators import linear as LN
from escalade.operators.labels import fixed_dictionary, label_encode
from escalade.plans.cascade import fit_text_cascade


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_vocabulary_model_is_never_broadcast(spark):
    rows = [(i, f"alpha beta {w} {w}x tail{'abcdefgh'[i % 8]}", "de" if i % 2 else "en") for i, w in enumerate(["uno", "dos", "tres", "quattro"] * 5)]
    dc = fit_text_cascade(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for scored in (dc.tiers[2].score(dc.samples, ["sample_id", "gold_label", "bytes_sent"]), dc.cascade.fused(dc.samples)):
        assert any("SortMergeJoin [term#" in line for line in plan_of(scored).splitlines())
        assert scored.count() == len(rows)


def test_characters_that_fold_to_several_are_found_by_ranges(spark):
    many = [a for a, _ in T.expansion_table()]
    pattern = T._any_of(many)
    assert pattern.startswith(r"(?![\x00-\x{131}])[") and pattern.count("-") < 40
    known = set(many)
    rows = [(f"x{chr(c)}y", chr(c) in known) for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame(rows, "t string, known boolean")
    assert df.where(F.col("t").rlike(pattern) != F.col("known")).count() == 0
    assert df.where("known").count() == sum(ord(a) < 0x10000 for a in many)


def test_dense_and_sparse_blocks_fit_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = rng.normal(size=6) * np.arange(1, 7)
        rows.append((i, i % 2, int(x[0] + x[5] + rng.gumbel() > 0), list(range(6)), x.tolist()))
    df = spark.createDataFrame(rows, "id long, fold int, gold int, positions array<int>, values array<double>")
    one = LN.fit(df, 6, 2, 2)
    monkeypatch.setattr(LN, "DENSE", 0)
    other = LN.fit(df, 6, 2, 2)
    assert np.allclose(one.weights, other.weights, atol=1e-5)
    assert one.gradient <= 1e-8
    assert np.abs(one.weights[:, -1].sum(1)).max() < 1e-9
def test_few_class_names_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (3, "a")], "id long, c string")
        out = label_encode(df, "c", fixed_dictionary(spark, ["a", "b"]))
        assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
        assert sorted((r.id, r.label_id) for r in out.where("c is not null").collect()) == [(1, 1), (3, 0), (3, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
